"""Queries that SQL cannot express, at sf0.01, against plain Python on the collected tables."""

from __future__ import annotations

import math
import os

import numpy as np
import pytest
from conftest import SMALL

from pairloom.operators import loops, matrix
from pairloom.plans import registry, view

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the supplied tables are not here")


@pytest.fixture(scope="module")
def data(spark):
    edges = [(r.source, r.sink, r.weight) for r in view.edges(spark, SMALL).collect()]
    regions = sorted((r.ix, r.chromosome, r.valid) for r in view.valid(spark, SMALL).collect())
    n = max(ix for ix, _, _ in regions) + 1
    m = np.zeros((n, n))
    for i, j, w in edges:
        m[i, j] = m[j, i] = w
    return edges, regions, m


def dense_oe(m, own):
    """O/E of one chromosome's bins, all valid, by means of the diagonals."""
    a = m[np.ix_(own, own)]
    e = np.array([np.trace(a, k) / (len(own) - k) for k in range(len(own))])
    i, j = np.indices(a.shape)
    with np.errstate(invalid="ignore", divide="ignore"):
        return a, e[np.abs(i - j)], np.where(a > 0, a / e[np.abs(i - j)], 1.0)


@pytest.mark.parametrize("name, tolerance", [("kr_balance", 1e-5), ("ice_balance", 0.02)])
def test_balanced_marginals(spark, data, name, tolerance):
    _, _, m = data
    v = np.zeros(len(m))
    for r in registry.QUERIES[name](spark, SMALL).collect():
        v[r.ix] = r.bias
    sums = v * (m @ v)
    assert (v[m.sum(axis=1) > 0] > 0).all() and np.abs(sums[v > 0] - sums[v > 0].mean()).max() <= tolerance * sums[v > 0].mean()
    assert name != "kr_balance" or np.abs(sums[v > 0] - 1).max() < 1e-5


def test_eigenvectors_of_the_correlations(spark, data):
    _, regions, m = data
    got = {r.ix: (r.score, r.compartment) for r in registry.QUERIES["compartment_eigenvector"](spark, SMALL).collect()}
    for c in {c for _, c, _ in regions}:
        own = [ix for ix, d, _ in regions if d == c]
        if not all(v for _, d, v in regions if d == c):
            continue
        r = np.corrcoef(dense_oe(m, own)[2])
        v = np.array([got[ix][0] for ix in own])
        values = np.linalg.eigvalsh(r)
        top = values[np.argmax(np.abs(values))]
        assert np.allclose(r @ v, top * v, atol=1e-6) and v.sum() >= 0
        assert all(got[ix][1] == ("A" if got[ix][0] >= 0 else "B") for ix in own)


def test_components_of_samples(spark):
    wide = {}
    for k, s in enumerate("ANR"):
        for r in view.edges(spark, SMALL, s).collect():
            wide.setdefault((r.source, r.sink), [0.0] * 3)[k] = float(r.weight)
    got = registry.QUERIES["sample_components"](spark, SMALL).collect()
    kept = getattr(registry, "_SAMPLES", list("ANR"))
    assert kept == list("ANR") and {r.sample for r in got} <= set(kept)
    x = np.array(list(wide.values()))
    for rows in (x, x[(x > 0).all(axis=1)]):
        c = rows - rows.mean(axis=1, keepdims=True)
        values = np.linalg.svd(c, compute_uv=False) ** 2
        if all(math.isclose(r.explained, values[r.component] / values.sum(), rel_tol=1e-4, abs_tol=1e-6) for r in got):
            norm = {k: sum(r.value**2 for r in got if r.component == k) for k in {r.component for r in got}}
            assert all(math.isclose(v, values[k], rel_tol=1e-4) for k, v in norm.items())
            return
    raise AssertionError("neither all edges nor the common ones explain the components")


def test_loop_pixels_by_direct_sums(spark, data):
    _, regions, m = data
    home = {ix: c for ix, c, _ in regions}
    got = registry.QUERIES["loop_candidates"](spark, SMALL).collect()
    assert got and all(home[r.source] == home[r.sink] == r.chromosome for r in got)
    r0 = np.random.default_rng(1)
    for r in [got[k] for k in r0.choice(len(got), min(60, len(got)), replace=False)]:
        own = [ix for ix, c, v in regions if c == r.chromosome]
        ok = np.array([v for _, c, v in regions if c == r.chromosome])
        a = m[np.ix_(own, own)] * ok[:, None] * ok[None, :]
        i, j = np.indices(a.shape)
        n = np.array([max(1, (ok[: len(own) - k] & ok[k:]).sum()) for k in range(len(own))])
        e = np.array([np.trace(a, k) for k in range(len(own))]) / n
        ex = e[np.abs(i - j)] * ok[:, None] * ok[None, :]
        y, x = own.index(r.source), own.index(r.sink)
        dy, dx = i - y, j - x
        box = lambda k: (np.abs(dy) <= k) & (np.abs(dx) <= k)  # noqa: E731, B023
        around = lambda w: {"ll": (dy >= 1) & (dy <= w) & (dx <= -1) & (dx >= -w) & ~box(1), "h": (np.abs(dy) <= 1) & box(w) & ~box(1), "v": (np.abs(dx) <= 1) & box(w) & ~box(1), "d": box(w) & ~box(1) & (dy != 0) & (dx != 0)}  # noqa: E731, B023
        assert a[around(r.w)["ll"]].sum() >= 4 and (r.w == 4 or a[around(r.w - 1)["ll"]].sum() < 4) and r.weight == a[y, x]
        for k, where in around(r.w).items():
            want = a[where].sum() / ex[where].sum() * ex[y, x] if ex[where].sum() else None
            if r[f"e_{k}"] is not None:
                assert math.isclose(r[f"e_{k}"], want, rel_tol=1e-9) and (r[f"chunk_{k}"] is None or r[f"chunk_{k}"] == loops.chunk(want))


def test_rates_and_enriched_pixels(spark):
    pixels = registry.QUERIES["loop_candidates"](spark, SMALL).collect()
    table = {(r.kind, r.chunk, r.observed): r.fdr for r in registry.QUERIES["fdr_table"](spark, SMALL).collect()}
    for kind in loops.KINDS:
        for c in {r[f"chunk_{kind}"] for r in pixels} - {None}:
            own = [round(r.weight) for r in pixels if r[f"chunk_{kind}"] == c]
            lam = 2 ** (c / 3)
            for o in (0, 1, max(own)):
                tail = max(0.0, 1 - sum(math.exp(-lam + k * math.log(lam) - math.lgamma(k + 1)) for k in range(o)))
                assert math.isclose(table[kind, c, o], min(1, tail / (sum(x >= o for x in own) / len(own))), abs_tol=1e-9)
    keep = set()
    for r in pixels:
        oe = {k: r[f"oe_{k}"] for k in loops.KINDS}
        fdr = [table.get((k, r[f"chunk_{k}"], round(r.weight)), 1.0) for k in loops.KINDS]
        if None not in oe.values() and min(oe["d"], oe["ll"]) >= 1.75 and max(oe["d"], oe["ll"]) >= 2 and min(oe["h"], oe["v"]) >= 1.5 and max(fdr) <= 0.1:
            keep.add((r.source, r.sink))
    assert {(r.source, r.sink) for r in registry.QUERIES["enriched_peaks"](spark, SMALL).collect()} == keep


def grown(points, distance):
    """Clusters from the strongest point on: [members], each a list of (x, y, weight, extra)."""
    left, out = list(points), []
    while left:
        own = [left.pop(0)]
        while left:
            x, y = (sum(p[k] for p in own) / len(own) for k in (0, 1))
            radius = max(math.dist((x, y), p[:2]) for p in own)
            k = min(range(len(left)), key=lambda i: math.dist((x, y), left[i][:2]))
            if math.dist((x, y), left[k][:2]) > distance + radius:
                break
            own.append(left.pop(k))
        out.append(own)
    return out


def test_merged_and_overlapping_peaks(spark):
    peaks = registry._strong(spark, SMALL).collect()
    want = []
    for c in {p.chromosome for p in peaks}:
        own = sorted(((float(p.source), float(p.sink), p.weight, p.q) for p in peaks if p.chromosome == c), key=lambda p: (-p[2], p[0], p[1]))
        want += [(c, len(g), round(sum(p[0] for p in g) / len(g), 6), round(sum(p[3] for p in g), 6)) for g in grown(own, 2)]
    got = [(r.chromosome, r.n, round(r.x, 6), round(r.q_sum, 6)) for r in registry.QUERIES["merge_peaks"](spark, SMALL).collect()]
    assert sorted(got) == sorted(want)
    rows = [(r.source // 50, float(r.source), float(r.sink), float(r.weight), s) for s in "ANR" for r in view.edges(spark, SMALL, s).where("weight >= 3 and sink - source between 2 and 40").collect()]
    want = []
    for c in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == c), key=lambda p: (-p[2], p[0], p[1], p[3]))
        want += [(c, len(g), round(sum(p[0] for p in g) / len(g), 6), ",".join(sorted({p[3] for p in g}))) for g in grown(own, 2)]
    assert sorted((r.chromosome, r.n, round(r.x, 6), r.samples) for r in registry.QUERIES["overlap_peaks"](spark, SMALL).collect()) == sorted(want)


def test_boundaries_are_turns_of_the_track(spark):
    score = {(r.chromosome, r.ix): r.score for r in view.tracks(spark, SMALL).collect()}
    mean = lambda c, ks: (lambda v: sum(v) / len(v) if v else None)([score[c, k] for k in ks if score.get((c, k)) is not None])
    got = registry.QUERIES["boundaries"](spark, SMALL).collect()
    assert got
    for r in got:
        c = r.chromosome
        delta = {}
        for k in (r.ix - 1, r.ix, r.ix + 1):
            after, before = mean(c, range(k + 1, k + 4)), mean(c, range(k - 3, k))
            delta[k] = after - before if score.get((c, k)) is not None and None not in (after, before) else None
        signs = {math.copysign(1, v) for v in delta.values() if v}
        assert r.prominence >= 0 and len(signs) == 2  # the difference of both sides changes its sign here
