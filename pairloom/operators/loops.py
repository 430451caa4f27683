"""Loop calling by local enrichment, false discovery rates, peak filters, merging and overlap of peaks.

Edges are dealt to square tiles with a halo as wide as the largest neighbourhood; each tile is one dense
block in one task, where neighbourhood sums are differences of a summed-area table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("ll", "h", "v", "d")


def sizes(bin_size: int) -> tuple[int, int]:
    """(p, w): half widths of the peak and of its neighbourhood for a bin size."""
    return (1, 3) if bin_size > 25_000 else (int(24_999 / bin_size), int(25_000 / bin_size + 0.5) + 2)


def chunk(x: float) -> int:
    """The bin of an expected value on a scale of cube roots of two."""
    return max(0, int(3 * math.log2(x)) + 1) if x > 0 else 0


def _area(a: np.ndarray) -> np.ndarray:
    return np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))


def _box(s: np.ndarray, i: np.ndarray, j: np.ndarray, top: int, bottom: int, left: int, right: int) -> np.ndarray:
    """Sums of rows i+top .. i+bottom and columns j+left .. j+right (inclusive), cut at the block's borders."""
    n, m = s.shape[0] - 1, s.shape[1] - 1
    t, b = np.clip(i + top, 0, n), np.clip(i + bottom + 1, 0, n)
    l, r = np.clip(j + left, 0, m), np.clip(j + right + 1, 0, m)  # noqa: E741
    return np.where((b > t) & (r > l), s[b, r] - s[t, r] - s[b, l] + s[t, l], 0.0)


def neighbourhoods(s: np.ndarray, i: np.ndarray, j: np.ndarray, p: int, w: int, kinds: tuple[str, ...] = KINDS) -> dict[str, np.ndarray]:
    """Sums over the lower left, the horizontal and vertical bands, and the donut around the pixels (i, j)."""
    box = lambda a, b, c, d: _box(s, i, j, a, b, c, d)
    out = {}
    if "ll" in kinds:
        out["ll"] = box(1, w, -w, -1) - box(1, p, -p, -1)
    if "h" in kinds:
        out["h"] = box(-1, 1, -w, w) - box(-1, 1, -p, p)
    if "v" in kinds:
        out["v"] = box(-w, w, -1, 1) - box(-p, p, -1, 1)
    if "d" in kinds:
        cross = box(-w, w, 0, 0) + box(0, 0, -w, w) - box(0, 0, 0, 0)
        in_peak = box(-p, p, 0, 0) + box(0, 0, -p, p) - box(0, 0, 0, 0)
        out["d"] = box(-w, w, -w, w) - box(-p, p, -p, p) - (cross - in_peak)
    return out


def _tiles(edges: DataFrame, tile: int, halo: int) -> DataFrame:
    """Edges in every tile (_r, _c) that sees them; those that a tile near the diagonal sees from below are mirrored."""
    spread = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))
    rows = edges.select("chromosome", "source", "sink", F.col("weight").cast("double").alias("weight"))
    low = rows.where(f"source < sink and sink - source <= {2 * halo}").select("chromosome", F.col("sink").alias("source"), F.col("source").alias("sink"), "weight")
    rows = rows.unionByName(low).select("*", F.explode(spread("source")).alias("_r"), spread("sink").alias("_cs"))
    return rows.select("chromosome", "source", "sink", "weight", "_r", F.explode("_cs").alias("_c"))


def _dimensions(tiles: DataFrame, expected: DataFrame, regions: DataFrame, tile: int, halo: int) -> DataFrame:
    """One row for each tile (chromosome, _r, _c): the bins of its rows and columns, and the expected values of its distances."""
    spread = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))).alias("_t")
    bins = regions.where("valid").select("chromosome", "ix", F.col("bias").cast("double").alias("bias"), spread("ix"))
    bins = bins.groupBy("chromosome", "_t").agg(F.collect_list(F.struct("ix", "bias")).alias("_bins"))  # tile + 2 halo at most
    e = expected.where("chromosome is not null").select("chromosome", "distance", "expected")
    side = tile + 2 * halo  # a tile's distances lie within a side of (_c - _r) * tile
    e = e.select("*", F.explode(F.array(F.col("distance"), -F.col("distance"))).alias("d")).distinct()
    e = e.select("chromosome", "distance", "expected", F.explode(F.sequence(F.ceil((F.col("d") - side) / tile), F.floor((F.col("d") + side) / tile))).alias("_k")).distinct()
    e = e.groupBy("chromosome", "_k").agg(F.collect_list(F.struct("distance", "expected")).alias("_exp"))
    rows = tiles.select("chromosome", "_r", "_c").distinct().withColumn("_k", F.col("_c") - F.col("_r"))
    rows = rows.join(bins.withColumnsRenamed({"_t": "_r", "_bins": "_rows"}), ["chromosome", "_r"]).join(bins.withColumnsRenamed({"_t": "_c", "_bins": "_columns"}), ["chromosome", "_c"])
    return rows.join(e, ["chromosome", "_k"]).select("chromosome", "_r", "_c", "_rows", "_columns", "_exp")


def call(edges: DataFrame, expected: DataFrame, regions: DataFrame, p: int, w: int, most_w: int = 20, least_reads: int = 16, least_distance: int | None = None, mappable: float = 0.7, tile: int = 200) -> DataFrame:
    """(chromosome, source, sink, weight, w, e_*, oe_*, mappability_*, chunk_*) of cis pixels beyond the least distance.

    edges: (chromosome, source, sink, weight); expected: (chromosome, distance, expected); regions have
    bias (1 / weight factor per bin) and valid. A tile meets its slices of the bins and of the expected values once, and all
    of its pixels are measured together, one neighbourhood width after the other.
    """
    far = p if least_distance is None else least_distance
    halo = most_w + 1
    kind = regions.schema["chromosome"].dataType.simpleString()
    placed = _tiles(edges, tile, halo)
    names = ["chromosome", "source", "sink", "weight", "w", *[f"{a}_{k}" for k in KINDS for a in ("e", "oe", "mappability", "chunk")]]

    def run(cells: pd.DataFrame, dims: pd.DataFrame) -> pd.DataFrame:
        if not len(cells) or not len(dims):
            return pd.DataFrame([], columns=names)
        r0, c0 = int(cells._r.iloc[0]) * tile - halo, int(cells._c.iloc[0]) * tile - halo
        side = tile + 2 * halo
        m = np.zeros((side, side))
        m[cells.source.to_numpy() - r0, cells.sink.to_numpy() - c0] = cells.weight.to_numpy()
        ok, bias = [], []
        for column, at in (("_rows", r0), ("_columns", c0)):
            valid, b = np.zeros(side, bool), np.ones(side)
            for x in dims[column].iloc[0]:
                if 0 <= (k := x["ix"] - at) < side:
                    valid[k], b[k] = True, x["bias"] or 0.0
            ok.append(valid)
            bias.append(b)
        apart = np.abs(np.arange(r0, r0 + side)[:, None] - np.arange(c0, c0 + side)[None, :])
        low = int(apart.min())
        vec = np.zeros(int(apart.max()) - low + 1)
        for x in dims._exp.iloc[0]:
            if 0 <= (k := x["distance"] - low) < len(vec):
                vec[k] = x["expected"] or 0.0
        both = ok[0][:, None] & ok[1][None, :]
        ex, value = vec[apart - low] * both, m * both * bias[0][:, None] * bias[1][None, :]
        s_raw, s_val, s_exp, s_ok, ones = _area(m * both), _area(value), _area(ex), _area(both.astype(float)), _area(np.ones_like(m))
        i, j = (x + halo for x in np.nonzero(m[halo : halo + tile, halo : halo + tile]))
        use = ((c0 + j) - (r0 + i) >= p + far) & both[i, j]
        i, j = i[use], j[use]
        width, open_ = np.zeros(len(i), dtype=np.int64), np.arange(len(i))
        for k in range(w, most_w + 1):
            enough = neighbourhoods(s_raw, i[open_], j[open_], p, k, ("ll",))["ll"] >= least_reads
            width[open_[enough]] = k
            open_ = open_[~enough]
        parts = []
        for k in np.unique(width[width > 0]):
            x, y = i[width == k], j[width == k]
            a, b, seen, full = (neighbourhoods(s, x, y, p, int(k)) for s in (s_val, s_exp, s_ok, ones))
            out = {"source": r0 + x, "sink": c0 + y, "weight": value[x, y], "w": np.full(len(x), k)}
            scale = bias[0][x] * bias[1][y]
            for name in KINDS:
                with np.errstate(invalid="ignore", divide="ignore"):
                    share = np.where(full[name] > 0, seen[name] / full[name], 0.0)
                    e = np.where((b[name] != 0) & (share >= mappable), a[name] / b[name] * ex[x, y], np.nan)
                    e_raw = e / np.where(scale != 0, scale, np.nan)
                out |= {f"e_{name}": e, f"oe_{name}": np.where(e > 0, value[x, y] / np.where(e > 0, e, 1), np.nan), f"mappability_{name}": share}
                out[f"chunk_{name}"] = [float(chunk(v)) if v > 0 else np.nan for v in e_raw]
            parts.append(pd.DataFrame(out))
        if not parts:
            return pd.DataFrame([], columns=names)
        frame = pd.concat(parts, ignore_index=True)
        frame.insert(0, "chromosome", pd.Series([cells.chromosome.iloc[0]] * len(frame), dtype=object))
        return frame[names]

    shape = f"chromosome {kind}, source long, sink long, weight double, w int, " + ", ".join(f"e_{k} double, oe_{k} double, mappability_{k} double, chunk_{k} long" for k in KINDS)
    key = ("chromosome", "_r", "_c")
    dims = _dimensions(placed, expected, regions, tile, halo).toDF("_k0", "_k1", "_k2", "_rows", "_columns", "_exp")
    rows = placed.groupBy(*key).cogroup(dims.groupBy("_k0", "_k1", "_k2")).applyInPandas(run, shape)
    nan = [f"{a}_{k}" for k in KINDS for a in ("e", "oe")]
    return rows.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in nan})


def poisson_tail(lam: float, n: int) -> np.ndarray:
    """P(X >= k) for k = 0 .. n."""
    k = np.arange(n + 1)
    log = -lam + k * (math.log(lam) if lam > 0 else -np.inf) - np.array([math.lgamma(x + 1) for x in k])
    below = np.cumsum(np.r_[0.0, np.exp(log)])[: n + 1]
    return np.clip(1 - below, 0, 1)


def fdr_table(pixels: DataFrame, count: str = "weight") -> DataFrame:
    """(kind, chunk, observed, fdr): right tail of Poisson(2 ** (chunk / 3)) over the observed right tail, at most 1."""
    one = [F.struct(F.lit(k).alias("kind"), F.col(f"chunk_{k}").alias("chunk")) for k in KINDS]
    rows = pixels.select(F.round(count).cast("int").alias("observed"), F.explode(F.array(*one)).alias("x")).select("x.kind", "x.chunk", "observed").where("chunk is not null")
    counts = rows.groupBy("kind", "chunk", "observed").count()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        top = int(pdf.observed.max())
        n = np.zeros(top + 1)
        n[pdf.observed.to_numpy()] = pdf["count"].to_numpy()
        seen = n[::-1].cumsum()[::-1] / n.sum()
        fdr = np.where(seen > 0, np.minimum(1, poisson_tail(2 ** (int(pdf.chunk.iloc[0]) / 3), top) / np.maximum(seen, 1e-300)), 0.0)
        return pd.DataFrame({"kind": pdf.kind.iloc[0], "chunk": pdf.chunk.iloc[0], "observed": np.arange(top + 1), "fdr": fdr})

    return counts.groupBy("kind", "chunk").applyInPandas(run, "kind string, chunk long, observed int, fdr double")


def with_fdr(pixels: DataFrame, table: DataFrame, count: str = "weight") -> DataFrame:
    """Adds fdr_* of each neighbourhood; 1 where the table has no entry."""
    rows = pixels.withColumn("_o", F.round(count).cast("int"))
    for k in KINDS:
        t = table.where(F.col("kind") == k).select(F.col("chunk").alias(f"chunk_{k}"), F.col("observed").alias("_o"), F.col("fdr").alias(f"fdr_{k}"))
        rows = rows.join(t, [f"chunk_{k}", "_o"], "left").withColumn(f"fdr_{k}", F.coalesce(f"fdr_{k}", F.lit(1.0)))
    return rows.drop("_o")


def enriched(fdr: float = 0.1) -> Column:
    """Keeps a pixel by its enrichment over all four neighbourhoods and its false discovery rates."""
    oe = {k: F.col(f"oe_{k}") for k in KINDS}
    ok = (F.least(oe["d"], oe["ll"]) >= 1.75) & (F.greatest(oe["d"], oe["ll"]) >= 2) & (oe["h"] >= 1.5) & (oe["v"] >= 1.5)
    for k in KINDS:
        ok = ok & (F.col(f"fdr_{k}") <= fdr)
    return F.coalesce(ok, F.lit(False))


def _each(column: str, every: float | None, **own: float | None) -> dict[str, float]:
    """Limits by neighbourhood: its own one, or the one for all."""
    limits = {k: own.get(k) if own.get(k) is not None else every for k in KINDS}
    return {f"{column}_{k}": v for k, v in limits.items() if v is not None}


def peak_filters(
    observed: float | None = None, distance: int | None = None, fdr: float | None = None, mappability: float | None = None, enrichment: float | None = None,
    rao: bool = False, count: str = "weight", own: dict[str, dict[str, float]] | None = None,
) -> dict[str, Column]:
    """Conditions that keep a peak, by filter name, for masks.apply_filters.

    fdr, mappability and enrichment hold for all four neighbourhoods; ``own`` has limits of single ones, such as
    {"fdr": {"ll": 0.05}}. rao: both of donut and lower left at 1.75 or more, not both of horizontal and vertical below
    1.5, the lower left below 2 only under a larger donut, and every rate at most 0.1. Where a neighbourhood has no
    expected value, a peak fails enrichment and rao.
    """
    own = own or {}
    out: dict[str, Column] = {}
    if observed is not None:
        out["observed"] = F.col(count) >= observed
    if distance is not None:
        out["distance"] = F.abs(F.col("source") - F.col("sink")) >= distance
    known = F.lit(True)
    for k in KINDS:
        known = known & F.coalesce(F.col(f"e_{k}") != 0, F.lit(False))
    for name, column, limit in (("fdr", "fdr", fdr), ("mappability", "mappability", mappability), ("enrichment", "oe", enrichment)):
        limits = _each(column, limit, **own.get(name, {}))
        if limits:
            ok = known if name == "enrichment" else F.lit(True)
            for c, v in limits.items():
                ok = ok & (F.col(c) <= v if name == "fdr" else F.col(c) >= v)
            out[name] = F.coalesce(ok, F.lit(False))
    if rao:
        d, ll, h, v = (F.col(f"oe_{k}") for k in ("d", "ll", "h", "v"))
        ok = known & ~((d <= ll) & (ll < 2.0)) & ~((h < 1.5) & (v < 1.5)) & (d >= 1.75) & (ll >= 1.75)
        for k in KINDS:
            ok = ok & (F.col(f"fdr_{k}") <= 0.1)
        out["rao"] = F.coalesce(ok, F.lit(False))
    return out


def merged_filters(singlet_q: float | None = 0.02, q_sum: float | None = None) -> dict[str, Column]:
    """Conditions that keep a merged peak: single pixels up to a sum of rates, and all up to another."""
    out = {}
    if singlet_q is not None:
        out["singlet"] = ~((F.col("radius") == 0) & (F.col("q_sum") > singlet_q))
    if q_sum is not None:
        out["q_sum"] = F.col("q_sum") <= q_sum
    return out


def merge_peaks(peaks: DataFrame, distance: float) -> DataFrame:
    """(chromosome, x, y, radius, n, weight, q_sum): from the strongest pixel on, near pixels join its cluster.

    One chromosome's peaks are one group: they are few after filtering.
    """
    kind = peaks.schema["chromosome"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf.sort_values(["weight", "source", "sink"], ascending=[False, True, True])[["source", "sink", "weight", "q"]].to_numpy(dtype=float)
        out = []
        while len(left):
            members, left = left[:1], left[1:]
            x, y, radius = members[0, 0], members[0, 1], 0.0
            while len(left):
                d = np.hypot(left[:, 0] - x, left[:, 1] - y)
                k = int(np.argmin(d))
                if d[k] > distance + radius:
                    break
                members, left = np.r_[members, left[k : k + 1]], np.delete(left, k, axis=0)
                x, y = members[:, 0].mean(), members[:, 1].mean()
                radius = float(np.hypot(members[:, 0] - x, members[:, 1] - y).max())
            out.append((pdf.chromosome.iloc[0], x, y, radius, len(members), members[0, 2], members[:, 3].sum()))
        return pd.DataFrame(out, columns=["chromosome", "x", "y", "radius", "n", "weight", "q_sum"])

    return peaks.groupBy("chromosome").applyInPandas(run, f"chromosome {kind}, x double, y double, radius double, n long, weight double, q_sum double")


def overlap_peaks(peaks: DataFrame, distance: float) -> DataFrame:
    """(chromosome, x, y, n, weight, samples): clusters of the peaks (chromosome, x, y, weight, sample) of several samples."""
    kind = peaks.schema["chromosome"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "x", "y", "sample"], ascending=[False, True, True, True], ignore_index=True)
        at, names, weight, free = pdf[["x", "y"]].to_numpy(dtype=float), pdf["sample"].to_numpy(), pdf.weight.to_numpy(), np.ones(len(pdf), bool)
        out = []
        for k in range(len(pdf)):
            if not free[k]:
                continue
            free[k], own, radius = False, [k], 0.0
            while free.any():
                centre = at[own].mean(axis=0)
                d = np.where(free, np.hypot(*(at - centre).T), np.inf)
                i = int(np.argmin(d))
                if d[i] > distance + radius:
                    break
                free[i] = False
                own.append(i)
                centre = at[own].mean(axis=0)
                radius = float(np.hypot(*(at[own] - centre).T).max())
            x, y = at[own].mean(axis=0)
            out.append((pdf.chromosome.iloc[0], x, y, len(own), float(weight[own].mean()), ",".join(sorted(set(names[own])))))
        return pd.DataFrame(out, columns=["chromosome", "x", "y", "n", "weight", "samples"])

    return peaks.groupBy("chromosome").applyInPandas(run, f"chromosome {kind}, x double, y double, n long, weight double, samples string")
