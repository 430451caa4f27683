"""One-dimensional tracks along bins: insulation, directionality, sliding windows, boundaries, runs."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .matrix import chromosome_range, with_ends


def half_window(bp: int, bin_size: int) -> int:
    return int(math.ceil(bp / bin_size) / 2)


def log2_or_null(x: Column) -> Column:
    return F.when(x > 0, F.log2(x))


def insulation(edges: DataFrame, regions: DataFrame, w: int, offset: int = 0, normalise: bool = True, log: bool = True, sliding: int | None = None, subtract: bool = False, geometric: bool = False, impute: DataFrame | None = None) -> DataFrame:
    """(ix, score): the mean weight of the w x w square that spans each bin, over the chromosome's mean, log2.

    With impute (chromosome, distance, expected) cells with an invalid bin count with their expected value.

    The mean may be that of ``sliding`` bins on either side, and geometric (zeros left out); it is divided by or subtracted.

    An edge (s, t) is in the squares of bins k with s <= k - off, t >= k + off, s > k - off - w, t < k + off + w,
    off = offset + 1. Cells with an invalid bin don't count; null near the ends or with over half the square invalid.
    """
    off = offset + 1
    cis = with_ends(edges, regions.select("ix", "chromosome", "valid"), "chromosome", "valid")
    cis = cis.where("source_chromosome = sink_chromosome and source_valid and sink_valid")
    low, high = F.greatest(F.col("source") + off, F.col("sink") - off - w + 1), F.least(F.col("sink") - off, F.col("source") + off + w - 1)
    hits = cis.where(low <= high).select("weight", F.explode(F.sequence(low, high)).alias("ix")).groupBy("ix").agg(F.sum("weight").alias("_sum"))
    by = Window.partitionBy("chromosome").orderBy("ix")
    bad = F.when(F.col("valid"), 0).otherwise(1)
    rows = regions.select("ix", "chromosome", "valid")
    rows = rows.withColumn("_v", F.coalesce(F.sum(bad).over(by.rowsBetween(-off - w + 1, -off)), F.lit(0))).withColumn("_h", F.coalesce(F.sum(bad).over(by.rowsBetween(off, off + w - 1)), F.lit(0)))
    rows = chromosome_range(rows).join(hits, "ix", "left")
    if impute is not None:
        span = F.sequence(F.lit(0), F.lit(w - 1))
        holes = rows.where("_v > 0 or _h > 0").select("ix", "chromosome", F.explode(span).alias("_x")).select("*", F.explode(span).alias("_y"))
        holes = holes.select("ix", "chromosome", (F.col("ix") - off - F.col("_x")).alias("_i"), (F.col("ix") + off + F.col("_y")).alias("_j"), (2 * off + F.col("_x") + F.col("_y")).alias("distance"))
        wrong = regions.where("not valid").select("ix", F.lit(True).alias("_bad"))
        for end in ("_i", "_j"):
            holes = holes.join(wrong.select(F.col("ix").alias(end), F.col("_bad").alias(f"_bad{end}")), end, "left")
        holes = holes.where("_bad_i or _bad_j").join(impute.where("chromosome is not null").select("chromosome", "distance", "expected"), ["chromosome", "distance"])
        rows = rows.join(holes.groupBy("ix").agg(F.sum("expected").alias("_filled")), "ix", "left").withColumn("_sum", F.coalesce("_sum", F.lit(0)) + F.coalesce("_filled", F.lit(0.0))).withColumn("_v", F.lit(0)).withColumn("_h", F.lit(0))
    k, n = F.col("ix") - F.col("_first"), F.col("_size")
    na = w * F.col("_v") + w * F.col("_h") - F.col("_v") * F.col("_h")
    ends = (k - off < w - 1) | (k + off > n - w)
    rows = rows.withColumn("score", F.when(~ends & (na <= 0.5 * w * w) & (na < w * w), F.coalesce("_sum", F.lit(0)) / (w * w - na)))
    score = F.col("score")
    if normalise:
        frame = Window.partitionBy("chromosome") if sliding is None else by.rowsBetween(-sliding, sliding)
        mean = F.exp(F.avg(F.when(score > 0, F.ln(score))).over(frame)) if geometric else F.avg(score).over(frame)
        score = score - mean if subtract else score / F.nullif(mean, F.lit(0.0))
    return rows.select("ix", (log2_or_null(score) if log else score).alias("score"))


def insulation_windows(edges: DataFrame, regions: DataFrame, windows: list[int], **how: object) -> DataFrame:
    """(w, ix, score): insulation by several window sizes."""
    out = [insulation(edges, regions, w, **how).select(F.lit(w).alias("w"), "ix", "score") for w in windows]
    return functools.reduce(DataFrame.unionByName, out)


def directionality(edges: DataFrame, regions: DataFrame, w: int) -> DataFrame:
    """(ix, score): signed chi-square-like excess of downstream over upstream contacts within w bins."""
    rows = chromosome_range(regions.select("ix", "chromosome", "valid"))
    rows = rows.withColumn("_edge", F.least(F.col("ix") - F.col("_first"), F.col("_first") + F.col("_size") - 1 - F.col("ix")))
    cis = with_ends(edges, rows.select("ix", "chromosome", "valid", "_edge"), "chromosome", "valid", "_edge")
    cis = cis.where(f"source_chromosome = sink_chromosome and source_valid and sink_valid and source < sink and sink - source <= {w}")
    d = F.col("sink") - F.col("source")
    up = cis.where(F.col("sink__edge") >= d).groupBy(F.col("sink").alias("ix")).agg(F.sum("weight").alias("_a"))
    down = cis.where(F.col("source__edge") >= d).groupBy(F.col("source").alias("ix")).agg(F.sum("weight").alias("_b"))
    by = Window.partitionBy("chromosome").orderBy("ix")
    good = F.when(F.col("valid"), 1).otherwise(0)
    rows = rows.withColumn("_lm", F.coalesce(F.sum(good).over(by.rowsBetween(-w, -1)), F.lit(0))).withColumn("_rm", F.sum(good).over(by.rowsBetween(0, w - 1)))
    rows = rows.join(up, "ix", "left").join(down, "ix", "left")
    ok = (F.col("_lm") >= 0.5 * w) & (F.col("_rm") >= 0.5 * w)
    fill = lambda s, m: F.coalesce(s, F.lit(0.0)) + F.coalesce(s, F.lit(0.0)) / F.nullif(m, F.lit(0)) * (w - m)
    rows = rows.select("ix", F.when(ok, fill(F.col("_a").cast("double"), F.col("_lm"))).alias("a"), F.when(ok, fill(F.col("_b").cast("double"), F.col("_rm"))).alias("b"))
    e = (F.col("a") + F.col("b")) / 2
    score = F.signum(F.col("b") - F.col("a")) * (F.pow(F.col("a") - e, 2) / F.nullif(e, F.lit(0.0)) + F.pow(F.col("b") - e, 2) / F.nullif(e, F.lit(0.0)))
    return rows.select("ix", F.when(F.col("a").isNull(), None).when((e == 0) | (F.col("a") == F.col("b")), 0.0).otherwise(score).alias("score"))


def _track(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy("ix") if by else Window.orderBy("ix")  # one row per bin


def delta(scores: DataFrame, w: int, *by: str) -> DataFrame:
    """Adds delta: mean(next w - own) - mean(last w - own)."""
    t = _track(*by)
    return scores.withColumn("delta", (F.avg("score").over(t.rowsBetween(1, w)) - F.col("score")) - (F.avg("score").over(t.rowsBetween(-w, -1)) - F.col("score")))


def sliding_mean(scores: DataFrame, w: int, *by: str) -> DataFrame:
    return scores.withColumn("mean", F.avg("score").over(_track(*by).rowsBetween(-w, w)))


def zero_crossings(track: DataFrame, column: str, *by: str) -> DataFrame:
    """Bins (rounded half to even, each once) where a column changes sign between neighbours."""
    t = _track(*by)
    n, a, b = F.row_number().over(t) - 1, F.col(column), F.lead(column).over(t)
    rows = track.select(*by, n.alias("_i"), a.alias("_a"), b.alias("_b")).where("_a is not null and _b is not null and ((_a < 0 and _b > 0) or (_a > 0 and _b < 0))")
    return rows.select(*by, F.rint(F.col("_i") + F.col("_a") / (F.col("_a") - F.col("_b"))).cast("long").alias("position")).distinct()


def runs(track: DataFrame, sign: str = "sign", score: str = "score") -> DataFrame:
    """(chromosome, first, last, sign, n, score): runs of equal sign along each chromosome, with their mean score."""
    t = Window.partitionBy("chromosome").orderBy("ix")
    new = F.when(F.lag(sign).over(t).eqNullSafe(F.col(sign)), 0).otherwise(1)
    rows = track.withColumn("_new", new).withColumn("_run", F.sum("_new").over(t.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("chromosome", "_run", sign).agg(F.min("ix").alias("first"), F.max("ix").alias("last"), F.count("*").alias("n"), F.avg(score).alias("score")).drop("_run")


def _slopes(x: np.ndarray, w: int) -> np.ndarray:
    """First derivative by fitting a parabola to 2w+1 points; at the ends that of the nearest full window's parabola."""
    n, size = len(x), 2 * w + 1
    if n < size:
        return np.gradient(x) if n > 1 else np.zeros(n)
    k = np.arange(-w, w + 1)
    out = np.empty(n)
    out[w : n - w] = np.convolve(x, (k / (k @ k))[::-1], "valid")
    for at, where in ((0, np.arange(w)), (n - size, np.arange(n - w, n))):
        c = np.polynomial.polynomial.polyfit(np.arange(size), x[at : at + size], 2)
        t = where - at
        out[where] = c[1] + 2 * c[2] * t
    return out


def call_boundaries(x: np.ndarray, w: int, maxima: bool = False, least: float | None = None, sub_bin: bool = False) -> list[tuple[float, float]]:
    """(index, score) of the minima (or maxima) of a track: zero crossings of its delta, scored by prominence.

    Those below ``least`` go; with sub_bin an index is where the line between two bins crosses zero.
    """
    x = np.asarray(x, dtype=float)
    n = len(x)
    d = np.full(n, np.nan)
    for i in range(n):
        a, b = x[i + 1 : i + w + 1] - x[i], x[max(0, i - w) : i] - x[i]
        if len(a) and len(b) and np.isfinite(a).any() and np.isfinite(b).any():
            d[i] = np.nanmean(a) - np.nanmean(b)

    def places(v: np.ndarray) -> np.ndarray:
        i = np.flatnonzero(np.isfinite(v[:-1]) & np.isfinite(v[1:]) & (np.sign(v[:-1]) * np.sign(v[1:]) < 0))
        return i + v[i] / (v[i] - v[i + 1])

    def crossings(v: np.ndarray) -> np.ndarray:
        return np.unique(np.rint(places(v)).astype(int))

    filled = np.where(np.isfinite(d), d, 0.0)
    slope = _slopes(filled, w)
    extremes = crossings(slope)
    out = []
    exact = {int(np.rint(f)): float(f) for f in places(d)[::-1]}
    for i in crossings(d):
        if (slope[i] > 0) == (not maxima):
            left, right = extremes[extremes < i], extremes[extremes > i]
            a = d[left[-1]] if len(left) else np.nan
            b = d[right[0]] if len(right) else np.nan
            if np.isfinite(a) and np.isfinite(b):
                out.append((exact[int(i)] if sub_bin else int(i), float(abs(a - b))))
    return [x for x in out if least is None or x[1] >= least]


def boundaries(scores: DataFrame, w: int = 3, maxima: bool = False, *by: str, least: float | None = None, log: bool = False) -> DataFrame:
    """(.., ix, prominence) of each track, on log2 scores if asked for; a track has one number per bin and is called in one task.

    ``by`` may name several columns, such as a window size: each of their values is a track.
    """
    if log:
        scores = scores.withColumn("score", log2_or_null(F.col("score")))
    names = "".join(f"{c} {scores.schema[c].dataType.simpleString()}, " for c in by)

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ix")
        got = call_boundaries(pdf.score.to_numpy(dtype=float), w, maxima, least)
        out = pd.DataFrame({"ix": pdf.ix.to_numpy()[[i for i, _ in got]], "prominence": [s for _, s in got]})
        for k, c in enumerate(by):
            out.insert(k, c, pdf[c].iloc[0])
        return out

    return scores.groupBy(*(by or [F.lit(0)])).applyInPandas(call, f"{names}ix long, prominence double")


def trimmed_mean(rows: DataFrame, column: str, share: float, *by: str) -> DataFrame:
    """(.., mean): the mean without the int(n * share) smallest and largest values of each group."""
    n, r = F.count(column).over(Window.partitionBy(*by)), F.row_number().over(Window.partitionBy(*by).orderBy(column))
    cut = F.floor(F.col("_n") * share)
    kept = rows.where(F.col(column).isNotNull()).withColumn("_n", n).withColumn("_r", r).where((F.col("_r") > cut) & (F.col("_r") <= F.col("_n") - cut))
    return kept.groupBy(*by).agg(F.avg(column).alias("mean"))


def contact_average(edges: DataFrame, regions: DataFrame, w: int) -> DataFrame:
    """(ix, left, right): mean contact of each bin with the w bins before and after it, as far as they are in its chromosome."""
    rows = chromosome_range(regions.select("ix", "chromosome"))
    cis = with_ends(edges, rows, "chromosome").where(f"source_chromosome = sink_chromosome and source < sink and sink - source <= {w}")
    left = cis.groupBy(F.col("sink").alias("ix")).agg(F.sum("weight").alias("_l"))
    right = cis.groupBy(F.col("source").alias("ix")).agg(F.sum("weight").alias("_r"))
    k = F.col("ix") - F.col("_first")
    before, after = F.least(k, F.lit(w)), F.least(F.col("_size") - 1 - k, F.lit(w))
    rows = rows.join(left, "ix", "left").join(right, "ix", "left")
    mean = lambda s, n: F.coalesce(s, F.lit(0)) / F.nullif(n, F.lit(0))
    return rows.select("ix", mean(F.col("_l"), before).alias("left"), mean(F.col("_r"), after).alias("right"))


def smoothed_expected(expected: DataFrame, least: float) -> DataFrame:
    """Expected values whose window grows on both sides until it holds ``least`` contacts; a vector has one number per distance.

    A window's total only grows with its half width, which is found by halving, for all distances at once, on prefix sums.
    """
    kind = expected.schema["chromosome"].dataType.simpleString()

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("distance", ignore_index=True)
        total, possible = (np.r_[0.0, np.cumsum(pdf[c].to_numpy(dtype=float))] for c in ("total", "possible"))
        n = len(pdf)
        i, low, high = np.arange(n), np.zeros(n, dtype=np.int64), np.full(n, n, dtype=np.int64)  # at n all is inside
        ends = lambda k: (np.maximum(0, i - k), np.minimum(n, i + k + 1))
        while (low < high).any():
            k = (low + high) // 2
            a, b = ends(k)
            enough = (total[b] - total[a] >= least) | ((a == 0) & (b == n))
            low, high = np.where(enough, low, k + 1), np.where(enough, k, high)
        a, b = ends(high)
        with np.errstate(invalid="ignore", divide="ignore"):
            out = np.where(possible[b] > possible[a], (total[b] - total[a]) / (possible[b] - possible[a]), np.nan)
        return pd.DataFrame({"chromosome": pdf.chromosome, "distance": pdf.distance, "expected": out})

    return expected.groupBy("chromosome").applyInPandas(grow, f"chromosome {kind}, distance long, expected double")
