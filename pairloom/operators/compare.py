"""Comparisons of matrices and tracks, collections of edges over samples, and their components."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def fold_change(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def difference(a: Column, b: Column) -> Column:
    return a - b


def compare_matrices(one: DataFrame, other: DataFrame, compare: Callable[[Column, Column], Column] = fold_change, factor: float = 1.0, default: float = 0.0, log: bool = False, ignore_zeros: bool = False) -> DataFrame:
    """(source, sink, weight): compare(one, factor * other) over the edges of either; missing ones have the default; undefined results go."""
    a = one.select("source", "sink", F.col("weight").cast("double").alias("_a"))
    b = other.select("source", "sink", (F.col("weight") * factor).cast("double").alias("_b"))
    rows = a.join(b, ["source", "sink"], "full_outer")
    rows = rows.withColumn("_a", F.coalesce("_a", F.lit(default))).withColumn("_b", F.coalesce("_b", F.lit(default)))
    if ignore_zeros:
        rows = rows.where("_a <> 0 and _b <> 0")
    value = compare(F.col("_a"), F.col("_b"))
    value = F.when(value > 0, F.log2(value)) if log else value
    return rows.select("source", "sink", value.alias("weight")).where("weight is not null")


def compare_scores(one: DataFrame, other: DataFrame, compare: Callable[[Column, Column], Column] = difference, on: tuple[str, ...] = ("ix",), log: bool = False) -> DataFrame:
    """Inner join of two tracks on their regions (and parameter columns)."""
    rows = one.select(*on, F.col("score").alias("_a")).join(other.select(*on, F.col("score").alias("_b")), list(on))
    value = compare(F.col("_a"), F.col("_b"))
    return rows.select(*on, (F.when(value > 0, F.log2(value)) if log else value).alias("score"))


def collect_edges(samples: Mapping[str, DataFrame]) -> DataFrame:
    """(source, sink, one column per sample): outer join of all samples' edges, absent ones 0, in one shuffle."""
    rows = None
    for name, e in samples.items():
        part = e.select("source", "sink", F.lit(name).alias("_s"), F.col("weight").cast("double").alias("_w"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("source", "sink").agg(*[F.sum(F.when(F.col("_s") == n, F.col("_w")).otherwise(0.0)).alias(n) for n in samples])


def keep_edges(edges: DataFrame, samples: list[str], nonzero: bool = False, absolute: float | None = None, least: int = 0, least_distance: int | None = None, most_distance: int | None = None) -> DataFrame:
    """Filters over the vector of weights: all non-zero; at least ``least`` samples at or above ``absolute``; distance bounds."""
    w = F.array(*samples)
    if nonzero:
        edges = edges.where(F.forall(w, lambda x: x != 0))
    if absolute is not None:
        edges = edges.where(F.size(F.filter(w, lambda x: x >= absolute)) >= least)
    d = F.col("sink") - F.col("source")
    if least_distance is not None:
        edges = edges.where(d >= least_distance)
    return edges if most_distance is None else edges.where(d <= most_distance)


def _vector_mean(samples: list[str]) -> Column:
    return sum((F.col(s) for s in samples[1:]), F.col(samples[0])) / len(samples)


def top_by_variance(edges: DataFrame, samples: list[str], n: int) -> DataFrame:
    mean = _vector_mean(samples)
    var = sum(((F.col(s) - mean) * (F.col(s) - mean) for s in samples[1:]), (F.col(samples[0]) - mean) * (F.col(samples[0]) - mean)) / len(samples)
    return edges.withColumn("variance", var).orderBy(F.desc("variance"), "source", "sink").limit(n)


def top_by_fold_change(edges: DataFrame, samples: list[str], n: int) -> DataFrame:
    ratio = F.greatest(*samples) / F.nullif(F.least(*samples), F.lit(0.0))
    return edges.withColumn("fold_change", ratio).where("fold_change is not null").orderBy(F.desc("fold_change"), "source", "sink").limit(n)


def gram(edges: DataFrame, samples: list[str]) -> DataFrame:
    """(a, b, value): inner products of the samples' vectors, each edge centred over the samples."""
    rows = edges.withColumn("_m", _vector_mean(samples))
    sums = [F.sum((F.col(x) - F.col("_m")) * (F.col(y) - F.col("_m"))).alias(f"{x}|{y}") for i, x in enumerate(samples) for y in samples[i:]]
    one = rows.agg(*sums)
    cells = [F.struct(F.lit(c.split("|")[0]).alias("a"), F.lit(c.split("|")[1]).alias("b"), F.col(f"`{c}`").alias("value")) for c in one.columns]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def principal_components(edges: DataFrame, samples: list[str], n: int = 2) -> DataFrame:
    """(sample, component, value, explained): from the Gram matrix, which is samples x samples; each component's largest value is positive."""
    g = np.zeros((len(samples), len(samples)))
    for r in gram(edges, samples).collect():
        i, j = samples.index(r.a), samples.index(r.b)
        g[i, j] = g[j, i] = r.value
    values, vectors = np.linalg.eigh(g)
    order = np.argsort(values)[::-1][:n]
    rows = []
    for k, o in enumerate(order):
        v = vectors[:, o] * np.sign(vectors[np.argmax(np.abs(vectors[:, o])), o]) * np.sqrt(max(values[o], 0))
        rows += [(s, k, float(x), float(values[o] / max(values.sum(), 1e-300))) for s, x in zip(samples, v, strict=True)]
    return edges.sparkSession.createDataFrame(rows, "sample string, component int, value double, explained double")
