"""Compartments: row correlation of a chromosome's dense O/E matrix, its eigenvectors, and A/B calls.

A chromosome is one group and one dense matrix in one task; its size is that of its bins squared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def _correlation(cells: pd.DataFrame, ix: np.ndarray) -> np.ndarray:
    m = np.ones((len(ix), len(ix)))
    cells = cells[cells.oe.notna()]
    i, j = (np.searchsorted(ix, cells[end].to_numpy(dtype=np.int64)) for end in ("source", "sink"))
    m[i, j] = m[j, i] = cells.oe.to_numpy()
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.atleast_2d(np.corrcoef(m))


def _per_chromosome(oe: DataFrame, regions: DataFrame, run, shape: str, *columns: str) -> DataFrame:  # noqa: ANN001
    """run(cells, bins) for each chromosome of regions, which may hold no cells; bins are in order of ix."""
    kind = regions.schema["chromosome"].dataType.simpleString()

    def one(cells: pd.DataFrame, bins: pd.DataFrame) -> pd.DataFrame:
        if not len(bins):
            return pd.DataFrame({}, columns=["chromosome", *names])
        out = run(cells, bins.sort_values("ix"))
        out.insert(0, "chromosome", [bins.chromosome.iloc[0]] * len(out))
        return out

    names = [x.split()[0] for x in shape.split(", ")]
    cells, bins = oe.select("chromosome", "source", "sink", "oe"), regions.select("chromosome", F.col("ix").cast("long").alias("ix"), *columns)
    return cells.groupBy("chromosome").cogroup(bins.groupBy("chromosome")).applyInPandas(one, f"chromosome {kind}, {shape}")


def correlation(oe: DataFrame, regions: DataFrame) -> DataFrame:
    """(chromosome, source, sink, r): correlation of the rows of each chromosome's O/E matrix; absent cells are 1, rows of one value give NaN."""

    def run(cells: pd.DataFrame, bins: pd.DataFrame) -> pd.DataFrame:
        ix = bins.ix.to_numpy()
        i, j = np.triu_indices(len(ix))
        return pd.DataFrame({"source": ix[i], "sink": ix[j], "r": _correlation(cells, ix)[i, j]})

    out = _per_chromosome(oe, regions, run, "source long, sink long, r double")
    return out.withColumn("r", F.coalesce("r", F.lit(float("nan"))))  # pandas gives NaN as null


def eigenvector(oe: DataFrame, regions: DataFrame, k: int = 0, guide: str | None = None) -> DataFrame:
    """(chromosome, ix, score): the eigenvector of the k-th largest absolute eigenvalue of the correlation matrix.

    Its sign makes the mean of regions' column ``guide`` (such as GC content) larger where the score is
    positive; without a guide the sum is not negative. Chromosomes without cells have none.
    """

    def run(cells: pd.DataFrame, bins: pd.DataFrame) -> pd.DataFrame:
        if not len(cells):
            return pd.DataFrame({"ix": [], "score": []})
        ix = bins.ix.to_numpy()
        values, vectors = np.linalg.eigh(np.nan_to_num(_correlation(cells, ix), nan=0.0))
        v = vectors[:, np.argsort(-np.abs(values), kind="stable")[min(k, len(ix) - 1)]]
        if guide:
            g = bins[guide].to_numpy(dtype=float)
            up, down = g[v >= 0], g[v < 0]
            flip = up.size and down.size and np.nanmean(up) < np.nanmean(down)
        else:
            flip = v.sum() < 0
        return pd.DataFrame({"ix": ix, "score": -v if flip else v})

    return _per_chromosome(oe, regions, run, "ix long, score double", *([guide] if guide else []))


def compartments(track: DataFrame) -> DataFrame:
    """Adds compartment: A where the score is not negative, else B."""
    return track.withColumn("compartment", F.when(F.col("score") >= 0, "A").otherwise("B"))


def strength(saddle: DataFrame, groups: int) -> DataFrame:
    """(strength): ln(AA * BB / AB ** 2) from a saddle's corners."""
    corner = lambda a, b: F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col("value")))
    s = saddle.agg(corner(groups - 1, groups - 1).alias("_aa"), corner(0, 0).alias("_bb"), corner(groups - 1, 0).alias("_ab"))
    ratio = F.col("_aa") * F.col("_bb") / F.nullif(F.col("_ab") * F.col("_ab"), F.lit(0.0))
    return s.select(F.when(ratio > 0, F.ln(ratio)).alias("strength"))
