"""A contact matrix as one object: regions, edges and biases with the operators as methods.

Nothing is computed until a result is read. Methods that change the matrix return a new one; adding single edges
or pairs gathers them on the driver (they were there already) until flush() or the next use.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.sequences import parse_region
from . import balance, intervals, masks, matrix

EDGE = "source long, sink long, weight double"


def as_edge(edge: object) -> tuple[int, int, float]:
    """(source, sink, weight) from a tuple or list of two or three, a mapping, or an object with these names; ends in order."""
    if isinstance(edge, Mapping):
        a, b, w = edge["source"], edge["sink"], edge.get("weight", 1.0)
    elif hasattr(edge, "source"):
        a, b, w = edge.source, edge.sink, getattr(edge, "weight", 1.0)
    else:
        a, b, w = (*edge, 1.0)[:3]
    return min(int(a), int(b)), max(int(a), int(b)), float(w)


@dataclass
class ContactMatrix:
    """regions: (ix, chromosome, start, end[, bias, ..]); edges: (source, sink, weight), raw."""

    regions: DataFrame
    edges: DataFrame
    waiting: list[tuple[int, int, float]] = field(default_factory=list)

    @property
    def spark(self) -> SparkSession:
        return self.regions.sparkSession

    @classmethod
    def empty(cls, regions: DataFrame) -> ContactMatrix:
        return cls(regions, regions.sparkSession.createDataFrame([], EDGE))

    # What is in it ---------------------------------------------------------------------------------
    def add_edge(self, edge: object) -> None:
        self.waiting.append(as_edge(edge))

    def add_edges(self, edges: DataFrame | Iterable[object]) -> None:
        if isinstance(edges, DataFrame):
            rows = edges.select(F.least("source", "sink").alias("source"), F.greatest("source", "sink").alias("sink"), F.col("weight").cast("double").alias("weight"))
            self.edges = matrix.merge(self.edges, rows)
        else:
            self.waiting += map(as_edge, edges)

    def add_read_pairs(self, pairs: DataFrame) -> None:
        """Pairs (left_chromosome, left_position, right_chromosome, right_position), each of which counts one."""
        rows = pairs
        for side, end in (("left", "source"), ("right", "sink")):
            at = rows.withColumn("chromosome", F.col(f"{side}_chromosome"))
            rows = intervals.locate(at, self.regions, f"{side}_position").withColumnRenamed("ix", end).drop("chromosome")
        self.add_edges(matrix.edges_from_pairs(rows))

    def flush(self) -> ContactMatrix:
        """Edges that were added one by one join the others; weights of equal edges are summed."""
        if self.waiting:
            self.edges = matrix.merge(self.edges, self.spark.createDataFrame(self.waiting, EDGE))
            self.waiting = []
        return self

    def add_regions(self, regions: DataFrame) -> ContactMatrix:
        """More regions (chromosome, start, end), numbered after those that are there."""
        first = self.regions.agg(F.coalesce(F.max("ix") + 1, F.lit(0)).alias("_n"))
        more = intervals.numbered(regions, "chromosome", "start", name="ix").crossJoin(first).withColumn("ix", F.col("ix") + F.col("_n")).drop("_n")  # one row
        return replace(self, regions=self.regions.unionByName(more, allowMissingColumns=True))

    def update_edges(self, new: Column | Callable[[Column], Column], where: Column | None = None) -> ContactMatrix:
        """Weights become ``new`` (a column, or a function of the weight) where the condition holds."""
        value = new(F.col("weight")) if callable(new) and not isinstance(new, Column) else new
        rows = self.flush().edges
        return replace(self, edges=rows.withColumn("weight", value if where is None else F.when(where, value).otherwise(F.col("weight"))))

    def region_data(self, name: str, values: Mapping[int, object] | list | DataFrame | None = None) -> DataFrame | ContactMatrix:
        """(ix, name) of the regions; with values (by ix, or for all in order, or a table ix, name) a matrix that has them."""
        if values is None:
            return self.regions.select("ix", name)
        if not isinstance(values, DataFrame):
            pairs = sorted(values.items()) if isinstance(values, Mapping) else list(zip([r.ix for r in self.regions.select("ix").orderBy("ix").collect()], values, strict=True))
            kind = "string" if any(isinstance(v, str) for _, v in pairs) else "double"
            values = self.spark.createDataFrame([(int(i), v if kind == "string" or v is None else float(v)) for i, v in pairs], f"ix long, `{name}` {kind}")
        return replace(self, regions=self.regions.drop(name).join(values, "ix", "left"))

    def bias_vector(self) -> np.ndarray:
        """Biases in the order of the regions, one number each; 1 where there is none."""
        own = F.coalesce(F.col("bias"), F.lit(1.0)) if "bias" in self.regions.columns else F.lit(1.0)
        got = self.regions.select("ix", own.alias("bias")).toArrow()
        return got.column("bias").to_numpy()[np.argsort(got.column("ix").to_numpy())]

    def set_biases(self, values: Mapping[int, float] | list | np.ndarray | DataFrame) -> ContactMatrix:
        return self.region_data("bias", values.tolist() if isinstance(values, np.ndarray) else values)

    def copy(self, bias: bool = True, inter: bool = True) -> ContactMatrix:
        """The same matrix, without biases or without edges between chromosomes if so asked."""
        edges = self.flush().edges
        if not inter:
            edges = matrix.with_ends(edges, self.regions, "chromosome").where("source_chromosome = sink_chromosome").select("source", "sink", "weight")
        return ContactMatrix(self.regions if bias else self.regions.drop("bias"), edges)

    # Geometry --------------------------------------------------------------------------------------
    def bin_size(self) -> int:
        return int(self.regions.agg(F.max(F.col("end") - F.col("start") + 1)).first()[0])

    def bins_to_distance(self, bins: int) -> int:
        return bins * self.bin_size()

    def distance_to_bins(self, bp: int) -> int:
        return math.ceil(bp / self.bin_size())

    def part(self, region: str) -> DataFrame:
        """The regions that a region string such as ``chr1:1mb-2mb`` touches."""
        name, start, end, _ = parse_region(region)
        rows = self.regions.where(F.col("chromosome") == name)
        return rows.where((F.col("end") >= (start or 1)) & (F.col("start") <= (end or 1 << 62)))

    def within(self, region: str) -> ContactMatrix:
        """The matrix of a region alone."""
        own = self.part(region)
        edges = self.flush().edges
        for end in ("source", "sink"):
            edges = edges.join(own.select(F.col("ix").alias(end)), end, "left_semi")
        return ContactMatrix(own, edges.select("source", "sink", "weight"))

    def valid(self) -> DataFrame:
        return matrix.valid_regions(self.flush().edges, self.regions)

    # Results ---------------------------------------------------------------------------------------
    def normalised(self) -> DataFrame:
        own = F.coalesce(F.col("bias"), F.lit(1.0)) if "bias" in self.regions.columns else F.lit(1.0)
        return matrix.normalised(self.flush().edges, self.regions.select("ix", own.alias("bias")))

    def normalise(self, method: str = "kr", **how: object) -> ContactMatrix:
        bias = balance.normalise(self.flush().edges, method, **how)
        return replace(self, regions=self.regions.drop("bias").join(bias, "ix", "left").fillna(0.0, ["bias"]))

    def marginals(self, norm: bool = True) -> DataFrame:
        return matrix.marginals(self.normalised() if norm else self.flush().edges, self.regions)

    def possible_contacts(self, region: str | None = None) -> DataFrame:
        """Possible contacts by distance, of the whole matrix or of a region alone."""
        valid = self.valid()
        return matrix.possible_contacts(valid if region is None else valid.join(self.part(region).select("ix"), "ix", "left_semi"))

    def expected(self, region: str | None = None, norm: bool = True) -> DataFrame:
        """Expected values by distance, of the whole matrix or of a region's own edges and bins."""
        valid, edges = self.valid(), self.normalised() if norm else self.flush().edges
        if region is not None:
            own = self.part(region).select("ix")
            valid = valid.join(own, "ix", "left_semi")
            for end in ("source", "sink"):
                edges = edges.join(own.withColumnRenamed("ix", end), end, "left_semi")
        return matrix.expected(edges, valid)

    def oe(self, norm: bool = True) -> DataFrame:
        return matrix.observed_expected(self.normalised() if norm else self.flush().edges, self.valid())

    def enriched(self, least: float, norm: bool = True) -> DataFrame:
        """Cis edges with O/E of at least ``least``."""
        return self.oe(norm).where(F.col("oe") >= least)

    def filtered(self, **filters: Column) -> tuple[ContactMatrix, DataFrame]:
        """The matrix of the edges that all conditions keep, and (name, n) of what each took."""
        rows, bits = masks.apply_filters(self.flush().edges, filters)
        return replace(self, edges=masks.visible(rows).drop(masks.MASK)), masks.statistics(rows, bits)

    def rebinned(self, factor: int, policy: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> ContactMatrix:
        """Bins of ``factor`` old ones within each chromosome; policy(edges, (ix, new_ix)) says how weights move, by default with their bins."""
        own = matrix.chromosome_range(self.regions).withColumn("_k", F.floor((F.col("ix") - F.col("_first")) / factor))
        new = own.groupBy("chromosome", "_k").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("ix").alias("_at"))
        new = intervals.numbered(new, "_at", name="ix")
        to = own.select(F.col("ix").alias("old"), "chromosome", "_k").join(new.select("chromosome", "_k", F.col("ix").alias("new_ix")), ["chromosome", "_k"]).select(F.col("old").alias("ix"), "new_ix")
        edges = self.flush().edges
        return ContactMatrix(new.select("ix", "chromosome", "start", "end"), policy(edges, to) if policy else matrix.rebin_nested(edges, factor, to))

    def statistic(self, f: Callable[[Column], Column], by: Column | None = None, norm: bool = True) -> DataFrame:
        """Any aggregate of the weights, such as F.stddev, of all edges or by a column of (source, sink)."""
        rows = self.normalised() if norm else self.flush().edges
        return rows.agg(f(F.col("weight")).alias("value")) if by is None else rows.groupBy(by.alias("key")).agg(f(F.col("weight")).alias("value"))

    def sorted(self, ascending: bool = False, by: str = "weight") -> DataFrame:
        """Edges (or peaks) in the order of a column, then of their bins."""
        return self.flush().edges.orderBy(F.col(by).asc() if ascending else F.col(by).desc(), "source", "sink")

    def dense(self, most: int = 5000) -> np.ndarray:
        """The normalised matrix of at most ``most`` regions, symmetric; bins of bias 0 are NaN."""
        ix = sorted(r.ix for r in self.regions.select("ix").limit(most + 1).collect())
        if len(ix) > most:
            raise ValueError(f"more than {most} regions; take a part with within()")
        at, out = {x: k for k, x in enumerate(ix)}, np.zeros((len(ix), len(ix)))
        for r in self.normalised().toLocalIterator():
            i, j = at[r.source], at[r.sink]
            out[i, j] = out[j, i] = r.weight
        gone = self.bias_vector() == 0
        out[gone, :] = out[:, gone] = np.nan
        return out


def without_sparse_rows(m: np.ndarray, cutoff: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A dense matrix without rows and columns whose sum is at most the cutoff (by default the smallest sum), and their numbers."""
    total = m.sum(axis=0)
    gone = np.flatnonzero(total <= (total.min() if cutoff is None else cutoff))
    keep = np.setdiff1d(np.arange(len(m)), gone)
    return m[np.ix_(keep, keep)], gone


def with_sparse_rows(m: np.ndarray, gone: list[np.ndarray]) -> np.ndarray:
    """Zero rows and columns back where each removal, the last one first, took them."""
    for g in reversed(gone):
        keep = np.setdiff1d(np.arange(len(m) + len(g)), g)
        out = np.zeros((len(m) + len(g),) * 2)
        out[np.ix_(keep, keep)] = m
        m = out
    return m


def is_symmetric(m: np.ndarray, tolerance: float = 1e-10) -> bool:
    return m.ndim == 2 and m.shape[0] == m.shape[1] and bool(np.allclose(m, m.T, atol=tolerance, rtol=0, equal_nan=True))
