"""Contact matrices: regions (ix, chromosome, start, end[, bias]) and edges (source <= sink, weight).

Region tables are dimensions (one row per bin); edges are the facts. Joins against regions are left to
Catalyst, which broadcasts them while they are small and shuffles them when they are not.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def edges_from_pairs(pairs: DataFrame, source: str = "source", sink: str = "sink", tasks: int | None = None) -> DataFrame:
    """Counts of pairs per unordered pair of bins, in so many partitions by both bins if ``tasks`` is given.

    Nearly all pairs differ, so pairs that are dealt out first cost less than counts made on both sides of the exchange.
    """
    s, t = F.least(source, sink).alias("source"), F.greatest(source, sink).alias("sink")
    pairs = pairs.select(s, t)
    if tasks is not None:
        pairs = pairs.repartition(tasks, "source", "sink")
    return pairs.groupBy("source", "sink").agg(F.count("*").alias("weight"))


def merge(*edges: DataFrame) -> DataFrame:
    """The sum of matrices over the same regions."""
    rows = edges[0].select("source", "sink", "weight")
    for e in edges[1:]:
        rows = rows.unionByName(e.select("source", "sink", "weight"))
    return rows.groupBy("source", "sink").agg(F.sum("weight").alias("weight"))


def subset_edges(edges: DataFrame, rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
    """Edges of a block of bins (half-open ranges), in either orientation, each once."""
    inside = lambda c, r: (F.col(c) >= r[0]) & (F.col(c) < r[1])
    return edges.where((inside("source", rows) & inside("sink", columns)) | (inside("source", columns) & inside("sink", rows)))


def both_ways(edges: DataFrame, value: str = "weight") -> DataFrame:
    """(bin, other, value): each edge from both of its ends, the diagonal once."""
    ends = F.when(F.col("source") == F.col("sink"), F.array(F.struct(F.col("source").alias("bin"), F.col("sink").alias("other"))))
    ends = ends.otherwise(F.array(F.struct(F.col("source").alias("bin"), F.col("sink").alias("other")), F.struct(F.col("sink").alias("bin"), F.col("source").alias("other"))))
    return edges.select(F.explode(ends).alias("x"), value).select("x.bin", "x.other", value)


def marginals(edges: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """(ix, marginal): sums of rows, the diagonal once; bins without edges have 0 if regions are given."""
    out = both_ways(edges).groupBy(F.col("bin").alias("ix")).agg(F.sum("weight").alias("marginal"))
    return out if regions is None else regions.select("ix").join(out, "ix", "left").select("ix", F.coalesce("marginal", F.lit(0)).alias("marginal"))


def valid_regions(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """Adds valid: some edge of non-zero weight touches the region."""
    seen = both_ways(edges.where("weight <> 0")).select(F.col("bin").alias("ix"), F.lit(True).alias("valid")).distinct()
    return regions.drop("valid").join(seen, "ix", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def with_ends(edges: DataFrame, regions: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
    """Edges with columns of both regions, as source_x and sink_x."""
    for end in ("source", "sink"):
        edges = edges.join(regions.select(F.col("ix").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns]), end, how)
    return edges


def normalised(edges: DataFrame, bias: DataFrame) -> DataFrame:
    """weight * bias[source] * bias[sink]."""
    rows = with_ends(edges, bias, "bias")
    return rows.withColumn("weight", F.col("weight") * F.col("source_bias") * F.col("sink_bias")).drop("source_bias", "sink_bias")


def possible_contacts(regions: DataFrame) -> DataFrame:
    """(chromosome, distance, possible): pairs of valid bins of a chromosome by their distance in bins.

    That is the autocorrelation of the chromosome's row of valid bins, found by Fourier transform: a task holds one
    number for each bin of a chromosome, and its work grows a little faster than they do.
    """
    kind = regions.schema["chromosome"].dataType.simpleString()

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        ix = pdf.ix.to_numpy(dtype=np.int64)
        row = np.zeros(int(ix.max() - ix.min()) + 1)
        row[ix - ix.min()] = 1
        size = 1 << (2 * len(row) - 1).bit_length()
        f = np.fft.rfft(row, size)
        n = np.rint(np.fft.irfft(f * f.conj(), size)[: len(row)]).astype(np.int64)
        d = np.flatnonzero(n)
        return pd.DataFrame({"chromosome": pdf.chromosome.iloc[0], "distance": d, "possible": n[d]})

    rows = regions.where("valid").select("chromosome", F.col("ix").cast("long").alias("ix"))
    return rows.groupBy("chromosome").applyInPandas(count, f"chromosome {kind}, distance long, possible long")


def expected(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """(chromosome, distance, possible, total, expected): mean weight by distance; chromosome null is the genome's vector."""
    possible = possible_contacts(regions)
    possible = possible.unionByName(possible.groupBy("distance").agg(F.sum("possible").alias("possible")).select(F.lit(None).cast(regions.schema["chromosome"].dataType).alias("chromosome"), "distance", "possible"))
    cis = with_ends(edges, regions, "chromosome").where("source_chromosome = sink_chromosome")
    cis = cis.select(F.col("source_chromosome").alias("chromosome"), (F.col("sink") - F.col("source")).alias("distance"), "weight")
    total = cis.groupBy("chromosome", "distance").agg(F.sum("weight").alias("total"))
    total = total.unionByName(total.groupBy("distance").agg(F.sum("total").alias("total")).select(F.lit(None).cast(regions.schema["chromosome"].dataType).alias("chromosome"), "distance", "total"))
    t = total.select(F.col("chromosome").alias("_c"), F.col("distance").alias("_d"), "total")
    rows = possible.join(t, F.col("chromosome").eqNullSafe(F.col("_c")) & (F.col("distance") == F.col("_d")), "left")
    return rows.select("chromosome", "distance", "possible", F.coalesce("total", F.lit(0)).alias("total"), (F.coalesce("total", F.lit(0)) / F.col("possible")).alias("expected"))


def expected_inter(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """(possible, total, expected) between chromosomes."""
    n = regions.where("valid").groupBy("chromosome").count()
    sums = n.agg(((F.pow(F.sum("count"), 2) - F.sum(F.pow(F.col("count"), 2))) / 2).cast("long").alias("possible"))
    trans = with_ends(edges, regions, "chromosome").where("source_chromosome <> sink_chromosome").agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("total"))
    return sums.crossJoin(trans).withColumn("expected", F.col("total") / F.nullif(F.col("possible"), F.lit(0)))  # one row each


def observed_expected(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """Cis edges with expected and oe = weight / expected of their chromosome's distance."""
    e = expected(edges, regions).where("chromosome is not null").select(F.col("chromosome").alias("source_chromosome"), "distance", "expected")
    cis = with_ends(edges, regions, "chromosome").where("source_chromosome = sink_chromosome").withColumn("distance", F.col("sink") - F.col("source"))
    rows = cis.join(e, ["source_chromosome", "distance"])
    return rows.select(F.col("source_chromosome").alias("chromosome"), "source", "sink", "distance", "weight", "expected", (F.col("weight") / F.nullif(F.col("expected"), F.lit(0.0))).alias("oe"))


def cis_trans(edges: DataFrame, regions: DataFrame, normalise: bool = False) -> DataFrame:
    """(cis, trans, ratio): cis / (cis + f * trans); f is possible cis over possible trans contacts if normalised, else 1."""
    rows = with_ends(edges, regions, "chromosome")
    same = F.col("source_chromosome") == F.col("sink_chromosome")
    out = rows.agg(F.sum(F.when(same, F.col("weight")).otherwise(0)).alias("cis"), F.sum(F.when(~same, F.col("weight")).otherwise(0)).alias("trans"))
    f = F.lit(1.0)
    if normalise:
        n = regions.where("valid").groupBy("chromosome").count()
        s = n.agg(F.sum(F.col("count") * (F.col("count") + 1) / 2).alias("_cis"), ((F.pow(F.sum("count"), 2) - F.sum(F.pow(F.col("count"), 2))) / 2).alias("_trans"))
        out, f = out.crossJoin(s), F.col("_cis") / F.col("_trans")
    return out.select("cis", "trans", (F.col("cis") / (F.col("cis") + f * F.col("trans"))).alias("ratio"))


def scaling_factor(one: DataFrame, other: DataFrame) -> DataFrame:
    """(factor): what other's weights are multiplied by to have one's total."""
    a, b = one.agg(F.sum("weight").alias("a")), other.agg(F.sum("weight").alias("b"))
    return a.crossJoin(b).select((F.col("a") / F.nullif(F.col("b"), F.lit(0))).alias("factor"))  # one row each


def near_diagonal(distance: int) -> Column:
    """Keeps edges farther than distance bins from the diagonal."""
    return F.abs(F.col("source") - F.col("sink")) > distance


def low_coverage(edges: DataFrame, cutoff: float | None = None, relative: float | None = None) -> DataFrame:
    """Edges both of whose bins reach the cut-off; relative is a share of the median positive marginal; with both, the lower counts."""
    m = marginals(edges)
    limit = [F.lit(cutoff)] if cutoff is not None else []
    if relative is not None:
        m = m.crossJoin(m.where("marginal > 0").agg((F.percentile("marginal", F.lit(0.5)) * relative).alias("_limit")))  # one row
        limit.append(F.col("_limit"))
    m = m.where(F.col("marginal") >= (limit[0] if len(limit) == 1 else F.least(*limit))).select("ix")
    for end in ("source", "sink"):
        edges = edges.join(m.select(F.col("ix").alias(end)), end, "left_semi")
    return edges


def _summed(rows: DataFrame, tasks: int | None) -> DataFrame:
    """Sums of weights by source and sink, in so many partitions by them if ``tasks`` is given."""
    if tasks is not None:
        rows = rows.repartition(tasks, "source", "sink")
    return rows.groupBy("source", "sink").agg(F.sum("weight").alias("weight"))


def rebin_nested(edges: DataFrame, factor: int, regions: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Larger bins of ``factor`` old ones each; with regions (ix, new_ix) the nesting is theirs."""
    if regions is not None:
        rows = with_ends(edges, regions, "new_ix").select(F.col("source_new_ix").alias("source"), F.col("sink_new_ix").alias("sink"), "weight")
    else:
        rows = edges.select(F.floor(F.col("source") / factor).alias("source"), F.floor(F.col("sink") / factor).alias("sink"), "weight")
    return _summed(rows, tasks)


def rebin_split(edges: DataFrame, overlap: DataFrame, tasks: int | None = None) -> DataFrame:
    """Distributes whole weights to the first and last new bin that each end overlaps.

    overlap: (ix, first, last). The one to four different target pairs, in order, get weight div n each, and the
    first weight mod n of them one more, so the total is kept.
    """
    rows = with_ends(edges, overlap, "first", "last")
    pair = lambda a, b: F.struct(F.least(a, b).alias("source"), F.greatest(a, b).alias("sink"))
    targets = F.array_sort(F.array_distinct(F.array(*[pair(f"source_{x}", f"sink_{y}") for x in ("first", "last") for y in ("first", "last")])))
    rows = rows.withColumn("_t", targets).select("weight", F.size("_t").alias("_n"), F.posexplode("_t").alias("_i", "_x"))
    part = F.expr("weight div _n") + F.when(F.col("_i") < F.col("weight") % F.col("_n"), 1).otherwise(0)
    return _summed(rows.select("_x.*", part.alias("weight")).where("weight > 0"), tasks)


def downsample(edges: DataFrame, n: float | DataFrame, seed: int = 0) -> DataFrame:
    """n contacts drawn without replacement: all contacts are put in the order of a hash and the first n stay.

    n below 1 is a share of all contacts; another matrix stands for its total. The hash order is cut by
    thresholds found on counts per hash range, so no global sort is needed.
    """
    if isinstance(n, DataFrame):
        n = n.agg(F.sum("weight")).first()[0] or 0
    if 0 < n < 1:
        n = int(n * (edges.agg(F.sum("weight")).first()[0] or 0))
    n = int(n)
    rows = edges.select("source", "sink", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))).alias("i"))
    digest = F.md5(F.concat_ws("|", "source", "sink", "i", F.lit(seed)).cast("binary"))
    rows = rows.withColumn("h", F.conv(F.substring(digest, 1, 10), 16, 10).cast("long"))
    w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # 4096 ranges
    ranges = rows.groupBy(F.shiftright("h", 28).alias("b")).count().withColumn("before", F.coalesce(F.sum("count").over(w), F.lit(0)))
    inside = rows.withColumn("b", F.shiftright("h", 28)).join(ranges.where(F.col("before") < n), "b")
    at = Window.partitionBy("b").orderBy("h", "source", "sink", "i")
    kept = inside.withColumn("_r", F.when(F.col("before") + F.col("count") <= n, 0).otherwise(F.row_number().over(at) + F.col("before")))
    return kept.where(F.col("_r") <= n).groupBy("source", "sink").agg(F.count("*").alias("weight"))


def split_matrix(upper: DataFrame, lower: DataFrame, factor: float = 1.0) -> DataFrame:
    """(i, j, weight): the upper triangle with the diagonal from one matrix, the lower one from another, scaled."""
    a = upper.select(F.col("source").alias("i"), F.col("sink").alias("j"), F.col("weight").cast("double").alias("weight"))
    b = lower.where("source < sink").select(F.col("sink").alias("i"), F.col("source").alias("j"), (F.col("weight") * factor).alias("weight"))
    return a.unionByName(b)


def chromosome_range(regions: DataFrame) -> DataFrame:
    """Adds _first (the chromosome's first ix) and _size (its number of bins)."""
    w = Window.partitionBy("chromosome")
    return regions.withColumn("_first", F.min("ix").over(w)).withColumn("_size", F.count("*").over(w))


def regions_identical(one: DataFrame, other: DataFrame) -> bool:
    """Whether two region tables hold the same (ix, chromosome, start, end)."""
    a, b = (r.select("ix", "chromosome", "start", "end") for r in (one, other))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def zoom_levels(edges: DataFrame, levels: int, tasks: int | None = None) -> DataFrame:
    """(level, source, sink, weight): the matrix at bins of 1, 2, 4, .. old ones, each level from the one below."""
    at = edges.select("source", "sink", "weight")
    out = at.select(F.lit(0).cast("long").alias("level"), "*")
    for k in range(1, levels):
        at = rebin_nested(at, 2, tasks=tasks)
        out = out.unionByName(at.select(F.lit(k).cast("long").alias("level"), "*"))
    return out


def above_background(edges: DataFrame, regions: DataFrame, fold: float) -> DataFrame:
    """Edges with at least ``fold`` times the mean contact between chromosomes, which stands for random ligation."""
    return edges.crossJoin(expected_inter(edges, regions).select((F.col("expected") * fold).alias("_cut"))).where("weight >= _cut").drop("_cut")  # one row
