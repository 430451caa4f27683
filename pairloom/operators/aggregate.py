"""Pile-ups: mean sub-matrices around anchors, loops, domains; saddles; virtual 4C; profiles around anchors.

Windows meet edges by equi-joins on bins: a window names its rows, so no range join is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .matrix import both_ways, chromosome_range
from .ordering import numbered


def cells(windows: DataFrame, edges: DataFrame, regions: DataFrame, w: int, value: str = "weight", default: float = 0.0) -> DataFrame:
    """(id, i, j, value): the (2w+1)**2 cells of windows (id, row, column) whose bins all lie in their centre's chromosomes.

    Cells of invalid bins are left out; cells without an edge have the default.
    """
    r = chromosome_range(regions.select("ix", "chromosome", "valid"))
    for end in ("row", "column"):
        c = r.select(F.col("ix").alias(end), F.col("_first").alias("_f"), F.col("_size").alias("_n"))
        windows = windows.join(c, end).where((F.col(end) - w >= F.col("_f")) & (F.col(end) + w < F.col("_f") + F.col("_n"))).drop("_f", "_n")
    span = F.sequence(F.lit(-w), F.lit(w))
    rows = windows.select("id", "row", "column", F.explode(span).alias("i")).select("id", "row", "column", "i", F.explode(span).alias("j"))
    rows = rows.select("id", "i", "j", (F.col("row") + F.col("i")).alias("bin"), (F.col("column") + F.col("j")).alias("other"))
    ok = r.where("valid").select("ix")
    rows = rows.join(ok.withColumnRenamed("ix", "bin"), "bin", "left_semi").join(ok.withColumnRenamed("ix", "other"), "other", "left_semi")
    e = both_ways(edges, value)
    return rows.join(e, ["bin", "other"], "left").select("id", "i", "j", F.coalesce(F.col(value).cast("double"), F.lit(default)).alias("value"))


def pile_up(windows: DataFrame, edges: DataFrame, regions: DataFrame, w: int, value: str = "weight", default: float = 0.0) -> DataFrame:
    """(i, j, value, n): the mean over the windows of each cell."""
    return cells(windows, edges, regions, w, value, default).groupBy("i", "j").agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def loop_strength(loops: DataFrame, edges: DataFrame, regions: DataFrame, w: int, value: str = "oe", default: float = 1.0) -> DataFrame:
    """(id, strength): log2 of a loop window's mean over that of its two controls, shifted along the diagonal by the loop's length.

    loops: (id, row, column), row < column. One control may be missing.
    """
    length = F.col("column") - F.col("row")
    shifted = [F.struct(F.lit(k).alias("k"), (F.col("row") + k * length).alias("row"), (F.col("column") + k * length).alias("column")) for k in (-1, 0, 1)]
    c = chromosome_range(regions.select("ix", "chromosome")).select(F.col("ix"), F.col("chromosome"))
    home = loops.join(c.select(F.col("ix").alias("row"), F.col("chromosome").alias("home")), "row")
    all_ = home.select("id", "home", F.explode(F.array(*shifted)).alias("x")).select("id", "home", "x.k", "x.row", "x.column")
    for end in ("row", "column"):
        all_ = all_.join(c.select(F.col("ix").alias(end), F.col("chromosome").alias("_c")), end).where("_c = home").drop("_c")
    all_ = all_.withColumn("id", F.struct("id", "k"))
    mean = cells(all_, edges, regions, w, value, default).groupBy("id").agg(F.avg("value").alias("m")).select("id.id", "id.k", "m")
    out = mean.groupBy("id").agg(F.max(F.when(F.col("k") == 0, F.col("m"))).alias("loop"), F.avg(F.when(F.col("k") != 0, F.col("m"))).alias("control"))
    ratio = F.col("loop") / F.nullif(F.col("control"), F.lit(0.0))
    return out.select("id", F.when(ratio > 0, F.log2(ratio)).alias("strength")).where("strength is not null")


def directionality_bias(anchors: DataFrame, edges: DataFrame, regions: DataFrame, w: int) -> DataFrame:
    """(strand, distance, ratio): mean downstream over mean upstream contact of stranded anchors (id, ix, strand)."""
    r = chromosome_range(regions.select("ix", "chromosome"))
    a = anchors.join(r, "ix").where((F.col("ix") - w >= F.col("_first")) & (F.col("ix") + w < F.col("_first") + F.col("_size")))
    rows = a.select("strand", "ix", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"), F.sequence(F.lit(1), F.lit(w)).alias("d")).select("strand", "ix", "side", F.explode("d").alias("distance"))
    rows = rows.select("strand", "side", "distance", F.col("ix").alias("bin"), (F.col("ix") + F.col("side") * F.col("distance")).alias("other"))
    rows = rows.join(both_ways(edges), ["bin", "other"], "left").withColumn("v", F.coalesce("weight", F.lit(0)))
    down = F.col("side") * F.col("strand") > 0
    out = rows.groupBy("strand", "distance").agg(F.avg(F.when(down, F.col("v"))).alias("d"), F.avg(F.when(~down, F.col("v"))).alias("u"))
    return out.select("strand", "distance", (F.col("d") / F.nullif(F.col("u"), F.lit(0.0))).alias("ratio"))


def virtual_4c(edges: DataFrame, first: int, last: int) -> DataFrame:
    """(ix, score): mean contact of every bin with the viewpoint's bins first..last."""
    rows = both_ways(edges).where((F.col("bin") >= first) & (F.col("bin") <= last))
    return rows.groupBy(F.col("other").alias("ix")).agg((F.sum("weight") / (last - first + 1)).alias("score"))


def meta_profile(scores: DataFrame, anchors: DataFrame, w: int) -> DataFrame:
    """(offset, score, n): mean score around anchors (ix, chromosome), within their chromosome."""
    rows = anchors.select("chromosome", F.col("ix").alias("_at"), F.explode(F.sequence(F.lit(-w), F.lit(w))).alias("offset")).withColumn("ix", F.col("_at") + F.col("offset"))
    return rows.join(scores, ["chromosome", "ix"]).groupBy("offset").agg(F.avg("score").alias("score"), F.count("score").alias("n"))


def saddle(edges: DataFrame, regions: DataFrame, track: DataFrame, groups: int, default: float = 1.0, least_distance: int = 0) -> DataFrame:
    """(a, b, value, n): mean O/E of cis cells between groups of bins by rank of their score; absent cells have the default.

    The mean over all valid cells is (sum of present + default * absent) / all, so no dense grid is made: the
    number of cells of two groups is the product of their sizes in each chromosome, less those of the
    ``least_distance`` diagonals that are left out.
    """
    g = track.where("score is not null").join(regions.where("valid").select("ix", "chromosome"), "ix")
    cut = g.agg(F.percentile("score", F.array(*[F.lit(k / groups) for k in range(1, groups)])).alias("_cut"))
    g = g.crossJoin(cut).withColumn("g", F.size(F.filter("_cut", lambda c: c < F.col("score")))).select("ix", "chromosome", "g")  # one row of cut-offs
    a, b = F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b")
    size = g.groupBy("chromosome").agg(*[F.sum(F.when(F.col("g") == k, 1).otherwise(0)).alias(f"_{k}") for k in range(groups)])
    both = [F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), (F.col(f"_{i}") * F.col(f"_{j}") if i != j else F.col(f"_{i}") * (F.col(f"_{i}") + 1) / 2).cast("long").alias("n")) for i in range(groups) for j in range(i + 1)]
    every = size.select(F.explode(F.array(*both)).alias("x")).groupBy("x.a", "x.b").agg(F.sum("x.n").alias("n"))
    if least_distance > 0:
        x = g.select("chromosome", F.col("g").alias("_a"), F.explode(F.sequence(F.col("ix"), F.col("ix") + least_distance - 1)).alias("ix"))
        close = x.join(g.select("chromosome", "ix", F.col("g").alias("_b")), ["chromosome", "ix"]).groupBy(a, b).agg(F.count("*").alias("_near"))
        every = every.join(close, ["a", "b"], "left").select("a", "b", (F.col("n") - F.coalesce("_near", F.lit(0))).alias("n"))
    x, y = (g.select(F.col("ix").alias(end), F.col("chromosome").alias(c), F.col("g").alias(k)) for end, c, k in (("source", "_c", "_a"), ("sink", "_d", "_b")))
    seen = edges.where(F.col("sink") - F.col("source") >= least_distance).join(x, "source").join(y, "sink").where(F.col("_c") == F.col("_d"))
    seen = seen.groupBy(a, b).agg(F.sum("oe").alias("s"), F.count("*").alias("k"))
    out = every.where("n > 0").join(seen, ["a", "b"], "left")
    return out.select("a", "b", ((F.coalesce("s", F.lit(0.0)) + default * (F.col("n") - F.coalesce("k", F.lit(0)))) / F.col("n")).alias("value"), "n")


def _inside(windows: DataFrame, regions: DataFrame) -> DataFrame:
    """The windows (_a, _b) that lie in the chromosome of their middle bin, first."""
    r = chromosome_range(regions.select("ix", "chromosome")).select(F.col("ix").alias("first"), "_first", "_size")
    return windows.join(r, "first").where((F.col("_a") >= F.col("_first")) & (F.col("_b") < F.col("_first") + F.col("_size"))).drop("_first", "_size")


def tad_strength(domains: DataFrame, edges: DataFrame, regions: DataFrame, value: str = "oe", default: float = 1.0) -> DataFrame:
    """(id, strength): of domains (id, first, last), log2 of the mean O/E within over that of the two flanking squares between thirds.

    The window is the domain with as much on either side; its middle third is compared with the blocks between the
    middle and the outer thirds. Windows that leave their chromosome have no strength and no row; invalid bins
    are left out of every mean, and valid cells without an edge have the default.
    """
    size = F.col("last") - F.col("first") + 1
    w = _inside(domains.select("id", "first", "last", (F.col("first") - size).alias("_a"), (F.col("last") + size).alias("_b")), regions)
    third = lambda c: F.when(F.col(c) < F.col("first"), 0).when(F.col(c) <= F.col("last"), 1).otherwise(2)
    bins = w.select("*", F.explode(F.sequence("_a", "_b")).alias("source")).withColumn("_s", third("source"))
    ok = bins.join(regions.where("valid").select(F.col("ix").alias("source")), "source")
    n = ok.groupBy("id").agg(*[F.sum(F.when(F.col("_s") == k, 1).otherwise(0)).alias(f"_n{k}") for k in range(3)])
    valid = regions.where("valid").select("ix")
    e = edges.join(valid.withColumnRenamed("ix", "sink"), "sink", "left_semi").select("source", "sink", F.col(value).cast("double").alias("_v")).where("_v is not null")
    hit = ok.where("_s < 2").join(e, "source").where("sink >= source and sink <= _b").withColumn("_t", third("sink")).where("(_s = 0 and _t = 1) or (_s = 1 and _t >= 1)")
    twice = F.when((F.col("_s") == 1) & (F.col("_t") == 1) & (F.col("source") < F.col("sink")), 2).otherwise(1)
    block = {"_m": (1, 1), "_l": (0, 1), "_r": (1, 2)}
    is_ = lambda k: (F.col("_s") == block[k][0]) & (F.col("_t") == block[k][1])
    sums = hit.groupBy("id").agg(*[f(F.when(is_(k), x)).alias(f"{k}{t}") for k in block for f, x, t in ((F.sum, F.col("_v") * twice, "s"), (F.sum, twice, "k"))])
    rows = n.join(sums, "id", "left").fillna(0)
    cells_ = {k: F.col(f"_n{i}") * F.col(f"_n{j}") for k, (i, j) in block.items()}
    mean = {k: (F.col(f"{k}s") + default * (c - F.col(f"{k}k"))) / F.nullif(c, F.lit(0)) for k, c in cells_.items()}
    ratio = mean["_m"] / F.nullif((mean["_l"] + mean["_r"]) / 2, F.lit(0.0))
    return rows.select("id", F.when(ratio > 0, F.log2(ratio)).alias("strength"))


def rank_of(table: DataFrame, *order: str) -> DataFrame:
    """Adds id: the rank of a row in the given order, from 0."""
    return numbered(table, *order, name="id")


def rescaled(cells: DataFrame, bin_size: int) -> DataFrame:
    """Pile-up cells (i, j, value) weighed by the fourth root of their distance in bases, inverted."""
    return cells.withColumn("value", F.col("value") * F.pow(F.abs(F.col("i") - F.col("j")) * bin_size + bin_size, F.lit(-0.25)))


def pile_up_domains(domains: DataFrame, edges: DataFrame, regions: DataFrame, pixels: int, flank: float = 1.0, value: str = "oe", default: float = 1.0) -> DataFrame:
    """(i, j, value, n): mean of windows (id, first, last), each with ``flank`` times its length on either side, brought to pixels x pixels.

    A pixel takes the nearest cell of its window; cells without an edge have the default, those of invalid bins are
    left out. Windows that leave their chromosome are skipped.
    """
    more = F.floor((F.col("last") - F.col("first") + 1) * flank)
    w = _inside(domains.select("id", "first", (F.col("first") - more).alias("_a"), (F.col("last") + more).alias("_b")), regions)
    bin_of = lambda k: F.col("_a") + F.floor((k + 0.5) * (F.col("_b") - F.col("_a") + 1) / pixels)
    span = F.sequence(F.lit(0), F.lit(pixels - 1))
    rows = w.select("*", F.explode(span).alias("i")).withColumn("bin", bin_of(F.col("i"))).select("*", F.explode(span).alias("j")).withColumn("other", bin_of(F.col("j")))
    valid = regions.where("valid").select("ix")
    for end in ("bin", "other"):
        rows = rows.join(valid.withColumnRenamed("ix", end), end, "left_semi")
    rows = rows.join(both_ways(edges, value), ["bin", "other"], "left")
    return rows.groupBy("i", "j").agg(F.avg(F.coalesce(F.col(value).cast("double"), F.lit(default))).alias("value"), F.count("*").alias("n"))
