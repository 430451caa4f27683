"""Read pairs: joining reads, resolving positions, pair filters, ligation structure, duplicates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.sequences import cigar_matched
from .ordering import numbered

SAME, INWARD, OUTWARD = 0, 1, 2


def join_mates(left: DataFrame, right: DataFrame, name: str = "qname") -> DataFrame:
    """Pairs single alignments of two files by read name; names with more than one alignment on a side are left out (see pair_up)."""
    one = lambda df, p: df.groupBy(name).agg(F.count("*").alias(f"{p}_n"), *[F.first(c).alias(f"{p}_{c}") for c in df.columns if c != name])
    both = one(left, "left").join(one(right, "right"), name)
    return both.where("left_n = 1 and right_n = 1").drop("left_n", "right_n")


def longest_match(pos: Column, cigar: Column) -> Column:
    """struct(start, end): the first of the longest M or = blocks of an alignment on the reference; null without any."""
    ops = F.transform(F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1)), lambda o: F.struct(F.regexp_extract(o, "^[0-9]+", 0).cast("long").alias("n"), F.right(o, F.lit(1)).alias("op")))
    none = F.struct(pos.cast("long").alias("at"), F.lit(None).cast("long").alias("start"), F.lit(0).cast("long").alias("size"))

    def step(state: Column, o: Column) -> Column:
        best = o.op.isin("M", "=") & (o.n > state["size"])
        moved = state["at"] + F.when(o.op.isin("M", "D", "N", "=", "X"), o.n).otherwise(0)
        return F.struct(moved.alias("at"), F.when(best, state["at"]).otherwise(state["start"]).alias("start"), F.when(best, o.n).otherwise(state["size"]).alias("size"))

    return F.aggregate(ops, none, step, lambda s: F.when(s["start"].isNotNull(), F.struct(s["start"].alias("start"), (s["start"] + s["size"]).alias("end"))))


def pair_up(left: DataFrame, right: DataFrame, most: int = 100, name: str = "qname") -> DataFrame:
    """(name, kind, left, right) of all names that two files of mapped alignments share.

    kind: normal (one alignment on either side), chimeric (one and two, of which one lies on the locus of the single one,
    its longest match within ``most`` bp; the other one is its partner), else abnormal, without alignments. Each side is a struct of the
    alignment's columns; of a chimeric pair left is the partner.
    """
    columns = [c for c in left.columns if c != name]

    def side(df: DataFrame, p: str) -> DataFrame:
        one = F.struct(*columns, longest_match(F.col("pos"), F.col("cigar")).alias("_match"))
        return df.groupBy(name).agg(F.array_sort(F.slice(F.collect_list(one), 1, 3)).alias(p))  # more than two are abnormal

    rows = side(left, "_x").join(side(right, "_y"), name)
    n, m = F.size("_x"), F.size("_y")
    two, single = F.when(n == 2, F.col("_x")).otherwise(F.col("_y")), F.when(n == 2, F.col("_y")[0]).otherwise(F.col("_x")[0])
    near = lambda a, b: (a.rname == b.rname) & (F.least(F.abs(a["_match"].start - b["_match"].end), F.abs(a["_match"].end - b["_match"].start)) <= most)
    apart, close = F.filter(two, lambda a: ~near(a, single)), F.filter(two, lambda a: near(a, single))
    matched = F.forall(two, lambda a: a["_match"].isNotNull()) & single["_match"].isNotNull()
    chimeric = (n + m == 3) & matched & (F.size(apart) == 1) & (F.size(close) == 1)
    kind = F.when((n == 1) & (m == 1), "normal").when(chimeric, "chimeric").otherwise("abnormal")
    plain = lambda x: F.struct(*[x[c].alias(c) for c in columns])
    rows = rows.withColumn("kind", kind).withColumn("_a", F.when(F.col("kind") == "normal", F.col("_x")[0]).when(F.col("kind") == "chimeric", F.get(apart, 0)))
    rows = rows.withColumn("_b", F.when(F.col("kind") == "normal", F.col("_y")[0]).when(F.col("kind") == "chimeric", single))
    return rows.select(name, "kind", F.when(F.col("_a").isNotNull(), plain(F.col("_a"))).alias("left"), F.when(F.col("_b").isNotNull(), plain(F.col("_b"))).alias("right"))


def gap() -> Column:
    """right fragment start - left fragment end; 0 for the same or the adjacent fragment."""
    g = F.col("right_start") - F.col("left_end")
    same = (F.col("left_chromosome") == F.col("right_chromosome")) & (F.col("left_start") == F.col("right_start"))
    return F.when(same | (g == 1), 0).otherwise(g)


def is_cis() -> Column:
    return F.col("left_chromosome") == F.col("right_chromosome")


def is_self_ligation() -> Column:
    return is_cis() & (F.col("left_start") == F.col("right_start"))


def orientation() -> Column:
    """0 same strands, 1 inward (+ -), 2 outward (- +)."""
    return F.when(F.col("left_strand") == F.col("right_strand"), SAME).when(F.col("left_strand") > 0, INWARD).otherwise(OUTWARD)


def re_distance(side: str) -> Column:
    """Distance of a read to the nearer end of its fragment."""
    p = F.col(f"{side}_position")
    return F.least(F.abs(p - F.col(f"{side}_start")), F.abs(F.col(f"{side}_end") - p))


def filters(inward: int | None = None, outward: int | None = None, re_max: int | None = None, self_ligation: bool = False) -> dict[str, Column]:
    """Conditions that keep a pair, by filter name."""
    out = {}
    if inward is not None:
        out["inward"] = ~(is_cis() & (orientation() == INWARD) & (gap() <= inward))
    if outward is not None:
        out["outward"] = ~(is_cis() & (orientation() == OUTWARD) & (gap() <= outward))
    if re_max is not None:
        out["re_distance"] = re_distance("left") + re_distance("right") <= re_max
    if self_ligation:
        out["self_ligation"] = ~is_self_ligation()
    return out


def without_contaminants(reads: DataFrame, contaminants: DataFrame, *names: str) -> DataFrame:
    return reads.join(contaminants.select(*names).distinct(), list(names), "left_anti")


def ligation_bias(pairs: DataFrame, sampling: int) -> DataFrame:
    """(bin, gap, inward_ratio, outward_ratio, n): cis pairs by gap; a bin ends once it has over ``sampling`` same-strand pairs.

    A row's bin follows from how many same-strand pairs come before it, so a running count by gap and
    type is enough: the counts are aggregated per (gap, type) before any ordering, and a group of equal rows is
    cut at the bin ends that fall into it.
    """
    rows = pairs.where(is_cis() & ~is_self_ligation()).select(gap().cast("long").alias("gap"), orientation().alias("type")).where("gap > 0")
    counts = rows.groupBy("gap", "type").count()
    same = F.when(F.col("type") == SAME, F.col("count")).otherwise(0)
    counts = counts.withColumn("_part", F.shiftright("gap", 16))  # 65,536 gaps
    up_to = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    parts = counts.groupBy("_part").agg(F.sum(same).alias("_same")).select("_part", F.coalesce(F.sum("_same").over(up_to), F.lit(0)).alias("_base"))
    w = Window.partitionBy("_part").orderBy("gap", "type").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.join(parts, "_part").withColumn("before", F.col("_base") + F.coalesce(F.sum(same).over(w), F.lit(0)))
    size = sampling + 1
    # Same-strand rows number before .. before+count-1: cut them by size; others all lie after `before` of them.
    lo = F.floor(F.col("before") / size)
    hi = F.when((F.col("type") == SAME) & (F.col("count") > 0), F.floor((F.col("before") + F.col("count") - 1) / size)).otherwise(lo)
    parts = counts.withColumn("bin", F.explode(F.sequence(lo, hi)))
    inside = F.least(F.col("before") + F.col("count"), (F.col("bin") + 1) * size) - F.greatest(F.col("before"), F.col("bin") * size)
    parts = parts.withColumn("n", F.when(F.col("type") == SAME, inside).otherwise(F.col("count")))
    out = parts.groupBy("bin").agg(
        F.sum(F.col("gap") * F.col("n")).alias("_g"), F.sum("n").alias("n"), *[F.sum(F.when(F.col("type") == t, F.col("n")).otherwise(0)).alias(f"_{t}") for t in (SAME, INWARD, OUTWARD)]
    )
    out = out.where(F.col("_0") == size)  # the unfinished last bin goes
    return out.select(F.col("bin").cast("long").alias("bin"), F.floor(F.col("_g") / F.col("n")).cast("long").alias("gap"), (F.col("_1") / F.col("_0")).alias("inward_ratio"), (F.col("_2") / F.col("_0")).alias("outward_ratio"), F.col("n").cast("long").alias("n"))


def auto_threshold(ratios: list[tuple[float, float, int]]) -> float | None:
    """The first distance whose ratio does not differ from one half (two-proportion z below 1.96)."""
    for x, ratio, n in ratios:
        r = min(max(ratio, 0.0), 1.0)
        p = (r * n + 0.5 * n) / (2 * n) if n else 0.5
        se = math.sqrt(p * (1 - p) * 2 / n) if n and 0 < p < 1 else 0.0
        if se and abs(0.5 - r) / se < 1.96:
            return x
    return None


def pcr_duplicates(pairs: DataFrame, threshold: int, *order: str) -> DataFrame:
    """Adds duplicate: a pair within threshold of the last kept pair (its anchor) of its chromosome pair, by left position.

    The scan is sequential only within runs: two neighbours whose left positions differ by more than
    threshold always start a new anchor, so runs are found with a window and each is scanned on its own.
    """
    w = Window.partitionBy("left_chromosome", "right_chromosome").orderBy("left_position", "right_position", *order)
    far = F.col("left_position") - F.lag("left_position").over(w) > threshold
    rows = pairs.withColumn("_run", F.sum(F.when(far, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_order", F.row_number().over(w))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = a = b = None
        for pdf in batches:
            out = []
            for *key, x, y in zip(*(pdf[c].tolist() for c in ("left_chromosome", "right_chromosome", "_run", "left_position", "right_position")), strict=True):
                same = key == last and abs(x - a) <= threshold and abs(y - b) <= threshold
                out.append(same)
                if not same:
                    last, a, b = key, x, y
            yield pdf.drop(columns=["_run", "_order"]).assign(duplicate=out)

    run = ["left_chromosome", "right_chromosome", "_run"]
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return rows.repartition(*run).sortWithinPartitions(*run, "_order").mapInPandas(scan, f"{names}, duplicate boolean")


def exact_duplicates(pairs: DataFrame, *keys: str) -> DataFrame:
    """The first row of each key, by all columns."""
    w = Window.partitionBy(*keys).orderBy(*[c for c in pairs.columns if c not in keys])
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def resolve_chimeric(alignments: DataFrame, most: int = 500) -> DataFrame:
    """From names with three alignments, the pair that remains once two alignments on one locus (within most bp) become one.

    alignments: (qname, alignments array<struct<chromosome, position, strand, matched>>).
    """
    a = [F.col("alignments")[i] for i in range(3)]
    near = lambda x, y: (x.chromosome == y.chromosome) & (F.abs(x.position - y.position) <= most)
    longer = lambda x, y: F.when(x.matched >= y.matched, x).otherwise(y)
    pair = F.when(near(a[0], a[1]), F.array(longer(a[0], a[1]), a[2])).when(near(a[0], a[2]), F.array(longer(a[0], a[2]), a[1])).when(near(a[1], a[2]), F.array(a[0], longer(a[1], a[2])))
    rows = alignments.withColumn("pair", F.when(F.size("alignments") == 2, F.col("alignments")).when(F.size("alignments") == 3, pair))
    return rows.where("pair is not null").drop("alignments")


def alignments_by_name(reads: DataFrame, name: str = "qname") -> DataFrame:
    """(name, alignments) of one file that holds both mates; names with other than two or three alignments go. For resolve_chimeric."""
    one = F.struct(F.col("rname").alias("chromosome"), F.col("pos").alias("position"), "strand", cigar_matched(F.col("cigar")).alias("matched"))
    return reads.groupBy(name).agg(F.array_sort(F.collect_list(one)).alias("alignments")).where("size(alignments) in (2, 3)")


def nth(pairs: DataFrame, n: int, *order: str) -> DataFrame:
    """The n-th pair (from 0) in an order: the first n + 1 rows are found by top-k, not by a global sort."""
    return pairs.orderBy(*order).limit(n + 1).orderBy(*[F.desc(c) for c in order]).limit(1)


def slice_of(pairs: DataFrame, start: int, stop: int, *order: str) -> DataFrame:
    """The pairs at places start .. stop - 1 of an order."""
    return numbered(pairs, *order, name="_n").where((F.col("_n") >= start) & (F.col("_n") < stop)).drop("_n")
