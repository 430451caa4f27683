"""Interval algebra on regions (ix, chromosome, start, end); coordinates are 1-based and closed.

Range conditions become equi-joins on (chromosome, bucket), so no plan falls back to a nested loop.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordering import numbered


def fixed_bins(chromosomes: DataFrame, size: int) -> DataFrame:
    """Regular bins of (chromosome, length); the last one of a chromosome may be short."""
    rows = chromosomes.where("length > 0").withColumn("start", F.explode(F.sequence(F.lit(1).cast("long"), F.col("length").cast("long"), F.lit(size).cast("long"))))
    rows = rows.select("chromosome", "start", F.least(F.col("start") + size - 1, F.col("length")).alias("end"))
    before = chromosomes.select("chromosome", F.ceil(F.col("length") / size).alias("_n"))
    w = Window.orderBy("chromosome").rowsBetween(Window.unboundedPreceding, -1)  # one row per chromosome
    before = before.select("chromosome", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_first"))
    return rows.join(before, "chromosome").select((F.col("_first") + F.floor((F.col("start") - 1) / size)).cast("long").alias("ix"), "chromosome", "start", "end")


#: Letters that stand for several ones in a site (fixed values).
AMBIGUOUS = {"N": "ACGTN", "R": "AG", "Y": "CT", "W": "AT", "S": "CG", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG"}
_OPPOSITE = str.maketrans("ACGTRYKMBDHV", "TGCAYRMKVHDB")


def site_pattern(site: str, ambiguous: bool = True) -> str:
    """A regular expression of a site; letters for several ones are character classes."""
    return "".join(f"[{AMBIGUOUS[c]}]" if ambiguous and c in AMBIGUOUS else c for c in site.upper())


def cut_sites(sequences: DataFrame, site: str, offset: int = 0, ambiguous: tuple[str, ...] | bool = ("N",), both_strands: bool = False) -> DataFrame:
    """(name, position): 0-based starts of a site, overlapping ones included, plus an offset.

    ambiguous: letters of the site that stand for several ones (True: all of AMBIGUOUS). With both_strands also where the other
    strand has the site, cut at the same distance from its end.
    """
    if both_strands:
        other = site.upper().translate(_OPPOSITE)[::-1]
        one = cut_sites(sequences, site, offset, ambiguous)
        return one if other == site.upper() else one.unionByName(cut_sites(sequences, other, len(site) - offset, ambiguous)).distinct()
    letters = set(AMBIGUOUS) if ambiguous is True else set(ambiguous or ())
    cut = "(?i)(?=" + "".join(site_pattern(c) if c in letters else c for c in site.upper()) + ")"
    rows = sequences.select("name", F.posexplode(F.split("sequence", cut, -1)).alias("_i", "_part"))
    w = Window.partitionBy("name").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("position", F.coalesce(F.sum(F.length("_part")).over(w), F.lit(0)))
    begins = sequences.select("name", F.col("sequence").rlike("(?i)^" + cut.removeprefix("(?i)")).alias("_begins"))
    rows = rows.join(begins, "name").where("_i > 0 or _begins")
    return rows.select("name", (F.col("position") + offset).cast("long").alias("position"))


def digest(sequences: DataFrame, site: str | list[tuple[str, int]], offset: int = 0) -> DataFrame:
    """(chromosome, start, end) of the fragments between cut sites; of several enzymes, [(site, offset)], between those of any."""
    sites = [(site, offset)] if isinstance(site, str) else site
    cuts = functools.reduce(DataFrame.unionByName, [cut_sites(sequences, s, o, ambiguous=True) for s, o in sites])
    cuts = cuts.join(sequences.select("name", F.length("sequence").cast("long").alias("_l")), "name").where("position > 0 and position < _l").select("name", "position")
    ends = cuts.unionByName(sequences.select("name", F.length("sequence").cast("long").alias("position"))).where("position > 0").distinct()
    w = Window.partitionBy("name").orderBy("position")
    return ends.select(F.col("name").alias("chromosome"), (F.coalesce(F.lag("position").over(w), F.lit(0)) + 1).alias("start"), F.col("position").alias("end"))


def _buckets(start: Column, end: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(start / size), F.floor(end / size)))


def overlaps(a: DataFrame, b: DataFrame, size: int = 10_000) -> DataFrame:
    """All pairs of rows of a and b whose closed intervals overlap; b's columns get the prefix ``b_``, and overlap is their common length.

    Each pair is emitted once: in the bucket where the later of its two starts lies.
    """
    x = a.withColumn("_bucket", _buckets(F.col("start"), F.col("end"), size))
    y = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns]).withColumn("_bucket", _buckets(F.col("b_start"), F.col("b_end"), size))
    hit = (F.col("start") <= F.col("b_end")) & (F.col("end") >= F.col("b_start")) & (F.floor(F.greatest("start", "b_start") / size) == F.col("_bucket"))
    rows = x.join(y.withColumnRenamed("b_chromosome", "chromosome"), ["chromosome", "_bucket"]).where(hit)
    return rows.drop("_bucket").withColumn("overlap", F.least("end", "b_end") - F.greatest("start", "b_start") + 1)


def locate(points: DataFrame, regions: DataFrame, position: str = "position", size: int = 10_000) -> DataFrame:
    """Adds the ix of the region that holds each point; points in none are left out."""
    y = regions.select("chromosome", F.col("start").alias("_s"), F.col("end").alias("_e"), "ix").withColumn("_bucket", _buckets(F.col("_s"), F.col("_e"), size))
    rows = points.withColumn("_bucket", F.floor(F.col(position) / size)).join(y, ["chromosome", "_bucket"])
    return rows.where((F.col(position) >= F.col("_s")) & (F.col(position) <= F.col("_e"))).drop("_bucket", "_s", "_e")


def chromosome_bins(regions: DataFrame) -> DataFrame:
    """(chromosome, first_bin, last_bin, size): bins run from first_bin to before last_bin."""
    return regions.groupBy("chromosome").agg(F.min("ix").alias("first_bin"), (F.max("ix") + 1).alias("last_bin"), F.max("end").alias("size"))


def merge(regions: DataFrame, distance: int = 0) -> DataFrame:
    """Islands of intervals that overlap or lie within distance, with n members and their mean score by length."""
    w = Window.partitionBy("chromosome").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = regions.withColumn("_new", F.when(F.col("start") <= reach + distance, 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.col("end") - F.col("start") + 1
    out = rows.groupBy("chromosome", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), (F.sum(F.col("score") * size) / F.sum(size)).alias("score"))
    return out.drop("_island")


def binned(scores: DataFrame, bins: DataFrame) -> DataFrame:
    """(ix, score): the mean of overlapping scores in each bin, weighed by overlap; null where there is none."""
    hit = overlaps(bins, scores).groupBy("ix").agg((F.sum(F.col("overlap") * F.col("b_score")) / F.sum("overlap")).alias("score"))
    return bins.select("ix").join(hit, "ix", "left")


def smoothed(scores: DataFrame, w: int, fill: float | None = None) -> DataFrame:
    """(chromosome, ix, score): sliding means of w bins on either side; nulls and NaN count as ``fill``, or not at all."""
    clean = F.nanvl(F.col("score"), F.lit(None).cast("double"))
    rows = scores.withColumn("score", clean if fill is None else F.coalesce(clean, F.lit(fill)))
    frame = Window.partitionBy("chromosome").orderBy("ix").rowsBetween(-w, w)
    return rows.select("chromosome", "ix", F.avg("score").over(frame).alias("score"))


def share_of_new(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_ix, new_ix, share): for each pair of overlapping regions the share of the new one that the old one covers."""
    hit = overlaps(old.select("ix", "chromosome", "start", "end"), new.select("ix", "chromosome", "start", "end"))
    return hit.select(F.col("ix").alias("old_ix"), F.col("b_ix").alias("new_ix"), (F.col("overlap") / (F.col("b_end") - F.col("b_start") + 1)).alias("share"))


def nearest(points: DataFrame, regions: DataFrame, position: str = "position") -> DataFrame:
    """As-of join: adds the ix of the first region whose end is at or after each point (null if there is none)."""
    y = regions.select("chromosome", F.col("end").alias("_p"), F.lit(1).alias("_kind"), F.col("ix").alias("_ix"))
    x = points.select("chromosome", F.col(position).alias("_p"), F.lit(0).alias("_kind"), F.struct(*points.columns).alias("_row"))
    rows = x.unionByName(y, allowMissingColumns=True)
    w = Window.partitionBy("chromosome").orderBy("_p", "_kind").rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("ix", F.first("_ix", ignorenulls=True).over(w)).where("_kind = 0")
    return rows.select("_row.*", "ix")


def subset(regions: DataFrame, keep: Column) -> DataFrame:
    """The regions that keep selects, with a new dense ix; old_ix is the former one."""
    return numbered(regions.where(keep).withColumnRenamed("ix", "old_ix"), "old_ix", name="ix").select("ix", "old_ix", *[c for c in regions.columns if c != "ix"])
