"""Soft deletes: each filter owns one bit of a row's mask, and a scan admits rows by their bits.

All filters given together are evaluated in one projection.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordering import numbered

MASK = "mask"


def with_mask(df: DataFrame) -> DataFrame:
    return df if MASK in df.columns else df.withColumn(MASK, F.lit(0))


def apply_filters(df: DataFrame, filters: Mapping[str, Column], first_bit: int = 0) -> tuple[DataFrame, dict[str, int]]:
    """Sets bit i where the i-th condition (true: keep the row) fails. Returns the rows and name -> bit."""
    bits = {name: first_bit + i for i, name in enumerate(filters)}
    mask = F.col(MASK) if MASK in df.columns else F.lit(0)
    for name, keep in filters.items():
        mask = mask.bitwiseOR(F.when(F.coalesce(keep, F.lit(False)), 0).otherwise(1 << bits[name]))
    return df.withColumn(MASK, mask.cast("int")), bits


def visible(df: DataFrame, excluded: int = 0) -> DataFrame:
    """Rows all of whose bits are among ``excluded``."""
    return df.where(F.col(MASK).bitwiseOR(F.lit(excluded)) == excluded)


def reset(df: DataFrame) -> DataFrame:
    return df.withColumn(MASK, F.lit(0))


def statistics(df: DataFrame, bits: Mapping[str, int]) -> DataFrame:
    """(name, n): rows for each filter (a row with two bits counts twice) and ``valid`` for rows without any."""
    counts = df.groupBy(MASK).count()  # few distinct masks
    names = [F.when(F.col(MASK).bitwiseAND(F.lit(1 << b)) != 0, F.lit(n)) for n, b in bits.items()]
    names.append(F.when(F.col(MASK) == 0, F.lit("valid")))
    hit = counts.select(F.explode(F.array_compact(F.array(*names))).alias("name"), "count")
    every = df.sparkSession.createDataFrame([(n,) for n in [*bits, "valid"]], "name string")
    return every.join(hit.groupBy("name").agg(F.sum("count").alias("n")), "name", "left").select("name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def ranks(df: DataFrame, *order: str, within: str | None = None) -> DataFrame:
    """rank: 0, 1, .. for visible rows and -1, -2, .. for masked ones, in the given order."""
    rows = df.withColumn("_seen", F.col(MASK) == 0)
    if within:
        w = Window.partitionBy(within, "_seen").orderBy(*order)
        rows = rows.withColumn("_n", F.row_number().over(w) - 1)
    else:
        rows = numbered(rows, *order, by=("_seen",), name="_n")
    return rows.withColumn("rank", F.when(F.col("_seen"), F.col("_n")).otherwise(-F.col("_n") - 1).cast("long")).drop("_seen", "_n")
