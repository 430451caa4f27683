"""Positions in a global order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RANGES, SAMPLE = 64, 4096


def numbered(df: DataFrame, *order: str | Column, by: tuple[str, ...] = (), name: str = "n", ranges: int = RANGES) -> DataFrame:
    """Adds a column: a row's position (from 0) in the given order, among the rows of equal ``by`` columns (few distinct values).

    At most SAMPLE keys, those of the smallest hashes, give the cut points of the ranges. Rows are numbered within
    their range, and a range starts where the counts of those before it end. Cut points are literals, so a task
    that runs again puts its rows where they were. Equal keys share a range.
    """
    if not order:
        raise ValueError("an order is needed")
    key = F.struct(*order)
    some = df.select(key.alias("k")).orderBy(F.xxhash64("k")).limit(SAMPLE)
    keys = [r.k for r in some.orderBy("k").collect()]
    kind = some.schema["k"].dataType
    cuts = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(k, kind, strict=True)]) for k in dict.fromkeys(keys[len(keys) * i // ranges] for i in range(1, ranges))] if len(keys) == SAMPLE else []
    at = sum((F.when(key > c, 1).otherwise(0) for c in cuts), F.lit(0))
    rows = df.withColumn("_range", at)
    counts = rows.groupBy(*by, "_range").count()
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts = counts.select(*by, "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*by, "_range").orderBy(*order)
    return rows.withColumn("_within", F.row_number().over(within)).join(F.broadcast(counts), [*by, "_range"]).withColumn(name, (F.col("_before") + F.col("_within") - 1).cast("long")).drop("_range", "_before", "_within")
