"""The supplied tables seen as contact data, in Spark and as DuckDB CTEs.

Parts are positions on chromosomes of 500 parts (100 bp each), bins are 10 parts (1 kb, 50 to a chromosome), line
items are reads, and two lines of an order are a read pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import matrix
from ..session import ship

BIN, PER_CHROMOSOME = 1000, 50
#: Bytes of its files for which a table gets one task more, some 230,000 line items.
TASK_BYTES = 4 << 20
ORDER = ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for line items, pairs and edges: their number follows the files, so what a task holds does not."""
    size = table(spark, sf_dir, "lineitem")._jdf.queryExecution().analyzed().stats().sizeInBytes()
    return max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").repartition(tasks(spark, sf_dir), "l_orderkey")
    t = t.withColumn("rn", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)).cast("long"))  # before its key gets another name, so that joins find it sorted
    position = F.col("l_partkey") % 500 * 100 + F.col("l_suppkey") % 100 + 1
    return t.select(
        F.col("l_orderkey").alias("name"), "rn", F.expr("l_partkey div 500").alias("chromosome"), position.alias("position"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).cast("long").alias("strand"), F.expr("l_partkey div 10").alias("bin"), F.col("l_quantity").alias("mapq"), F.col("l_returnflag").alias("sample"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ix, chromosome, start, end) of every bin that holds a part."""
    t = table(spark, sf_dir, "part").select(F.expr("p_partkey div 10").alias("ix")).distinct()
    start = F.col("ix") % PER_CHROMOSOME * BIN + 1
    return t.select("ix", F.expr(f"ix div {PER_CHROMOSOME}").alias("chromosome"), start.alias("start"), (start + BIN - 1).alias("end"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir)

    def side(p: str, bin_: str) -> DataFrame:
        start = F.col("bin") % PER_CHROMOSOME * BIN + 1
        cols = [F.col(c).alias(f"{p}_{c}") for c in ("rn", "chromosome", "position", "strand", "mapq", "sample")]
        return r.select("name", *cols, start.alias(f"{p}_start"), (start + BIN - 1).alias(f"{p}_end"), F.col("bin").alias(bin_))

    both = side("left", "source").join(side("right", "sink"), "name").where("left_rn < right_rn")
    return both.withColumnRenamed("left_sample", "sample").drop("right_sample")


def edges(spark: SparkSession, sf_dir: str, sample: str | None = None, cis: bool = False) -> DataFrame:
    """Counts of all pairs, of one sample's, or of those within chromosomes."""
    p = pairs(spark, sf_dir)
    if sample is not None:
        p = p.where(F.col("sample") == sample)
    if cis:
        p = p.where("left_chromosome - right_chromosome = 0")  # plain equality would become a key of the join, which then deals its lines anew
    return matrix.edges_from_pairs(p, tasks=tasks(spark, sf_dir))


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with valid, which takes no counts: a bin is valid if any pair touches it."""
    seen = pairs(spark, sf_dir).select("source", "sink", F.lit(1).alias("weight"))
    return matrix.valid_regions(seen, regions(spark, sf_dir))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ix, chromosome, score): an integer score for each region, from the counts of its reads; null for every 13th."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.expr("l_partkey div 10").alias("ix")).agg(F.count("*").alias("n"))
    rows = regions(spark, sf_dir).join(n, "ix", "left")
    return rows.select("ix", "chromosome", F.when(F.col("ix") % 13 != 0, F.coalesce("n", F.lit(0)) * 7 % 101 - 50).cast("double").alias("score"))


CTES = {
    "reads": f"""SELECT l_orderkey AS name, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) AS rn, l_partkey // 500 AS chromosome,
        l_partkey % 500 * 100 + l_suppkey % 100 + 1 AS position, CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS BIGINT) AS strand, l_partkey // 10 AS bin, l_quantity AS mapq, l_returnflag AS sample FROM lineitem""",
    "regions": """SELECT ix, ix // 50 AS chromosome, ix % 50 * 1000 + 1 AS start_, ix % 50 * 1000 + 1000 AS end_ FROM (SELECT DISTINCT p_partkey // 10 AS ix FROM part)""",
    "pairs": """SELECT a.name, a.rn AS left_rn, b.rn AS right_rn, a.chromosome AS left_chromosome, a.position AS left_position, a.strand AS left_strand, a.mapq AS left_mapq, a.sample AS sample,
        b.chromosome AS right_chromosome, b.position AS right_position, b.strand AS right_strand, b.mapq AS right_mapq, a.bin % 50 * 1000 + 1 AS left_start, a.bin % 50 * 1000 + 1000 AS left_end,
        b.bin % 50 * 1000 + 1 AS right_start, b.bin % 50 * 1000 + 1000 AS right_end, a.bin AS source, b.bin AS sink FROM reads a JOIN reads b ON a.name = b.name AND a.rn < b.rn""",
    "geometry": """SELECT *, left_chromosome = right_chromosome AS cis, CASE WHEN left_strand = right_strand THEN 0 WHEN left_strand > 0 THEN 1 ELSE 2 END AS orientation,
        CASE WHEN (left_chromosome = right_chromosome AND left_start = right_start) OR right_start - left_end = 1 THEN 0 ELSE right_start - left_end END AS gap,
        least(abs(left_position - left_start), abs(left_end - left_position)) + least(abs(right_position - right_start), abs(right_end - right_position)) AS re FROM pairs""",
    "edges": """SELECT source, sink, count(*) AS weight FROM pairs GROUP BY source, sink""",
    "edges_a": """SELECT source, sink, count(*) AS weight FROM pairs WHERE sample = 'A' GROUP BY source, sink""",
    "edges_n": """SELECT source, sink, count(*) AS weight FROM pairs WHERE sample = 'N' GROUP BY source, sink""",
    "edges_r": """SELECT source, sink, count(*) AS weight FROM pairs WHERE sample = 'R' GROUP BY source, sink""",
    "ends": """SELECT source AS bin, sink AS other, weight FROM edges UNION ALL SELECT sink, source, weight FROM edges WHERE source <> sink""",
    "marginals": """SELECT bin AS ix, CAST(sum(weight) AS BIGINT) AS marginal FROM ends GROUP BY bin""",
    "valid": """SELECT r.*, m.ix IS NOT NULL AS valid FROM regions r LEFT JOIN marginals m ON r.ix = m.ix""",
    "cis": """SELECT e.source, e.sink, e.weight, a.chromosome, e.sink - e.source AS distance FROM edges e JOIN regions a ON a.ix = e.source JOIN regions b ON b.ix = e.sink WHERE a.chromosome = b.chromosome""",
    "possible": """SELECT a.chromosome, b.ix - a.ix AS distance, count(*) AS possible FROM valid a JOIN valid b ON a.chromosome = b.chromosome AND b.ix >= a.ix WHERE a.valid AND b.valid GROUP BY ALL""",
    "totals": """SELECT chromosome, distance, CAST(sum(weight) AS BIGINT) AS total FROM cis GROUP BY ALL""",
    "expected": """SELECT p.chromosome, p.distance, possible, coalesce(total, 0) AS total, coalesce(total, 0) / possible AS expected FROM possible p LEFT JOIN totals t ON p.chromosome = t.chromosome AND p.distance = t.distance""",
    "oe": """SELECT c.chromosome, c.source, c.sink, c.distance, c.weight, e.expected, c.weight / nullif(e.expected, 0) AS oe FROM cis c JOIN expected e ON c.chromosome = e.chromosome AND c.distance = e.distance""",
    "extent": """SELECT *, min(ix) OVER (PARTITION BY chromosome) AS first_, count(*) OVER (PARTITION BY chromosome) AS size_ FROM valid""",
    "counts": """SELECT bin AS ix, count(*) AS n FROM reads GROUP BY bin""",
    "tracks": """SELECT r.ix, r.chromosome, CASE WHEN r.ix % 13 <> 0 THEN CAST(coalesce(n, 0) * 7 % 101 - 50 AS DOUBLE) END AS score FROM regions r LEFT JOIN counts c ON r.ix = c.ix""",
}
_NEEDS = {
    "pairs": ["reads"], "geometry": ["pairs"], "edges": ["pairs"], "edges_a": ["pairs"], "edges_n": ["pairs"], "edges_r": ["pairs"], "ends": ["edges"], "marginals": ["ends"], "valid": ["regions", "marginals"], "cis": ["edges", "regions"],
    "possible": ["valid"], "totals": ["cis"], "expected": ["possible", "totals"], "oe": ["cis", "expected"], "extent": ["valid"], "counts": ["reads"], "tracks": ["regions", "counts"],
}


def sql(needs: str, body: str) -> str:
    """DuckDB SQL: the CTEs that needs names (and those under them), then ``body``, which may go on with more CTEs after a comma."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    head = ", ".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order)
    return f"WITH {head} {body}" if head else body
