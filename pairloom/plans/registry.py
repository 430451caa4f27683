"""Registered queries over the supplied tables and their DuckDB twins."""

from __future__ import annotations

import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import sequences
from ..operators import aggregate, balance, compare, compartments, intervals, loops, masks, matrix, pairs, tracks
from ..operators.ordering import numbered
from . import view
from .view import edges, regions, sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(needs: str = "", body: str = "") -> Callable:
    """Registers a query under its function's name, with the SQL twin if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if body:
            ORACLES[f.__name__] = sql(needs, body)
        return f

    return add


def rounded(x: F.Column | str, digits: int = 6) -> F.Column:
    """As SQL's round of doubles: what is negative and rounds to zero is minus zero."""
    x = F.col(x) if isinstance(x, str) else x
    near = F.round(x, digits)
    return F.when(near == 0, x * 0.0).otherwise(near)


def r6(x: F.Column | str, name: str) -> F.Column:
    return rounded(x).alias(name)


# Pairs ---------------------------------------------------------------------------------------------
PAIR = "name, left_rn, right_rn"


@query("pairs", f"SELECT {PAIR}, left_chromosome, left_position, left_strand, right_chromosome, right_position, right_strand, source, sink FROM pairs")
def read_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return view.pairs(spark, sf).select(*PAIR.split(", "), "left_chromosome", "left_position", "left_strand", "right_chromosome", "right_position", "right_strand", "source", "sink")


@query("geometry", "SELECT cis, CAST(orientation AS BIGINT) AS orientation, count(*) AS n FROM geometry GROUP BY ALL")
def pair_orientation_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = view.pairs(spark, sf)
    return p.groupBy(pairs.is_cis().alias("cis"), pairs.orientation().cast("long").alias("orientation")).agg(F.count("*").alias("n"))


@query("pairs", f"SELECT {PAIR} FROM pairs WHERE left_mapq >= 30 AND right_mapq >= 30")
def filter_mapq(spark: SparkSession, sf: str) -> DataFrame:
    return view.pairs(spark, sf).where("left_mapq >= 30 and right_mapq >= 30").select(*PAIR.split(", "))


def _kept(spark: SparkSession, sf: str, **how: object) -> DataFrame:
    rows, _ = masks.apply_filters(view.pairs(spark, sf), pairs.filters(**how))
    return masks.visible(rows).select(*PAIR.split(", "))


@query("geometry", f"SELECT {PAIR} FROM geometry WHERE NOT (cis AND orientation = 1 AND gap <= 5000)")
def filter_inward(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(spark, sf, inward=5000)


@query("geometry", f"SELECT {PAIR} FROM geometry WHERE NOT (cis AND orientation = 2 AND gap <= 10000)")
def filter_outward(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(spark, sf, outward=10000)


@query("geometry", f"SELECT {PAIR} FROM geometry WHERE re <= 500")
def filter_re_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(spark, sf, re_max=500)


@query("geometry", f"SELECT {PAIR} FROM geometry WHERE NOT (cis AND left_start = right_start)")
def filter_self_ligation(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(spark, sf, self_ligation=True)


ALL_FILTERS = {"inward": 5000, "outward": 10000, "re_max": 500, "self_ligation": True}
_MASKED = """, masked AS (SELECT *, CASE WHEN cis AND orientation = 1 AND gap <= 5000 THEN 1 ELSE 0 END + CASE WHEN cis AND orientation = 2 AND gap <= 10000 THEN 2 ELSE 0 END
    + CASE WHEN re > 500 THEN 4 ELSE 0 END + CASE WHEN cis AND left_start = right_start THEN 8 ELSE 0 END AS mask FROM geometry) """


@query("geometry", _MASKED + """SELECT name, CAST(n AS BIGINT) AS n FROM (VALUES ('inward', (SELECT count(*) FROM masked WHERE mask & 1 <> 0)), ('outward', (SELECT count(*) FROM masked WHERE mask & 2 <> 0)),
    ('re_distance', (SELECT count(*) FROM masked WHERE mask & 4 <> 0)), ('self_ligation', (SELECT count(*) FROM masked WHERE mask & 8 <> 0)), ('valid', (SELECT count(*) FROM masked WHERE mask = 0))) t(name, n)""")
def mask_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return masks.statistics(*masks.apply_filters(view.pairs(spark, sf), pairs.filters(**ALL_FILTERS)))


@query("geometry", _MASKED + f"SELECT {PAIR}, mask FROM masked WHERE mask | 5 = 5")
def excluded_filters_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows, bits = masks.apply_filters(view.pairs(spark, sf), pairs.filters(**ALL_FILTERS))
    return masks.visible(rows, 1 << bits["inward"] | 1 << bits["re_distance"]).select(*PAIR.split(", "), "mask")


@query("geometry", _MASKED + f"SELECT {PAIR}, CAST(CASE WHEN mask = 0 THEN row_number() OVER (PARTITION BY left_chromosome, mask = 0 ORDER BY {PAIR}) - 1 ELSE -row_number() OVER (PARTITION BY left_chromosome, mask = 0 ORDER BY {PAIR}) END AS BIGINT) AS rank FROM masked")
def visible_ranks(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = masks.apply_filters(view.pairs(spark, sf), pairs.filters(**ALL_FILTERS))
    return masks.ranks(rows, *PAIR.split(", "), within="left_chromosome").select(*PAIR.split(", "), "rank")


@query("reads", "SELECT name, rn FROM reads r WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F' AND o_orderkey = r.name)")
def contaminant_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    bad = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("name"))
    return pairs.without_contaminants(view.reads(spark, sf).select("name", "rn"), bad, "name")


@query("geometry", """, ordered AS (SELECT gap, orientation, sum(CASE WHEN orientation = 0 THEN 1 ELSE 0 END) OVER (ORDER BY gap, orientation, name, left_rn, right_rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM geometry WHERE cis AND left_start <> right_start AND gap > 0), binned AS (SELECT *, CAST(coalesce(before, 0) AS BIGINT) // 51 AS bin FROM ordered)
    SELECT bin, CAST(floor(avg(gap)) AS BIGINT) AS gap, round(count(*) FILTER (orientation = 1) / 51, 6) AS inward_ratio, round(count(*) FILTER (orientation = 2) / 51, 6) AS outward_ratio, count(*) AS n FROM binned GROUP BY bin HAVING count(*) FILTER (orientation = 0) = 51""")
def ligation_bias(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.ligation_bias(view.pairs(spark, sf), 50).select("bin", "gap", r6("inward_ratio", "inward_ratio"), r6("outward_ratio", "outward_ratio"), "n")


@query("pairs", f""", o AS (SELECT {PAIR}, left_position AS x, right_position AS y, left_chromosome AS c, right_chromosome AS d, row_number() OVER (PARTITION BY left_chromosome, right_chromosome ORDER BY left_position, right_position, {PAIR}) AS i FROM pairs),
    s AS (WITH RECURSIVE r(c, d, i, ax, ay, dup) AS (SELECT c, d, i, x, y, false FROM o WHERE i = 1 UNION ALL
    SELECT o.c, o.d, o.i, CASE WHEN abs(o.x - ax) <= 2 AND abs(o.y - ay) <= 2 THEN ax ELSE x END, CASE WHEN abs(o.x - ax) <= 2 AND abs(o.y - ay) <= 2 THEN ay ELSE y END, abs(o.x - ax) <= 2 AND abs(o.y - ay) <= 2 FROM r JOIN o ON o.c = r.c AND o.d = r.d AND o.i = r.i + 1) SELECT * FROM r)
    SELECT {PAIR}, dup AS duplicate FROM o JOIN s ON o.c = s.c AND o.d = s.d AND o.i = s.i""")
def pcr_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    p = view.pairs(spark, sf).select(*PAIR.split(", "), "left_chromosome", "right_chromosome", "left_position", "right_position")
    return pairs.pcr_duplicates(p, 2, *PAIR.split(", ")).select(*PAIR.split(", "), "duplicate")


@query("pairs", "SELECT left_chromosome, right_chromosome, left_position, right_position, count(*) - 1 AS copies FROM pairs GROUP BY ALL HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return view.pairs(spark, sf).groupBy("left_chromosome", "right_chromosome", "left_position", "right_position").agg((F.count("*") - 1).alias("copies")).where("copies > 0")


# Regions -------------------------------------------------------------------------------------------
@query("regions", """, chromosomes AS (SELECT chromosome, max(end_) AS length FROM regions GROUP BY chromosome), firsts AS (SELECT *, coalesce(sum(CAST(ceil(length / 300) AS BIGINT)) OVER (ORDER BY chromosome ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_ FROM chromosomes)
    SELECT CAST(first_ + i AS BIGINT) AS ix, chromosome, i * 300 + 1 AS start_pos, least(i * 300 + 300, length) AS end_pos FROM firsts, LATERAL (SELECT unnest(range(CAST(ceil(length / 300) AS BIGINT))) AS i)""")
def fixed_bins(spark: SparkSession, sf: str) -> DataFrame:
    c = regions(spark, sf).groupBy("chromosome").agg(F.max("end").alias("length"))
    return intervals.fixed_bins(c, 300).withColumnRenamed("start", "start_pos").withColumnRenamed("end", "end_pos")


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    """Irregular intervals: one from each supplier, with a score."""
    t = table(spark, sf, "supplier")
    start = F.col("s_suppkey") * 37 % 49000 + 1
    return t.select((F.col("s_suppkey") % 4).alias("chromosome"), start.alias("start"), (start + F.col("s_suppkey") % 7 * 400).alias("end"), (F.col("s_suppkey") % 11).cast("double").alias("score"))


_WIN = ", windows AS (SELECT s_suppkey % 4 AS chromosome, s_suppkey * 37 % 49000 + 1 AS start_, s_suppkey * 37 % 49000 + 1 + s_suppkey % 7 * 400 AS end_, CAST(s_suppkey % 11 AS DOUBLE) AS score FROM supplier) "


@query("regions", _WIN + "SELECT r.ix, w.start_ AS start_pos, w.end_ AS end_pos, least(r.end_, w.end_) - greatest(r.start_, w.start_) + 1 AS overlap FROM regions r JOIN windows w ON r.chromosome = w.chromosome AND r.start_ <= w.end_ AND r.end_ >= w.start_")
def region_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.overlaps(regions(spark, sf), _windows(spark, sf)).select("ix", F.col("b_start").alias("start_pos"), F.col("b_end").alias("end_pos"), "overlap")


@query("reads regions", "SELECT name, rn, ix FROM reads JOIN regions ON reads.chromosome = regions.chromosome AND position BETWEEN start_ AND end_")
def point_in_interval(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.locate(view.reads(spark, sf).select("name", "rn", "chromosome", "position"), regions(spark, sf)).select("name", "rn", "ix")


@query("regions", "SELECT chromosome, min(ix) AS first_bin, max(ix) + 1 AS last_bin, max(end_) AS size FROM regions GROUP BY chromosome")
def chromosome_bins(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.chromosome_bins(regions(spark, sf))


@query("regions", _WIN + """, marked AS (SELECT *, CASE WHEN start_ <= max(end_) OVER (PARTITION BY chromosome ORDER BY start_, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM windows),
    islands AS (SELECT *, sum(fresh) OVER (PARTITION BY chromosome ORDER BY start_, end_ ROWS UNBOUNDED PRECEDING) AS island FROM marked)
    SELECT chromosome, min(start_) AS start_pos, max(end_) AS end_pos, count(*) AS n, round(sum(score * (end_ - start_ + 1)) / sum(end_ - start_ + 1), 6) AS score FROM islands GROUP BY chromosome, island""")
def merge_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.merge(_windows(spark, sf)).select("chromosome", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "n", r6("score", "score"))


@query("regions", _WIN + """, hits AS (SELECT r.ix, least(r.end_, w.end_) - greatest(r.start_, w.start_) + 1 AS f, w.score FROM regions r JOIN windows w ON r.chromosome = w.chromosome AND r.start_ <= w.end_ AND r.end_ >= w.start_)
    SELECT r.ix, round(sum(f * score) / sum(f), 6) AS score FROM regions r LEFT JOIN hits h ON r.ix = h.ix GROUP BY r.ix""")
def binned_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.binned(_windows(spark, sf), regions(spark, sf)).select("ix", r6("score", "score"))


@query("regions", _WIN + "SELECT w.chromosome, w.start_ AS position, (SELECT arg_min(r.ix, r.end_) FROM regions r WHERE r.chromosome = w.chromosome AND r.end_ >= w.start_) AS ix FROM windows w")
def nearest_region(spark: SparkSession, sf: str) -> DataFrame:
    p = _windows(spark, sf).select("chromosome", F.col("start").alias("position"))
    return intervals.nearest(p, regions(spark, sf))


@query("", "SELECT doc_id, round(length(regexp_replace(upper(text), '[^GC]', '', 'g')) / nullif(length(text), 0), 6) AS gc FROM documents")
def gc_content(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", r6(sequences.gc_fraction(F.col("text")), "gc"))


@query("", """WITH RECURSIVE u AS (SELECT doc_id, upper(text) AS s FROM documents), hit(doc_id, s, position) AS (SELECT doc_id, s, CAST(instr(s, 'TION') - 1 AS BIGINT) FROM u WHERE instr(s, 'TION') > 0
    UNION ALL SELECT doc_id, s, position + CAST(instr(substr(s, position + 2), 'TION') AS BIGINT) FROM hit WHERE instr(substr(s, position + 2), 'TION') > 0) SELECT doc_id, position FROM hit""")
def restriction_sites(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("name"), F.col("text").alias("sequence"))
    return intervals.cut_sites(d, "TION").select(F.col("name").alias("doc_id"), "position")


@query("regions", "SELECT row_number() OVER (ORDER BY ix) - 1 AS ix, ix AS old_ix, chromosome FROM regions WHERE chromosome % 2 = 1")
def subset_reindex(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.subset(regions(spark, sf), F.col("chromosome") % 2 == 1).select("ix", "old_ix", "chromosome")


# Matrices ------------------------------------------------------------------------------------------
@query("edges", "SELECT * FROM edges")
def pairs_to_edges(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf)


@query("edges", "SELECT * FROM edges WHERE (source >= 5 AND source < 25 AND sink >= 15 AND sink < 60) OR (sink >= 5 AND sink < 25 AND source >= 15 AND source < 60)")
def edge_subset(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.subset_edges(edges(spark, sf), (5, 25), (15, 60))


@query("marginals regions", "SELECT r.ix, coalesce(marginal, 0) AS marginal FROM regions r LEFT JOIN marginals m ON r.ix = m.ix")
def marginals(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.marginals(edges(spark, sf), regions(spark, sf))


@query("valid", "SELECT ix, valid FROM valid")
def valid_regions(spark: SparkSession, sf: str) -> DataFrame:
    return view.valid(spark, sf).select("ix", "valid")


@query("marginals", ", kept AS (SELECT ix FROM marginals, (SELECT 0.98 * quantile_cont(marginal, 0.5) AS cut FROM marginals WHERE marginal > 0) WHERE marginal >= cut) SELECT * FROM edges WHERE source IN (SELECT ix FROM kept) AND sink IN (SELECT ix FROM kept)")
def low_coverage_filter(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.low_coverage(edges(spark, sf), relative=0.98).select("source", "sink", "weight")


@query("edges", "SELECT * FROM edges WHERE abs(source - sink) > 2")
def diagonal_filter(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).where(matrix.near_diagonal(2))


@query("possible", "SELECT * FROM possible")
def possible_contacts(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.possible_contacts(view.valid(spark, sf))


@query("expected", "SELECT chromosome, distance, CAST(possible AS BIGINT) AS possible, CAST(total AS BIGINT) AS total, round(expected, 6) AS expected FROM expected UNION ALL SELECT NULL, distance, CAST(sum(possible) AS BIGINT), CAST(sum(total) AS BIGINT), round(sum(total) / sum(possible), 6) FROM expected GROUP BY distance")
def expected_values(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.expected(edges(spark, sf), view.valid(spark, sf)).withColumn("expected", rounded("expected", 6))


@query("edges valid", """, n AS (SELECT chromosome, count(*) AS n FROM valid WHERE valid GROUP BY chromosome) SELECT CAST(possible AS BIGINT) AS possible, CAST(total AS BIGINT) AS total, round(total / possible, 6) AS expected FROM
    (SELECT sum(a.n * b.n) AS possible FROM n a JOIN n b ON a.chromosome < b.chromosome), (SELECT sum(weight) AS total FROM edges WHERE source // 50 <> sink // 50)""")
def expected_inter(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.expected_inter(edges(spark, sf), view.valid(spark, sf)).withColumn("expected", rounded("expected", 6))


@query("oe", "SELECT chromosome, source, sink, distance, weight, round(expected, 6) AS expected, round(oe, 6) AS oe FROM oe")
def oe_edges(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.observed_expected(edges(spark, sf), view.valid(spark, sf)).withColumns({c: rounded(c, 6) for c in ("expected", "oe")})


@query("oe", "SELECT chromosome, source, sink, distance, weight, round(expected, 6) AS expected, round(oe, 6) AS oe FROM oe ORDER BY round(oe, 6) DESC, source, sink LIMIT 50")
def top_oe_edges(spark: SparkSession, sf: str) -> DataFrame:
    return oe_edges(spark, sf).orderBy(F.desc("oe"), "source", "sink").limit(50)


@query("edges", "SELECT CAST(cis AS BIGINT) AS cis, CAST(trans AS BIGINT) AS trans, round(cis / (cis + trans), 6) AS ratio FROM (SELECT sum(CASE WHEN source // 50 = sink // 50 THEN weight ELSE 0 END) AS cis, sum(CASE WHEN source // 50 <> sink // 50 THEN weight ELSE 0 END) AS trans FROM edges)")
def cis_trans_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.cis_trans(edges(spark, sf), regions(spark, sf)).withColumn("ratio", rounded("ratio", 6))


@query("edges valid", """, n AS (SELECT chromosome, count(*) AS n FROM valid WHERE valid GROUP BY chromosome), s AS (SELECT sum(n * (n + 1) / 2) AS pc, (sum(n) * sum(n) - sum(n * n)) / 2 AS pt FROM n)
    SELECT CAST(cis AS BIGINT) AS cis, CAST(trans AS BIGINT) AS trans, round(cis / (cis + pc / pt * trans), 6) AS ratio FROM s, (SELECT sum(CASE WHEN source // 50 = sink // 50 THEN weight ELSE 0 END) AS cis, sum(CASE WHEN source // 50 <> sink // 50 THEN weight ELSE 0 END) AS trans FROM edges)""")
def cis_trans_normalised(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.cis_trans(edges(spark, sf), view.valid(spark, sf), normalise=True).withColumn("ratio", rounded("ratio", 6))


@query("edges_a edges_n", "SELECT round((SELECT sum(weight) FROM edges_a) / (SELECT sum(weight) FROM edges_n), 6) AS factor")
def scaling_factor(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.scaling_factor(edges(spark, sf, "A"), edges(spark, sf, "N")).select(r6("factor", "factor"))


@query("edges", "SELECT source // 5 AS source, sink // 5 AS sink, CAST(sum(weight) AS BIGINT) AS weight FROM edges GROUP BY ALL")
def rebin_nested(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.rebin_nested(edges(spark, sf), 5, tasks=view.tasks(spark, sf))


@query("edges", """, t AS (SELECT weight, list_sort(list_distinct([{'a': least(x, y), 'b': greatest(x, y)} FOR x, y IN [1]])) AS t FROM (SELECT 1 AS weight, 1 AS x, 1 AS y)) SELECT 1""")
def rebin_split(spark: SparkSession, sf: str) -> DataFrame:
    m = regions(spark, sf).select("ix", F.expr("ix * 10 div 7").alias("first"), F.expr("(ix * 10 + 9) div 7").alias("last"))
    return matrix.rebin_split(edges(spark, sf), m, view.tasks(spark, sf))


ORACLES["rebin_split"] = sql("edges", """, m AS (SELECT *, source * 10 // 7 AS sf, (source * 10 + 9) // 7 AS sl, sink * 10 // 7 AS tf, (sink * 10 + 9) // 7 AS tl FROM edges),
    c AS (SELECT source AS es, sink AS et, weight, unnest([[sf, tf], [sf, tl], [sl, tf], [sl, tl]]) AS p FROM m), d AS (SELECT DISTINCT es, et, weight, least(p[1], p[2]) AS a, greatest(p[1], p[2]) AS b FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY es, et ORDER BY a, b) - 1 AS i, count(*) OVER (PARTITION BY es, et) AS n FROM d)
    SELECT a AS source, b AS sink, CAST(sum(weight // n + CASE WHEN i < weight % n THEN 1 ELSE 0 END) AS BIGINT) AS weight FROM r GROUP BY a, b HAVING sum(weight // n + CASE WHEN i < weight % n THEN 1 ELSE 0 END) > 0""")


@query("edges_a edges_r", "SELECT source, sink, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT * FROM edges_a UNION ALL SELECT * FROM edges_r) GROUP BY source, sink")
def merge_matrices(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.merge(edges(spark, sf, "A"), edges(spark, sf, "R"))


@query("pairs", "SELECT sample, count(*) AS n FROM (SELECT sample FROM pairs WHERE sample = 'A' UNION ALL SELECT sample FROM pairs WHERE sample <> 'N') GROUP BY sample")
def union_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = view.pairs(spark, sf)
    return p.where("sample = 'A'").unionByName(p.where("sample <> 'N'")).groupBy("sample").agg(F.count("*").alias("n"))


@query("edges", """, c AS (SELECT source, sink, unnest(range(1, weight + 1)) AS i FROM edges), h AS (SELECT *, CAST('0x' || substr(md5(concat_ws('|', source, sink, i, 0)), 1, 10) AS BIGINT) AS h FROM c)
    SELECT source, sink, count(*) AS weight FROM (SELECT * FROM h ORDER BY h, source, sink, i LIMIT 5000) GROUP BY source, sink""")
def downsample_hash(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.downsample(edges(spark, sf), 5000)


@query("edges_a edges_n", "SELECT source AS i, sink AS j, CAST(weight AS DOUBLE) AS weight FROM edges_a UNION ALL SELECT sink, source, weight * 0.5 FROM edges_n WHERE source < sink")
def split_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.split_matrix(edges(spark, sf, "A"), edges(spark, sf, "N"), 0.5)


@query("marginals", "SELECT ix, round(1 / marginal, 9) AS bias FROM marginals")
def vc_norm(spark: SparkSession, sf: str) -> DataFrame:
    return balance.vanilla(edges(spark, sf)).select("ix", rounded("bias", 9).alias("bias"))


@query("marginals", "SELECT ix, round(1 / sqrt(marginal), 9) AS bias FROM marginals")
def sqrt_vc_norm(spark: SparkSession, sf: str) -> DataFrame:
    return balance.vanilla(edges(spark, sf), sqrt=True).select("ix", rounded("bias", 9).alias("bias"))


@query("marginals", "SELECT e.source, e.sink, round(e.weight / sqrt(a.marginal) / sqrt(b.marginal), 9) AS weight FROM edges e JOIN marginals a ON a.ix = e.source JOIN marginals b ON b.ix = e.sink")
def normalised_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return matrix.normalised(e, balance.vanilla(e, sqrt=True)).select("source", "sink", rounded("weight", 9).alias("weight"))


@query()
def ice_balance(spark: SparkSession, sf: str) -> DataFrame:
    return balance.ice(edges(spark, sf), tasks=view.tasks(spark, sf))


@query()
def kr_balance(spark: SparkSession, sf: str) -> DataFrame:
    return balance.kr(edges(spark, sf), tasks=view.tasks(spark, sf))


# Tracks --------------------------------------------------------------------------------------------
_SQUARE = """, sq AS (SELECT k.ix, k.chromosome, k.ix - k.first_ AS k, k.size_ AS n, (SELECT count(*) FROM extent v WHERE v.chromosome = k.chromosome AND NOT v.valid AND v.ix > k.ix - 1 - 3 AND v.ix <= k.ix - 1) AS v,
    (SELECT count(*) FROM extent v WHERE v.chromosome = k.chromosome AND NOT v.valid AND v.ix >= k.ix + 1 AND v.ix < k.ix + 1 + 3) AS h FROM extent k),
    s AS (SELECT k.ix, sum(c.weight) AS s FROM extent k JOIN cis c ON c.chromosome = k.chromosome AND c.source <= k.ix - 1 AND c.sink >= k.ix + 1 AND c.source > k.ix - 4 AND c.sink < k.ix + 4 GROUP BY k.ix),
    raw AS (SELECT sq.ix, chromosome, CASE WHEN k - 1 >= 2 AND k + 1 <= n - 3 AND 3 * v + 3 * h - v * h <= 4.5 THEN coalesce(s, 0) / (9 - (3 * v + 3 * h - v * h)) END AS x FROM sq LEFT JOIN s ON sq.ix = s.ix)
    SELECT ix, round(CASE WHEN x > 0 THEN log2(x / avg(x) OVER (PARTITION BY chromosome)) END, 6) AS score FROM raw"""


@query("extent cis", _SQUARE)
def insulation(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.insulation(edges(spark, sf), view.valid(spark, sf), 3).select("ix", r6("score", "score"))


@query("extent cis", """, e AS (SELECT *, least(ix - first_, first_ + size_ - 1 - ix) AS edge FROM extent), a AS (SELECT e.ix, sum(c.weight) AS a FROM e JOIN cis c ON c.sink = e.ix WHERE c.distance BETWEEN 1 AND 4 AND e.edge >= c.distance GROUP BY e.ix),
    b AS (SELECT e.ix, sum(c.weight) AS b FROM e JOIN cis c ON c.source = e.ix WHERE c.distance BETWEEN 1 AND 4 AND e.edge >= c.distance GROUP BY e.ix),
    m AS (SELECT e.ix, coalesce(a, 0) AS a, coalesce(b, 0) AS b, (SELECT count(*) FROM extent v WHERE v.chromosome = e.chromosome AND v.valid AND v.ix >= e.ix - 4 AND v.ix < e.ix) AS lm, (SELECT count(*) FROM extent v WHERE v.chromosome = e.chromosome AND v.valid AND v.ix >= e.ix AND v.ix < e.ix + 4) AS rm
    FROM e LEFT JOIN a ON a.ix = e.ix LEFT JOIN b ON b.ix = e.ix), f AS (SELECT ix, a + a / nullif(lm, 0) * (4 - lm) AS a, b + b / nullif(rm, 0) * (4 - rm) AS b, lm, rm FROM m)
    SELECT ix, round(CASE WHEN lm < 2 OR rm < 2 THEN NULL WHEN a = b OR a + b = 0 THEN 0 ELSE sign(b - a) * (pow(a - (a + b) / 2, 2) / ((a + b) / 2) + pow(b - (a + b) / 2, 2) / ((a + b) / 2)) END, 6) AS score FROM f""")
def directionality(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.directionality(edges(spark, sf), view.valid(spark, sf), 4).select("ix", r6("score", "score"))


_DELTA = "(avg(score) OVER (PARTITION BY chromosome ORDER BY ix ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) - score) - (avg(score) OVER (PARTITION BY chromosome ORDER BY ix ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) - score)"


@query("tracks", f"SELECT ix, round({_DELTA}, 6) AS delta FROM tracks")
def delta_window(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.delta(view.tracks(spark, sf), 3, "chromosome").select("ix", r6("delta", "delta"))


@query("tracks", "SELECT ix, round(avg(score) OVER (PARTITION BY chromosome ORDER BY ix ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean FROM tracks")
def sliding_mean(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.sliding_mean(view.tracks(spark, sf), 2, "chromosome").select("ix", r6("mean", "mean"))


@query("tracks", f""", d AS (SELECT chromosome, ix, round({_DELTA}, 6) AS d FROM tracks), n AS (SELECT chromosome, row_number() OVER (PARTITION BY chromosome ORDER BY ix) - 1 AS i, d AS a, lead(d) OVER (PARTITION BY chromosome ORDER BY ix) AS b FROM d)
    SELECT DISTINCT chromosome, CAST(round_even(i + a / (a - b), 0) AS BIGINT) AS position FROM n WHERE (a < 0 AND b > 0) OR (a > 0 AND b < 0)""")
def zero_crossings(spark: SparkSession, sf: str) -> DataFrame:
    d = tracks.delta(view.tracks(spark, sf), 3, "chromosome").withColumn("delta", rounded("delta", 6))
    return tracks.zero_crossings(d, "delta", "chromosome")


@query()
def boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.boundaries(view.tracks(spark, sf), 3, False, "chromosome")


@query("tracks", """, s AS (SELECT *, CAST(sign(score) AS BIGINT) AS sign FROM tracks), m AS (SELECT *, CASE WHEN lag(ix) OVER w IS NOT NULL AND lag(sign) OVER w IS NOT DISTINCT FROM sign THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY chromosome ORDER BY ix)),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY chromosome ORDER BY ix ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT chromosome, sign, min(ix) AS first, max(ix) AS last, count(*) AS n, round(avg(score), 6) AS score FROM r GROUP BY chromosome, run, sign""")
def ab_domains(spark: SparkSession, sf: str) -> DataFrame:
    t = view.tracks(spark, sf).withColumn("sign", F.signum("score").cast("long"))
    return tracks.runs(t).select("chromosome", "sign", "first", "last", "n", r6("score", "score"))


@query()
def compartment_eigenvector(spark: SparkSession, sf: str) -> DataFrame:
    v = view.valid(spark, sf)
    return compartments.compartments(compartments.eigenvector(matrix.observed_expected(edges(spark, sf), v), v))


@query("oe valid", """, dense AS (SELECT a.chromosome, a.ix AS i, b.ix AS j, coalesce(o.oe, p.oe, 1.0) AS x FROM valid a JOIN valid b ON a.chromosome = b.chromosome LEFT JOIN oe o ON o.source = a.ix AND o.sink = b.ix LEFT JOIN oe p ON p.source = b.ix AND p.sink = a.ix AND a.ix <> b.ix)
    SELECT a.chromosome, a.i AS source, b.i AS sink, round(corr(a.x, b.x), 5) AS r FROM dense a JOIN dense b ON a.chromosome = b.chromosome AND a.j = b.j AND b.i >= a.i GROUP BY ALL""")
def row_correlation(spark: SparkSession, sf: str) -> DataFrame:
    v = view.valid(spark, sf)
    return compartments.correlation(matrix.observed_expected(edges(spark, sf), v), v).withColumn("r", rounded("r", 5))


# Comparisons ---------------------------------------------------------------------------------------
_BOTH = "SELECT coalesce(a.source, b.source) AS source, coalesce(a.sink, b.sink) AS sink, coalesce(a.weight, 0) AS a, coalesce(b.weight, 0) AS b FROM edges_a a FULL JOIN edges_n b ON a.source = b.source AND a.sink = b.sink"


@query("edges_a edges_n", f"SELECT source, sink, round(log2(a / b), 6) AS weight FROM ({_BOTH}) WHERE a > 0 AND b > 0")
def fold_change_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return compare.compare_matrices(edges(spark, sf, "A"), edges(spark, sf, "N"), log=True, ignore_zeros=True).withColumn("weight", rounded("weight", 6))


@query("edges_a edges_n", f"SELECT source, sink, CAST(a - b AS DOUBLE) AS weight FROM ({_BOTH})")
def difference_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return compare.compare_matrices(edges(spark, sf, "A"), edges(spark, sf, "N"), compare.difference)


def _sample_track(spark: SparkSession, sf: str, sample: str) -> DataFrame:
    return matrix.marginals(edges(spark, sf, sample)).select("ix", F.col("marginal").cast("double").alias("score"))


@query("edges_a edges_n", """, ma AS (SELECT bin AS ix, sum(weight) AS m FROM (SELECT source AS bin, weight FROM edges_a UNION ALL SELECT sink, weight FROM edges_a WHERE source <> sink) GROUP BY bin),
    mb AS (SELECT bin AS ix, sum(weight) AS m FROM (SELECT source AS bin, weight FROM edges_n UNION ALL SELECT sink, weight FROM edges_n WHERE source <> sink) GROUP BY bin) SELECT ma.ix, round(log2(ma.m / mb.m), 6) AS score FROM ma JOIN mb ON ma.ix = mb.ix""")
def compare_scores(spark: SparkSession, sf: str) -> DataFrame:
    return compare.compare_scores(_sample_track(spark, sf, "A"), _sample_track(spark, sf, "N"), compare.fold_change, log=True).withColumn("score", rounded("score", 6))


_SAMPLES = ["A", "N", "R"]
_WIDE = "pairs", ", wide AS (SELECT source, sink, CAST(count(*) FILTER (sample = 'A') AS DOUBLE) AS A, CAST(count(*) FILTER (sample = 'N') AS DOUBLE) AS N, CAST(count(*) FILTER (sample = 'R') AS DOUBLE) AS R FROM pairs GROUP BY source, sink) "


def _collection(spark: SparkSession, sf: str) -> DataFrame:
    """The three samples' edges side by side, from one scan of the pairs."""
    counts = [F.count(F.when(F.col("sample") == s, 1)).cast("double").alias(s) for s in _SAMPLES]
    p = view.pairs(spark, sf).select("source", "sink", "sample").repartition(view.tasks(spark, sf), "source", "sink")
    return p.groupBy("source", "sink").agg(*counts)


@query(_WIDE[0], _WIDE[1] + "SELECT * FROM wide WHERE A > 0 OR N > 0 OR R > 0")
def edge_collection(spark: SparkSession, sf: str) -> DataFrame:
    return compare.collect_edges({s: edges(spark, sf, s) for s in _SAMPLES})


@query(_WIDE[0], _WIDE[1] + "SELECT * FROM wide WHERE A <> 0 AND N <> 0 AND R <> 0 AND sink - source >= 2 AND (CASE WHEN A >= 3 THEN 1 ELSE 0 END + CASE WHEN N >= 3 THEN 1 ELSE 0 END + CASE WHEN R >= 3 THEN 1 ELSE 0 END) >= 2")
def edge_collection_filters(spark: SparkSession, sf: str) -> DataFrame:
    return compare.keep_edges(_collection(spark, sf), _SAMPLES, nonzero=True, absolute=3, least=2, least_distance=2)


@query(_WIDE[0], _WIDE[1] + "SELECT *, round((pow(A - (A + N + R) / 3, 2) + pow(N - (A + N + R) / 3, 2) + pow(R - (A + N + R) / 3, 2)) / 3, 6) AS variance FROM wide ORDER BY variance DESC, source, sink LIMIT 100")
def top_variance_edges(spark: SparkSession, sf: str) -> DataFrame:
    c = _collection(spark, sf)
    m = (F.col("A") + F.col("N") + F.col("R")) / 3
    var = rounded(((F.col("A") - m) * (F.col("A") - m) + (F.col("N") - m) * (F.col("N") - m) + (F.col("R") - m) * (F.col("R") - m)) / 3, 6)
    return c.withColumn("variance", var).orderBy(F.desc("variance"), "source", "sink").limit(100)


@query(_WIDE[0], _WIDE[1] + "SELECT *, round(greatest(A, N, R) / nullif(least(A, N, R), 0), 6) AS fold_change FROM wide WHERE least(A, N, R) > 0 ORDER BY greatest(A, N, R) / least(A, N, R) DESC, source, sink LIMIT 100")
def top_fold_change_edges(spark: SparkSession, sf: str) -> DataFrame:
    return compare.top_by_fold_change(_collection(spark, sf), _SAMPLES, 100).withColumn("fold_change", rounded("fold_change", 6))


@query(_WIDE[0], _WIDE[1] + """, c AS (SELECT A - (A + N + R) / 3 AS A, N - (A + N + R) / 3 AS N, R - (A + N + R) / 3 AS R FROM wide) SELECT a, b, round(value, 4) AS value FROM (SELECT 'A' AS a, 'A' AS b, sum(A * A) AS value FROM c UNION ALL SELECT 'A', 'N', sum(A * N) FROM c UNION ALL SELECT 'A', 'R', sum(A * R) FROM c
    UNION ALL SELECT 'N', 'N', sum(N * N) FROM c UNION ALL SELECT 'N', 'R', sum(N * R) FROM c UNION ALL SELECT 'R', 'R', sum(R * R) FROM c)""")
def sample_gram_pca(spark: SparkSession, sf: str) -> DataFrame:
    return compare.gram(_collection(spark, sf), _SAMPLES).withColumn("value", rounded("value", 4))


@query()
def sample_components(spark: SparkSession, sf: str) -> DataFrame:
    return compare.principal_components(_collection(spark, sf), _SAMPLES)


# Pile-ups ------------------------------------------------------------------------------------------
_PILE = """, span AS (SELECT unnest(range(-3, 4)) AS i), cell AS (SELECT w.id, s.i, t.i AS j, w.a + s.i AS bin, w.b + t.i AS other FROM w, span s, span t),
    pile AS (SELECT c.i, c.j, coalesce(e.weight, 0) AS v FROM cell c JOIN valid x ON x.ix = c.bin AND x.valid JOIN valid y ON y.ix = c.other AND y.valid LEFT JOIN ends e ON e.bin = c.bin AND e.other = c.other)
    SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(avg(v), 6) AS value, count(*) AS n FROM pile GROUP BY i, j"""
_INSIDE = "JOIN extent x ON x.ix = q.a AND q.a - 3 >= x.first_ AND q.a + 3 < x.first_ + x.size_ JOIN extent y ON y.ix = q.b AND q.b - 3 >= y.first_ AND q.b + 3 < y.first_ + y.size_"


def _pile(spark: SparkSession, sf: str, windows: DataFrame) -> DataFrame:
    out = aggregate.pile_up(windows, edges(spark, sf), view.valid(spark, sf), 3)
    return out.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r6("value", "value"), "n")


@query("extent ends", f", q AS (SELECT ix AS id, ix AS a, ix AS b FROM regions), w AS (SELECT q.* FROM q {_INSIDE}) " + _PILE)
def aggregate_center(spark: SparkSession, sf: str) -> DataFrame:
    w = regions(spark, sf).select(F.col("ix").alias("id"), F.col("ix").alias("row"), F.col("ix").alias("column"))
    return _pile(spark, sf, w)


def _loops(spark: SparkSession, sf: str) -> DataFrame:
    return regions(spark, sf).select(F.col("ix").alias("id"), F.col("ix").alias("row"), (F.col("ix") + 6 + F.col("ix") % 3).alias("column"))


@query("extent ends", f", q AS (SELECT ix AS id, ix AS a, ix + 6 + ix % 3 AS b FROM regions), w AS (SELECT q.* FROM q {_INSIDE}) " + _PILE)
def aggregate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _pile(spark, sf, _loops(spark, sf))


@query("extent oe", f""", oe2 AS (SELECT source AS bin, sink AS other, oe FROM oe UNION ALL SELECT sink, source, oe FROM oe WHERE source <> sink), l AS (SELECT r.ix AS id, r.ix AS a, r.ix + 6 + r.ix % 3 AS b, r.chromosome AS home FROM regions r),
    k AS (SELECT id, home, k, a + k * (b - a) AS a, b + k * (b - a) AS b FROM l, (SELECT unnest([-1, 0, 1]) AS k)), q AS (SELECT k.* FROM k JOIN regions g ON g.ix = k.a AND g.chromosome = k.home JOIN regions h ON h.ix = k.b AND h.chromosome = k.home), w AS (SELECT q.* FROM q {_INSIDE}),
    span AS (SELECT unnest(range(-3, 4)) AS i), v AS (SELECT w.id, w.k, avg(coalesce(o.oe, 1.0)) AS m FROM w, span s, span t, valid x, valid y LEFT JOIN oe2 o ON o.bin = w.a + s.i AND o.other = w.b + t.i WHERE x.ix = w.a + s.i AND x.valid AND y.ix = w.b + t.i AND y.valid GROUP BY w.id, w.k),
    g AS (SELECT id, max(m) FILTER (k = 0) AS m, avg(m) FILTER (k <> 0) AS c FROM v GROUP BY id) SELECT id, round(log2(m / c), 6) AS strength FROM g WHERE m > 0 AND c > 0""")
def loop_strength(spark: SparkSession, sf: str) -> DataFrame:
    v = view.valid(spark, sf)
    oe = matrix.observed_expected(edges(spark, sf), v)
    return aggregate.loop_strength(_loops(spark, sf), oe, v, 3).select("id", r6("strength", "strength"))


_DOMAINS = ", d AS (SELECT x.ix AS id, x.ix AS a, x.ix + {0} AS b, {0} + 1 AS n, x.first_, x.size_ FROM extent x), w AS (SELECT *, a - {1} AS lo, b + {1} AS hi FROM d WHERE a - {1} >= first_ AND b + {1} < first_ + size_)"


@query("extent oe", _DOMAINS.format("6", "7") + """, c AS (SELECT w.id, CASE WHEN x.ix < w.a THEN 0 WHEN x.ix <= w.b THEN 1 ELSE 2 END AS s, CASE WHEN y.ix < w.a THEN 0 WHEN y.ix <= w.b THEN 1 ELSE 2 END AS t, coalesce(o.oe, 1.0) AS v
    FROM w JOIN extent x ON x.ix BETWEEN w.lo AND w.hi AND x.valid JOIN extent y ON y.ix BETWEEN w.lo AND w.hi AND y.valid LEFT JOIN oe o ON o.source = least(x.ix, y.ix) AND o.sink = greatest(x.ix, y.ix)),
    m AS (SELECT id, avg(v) FILTER (s = 1 AND t = 1) AS m, avg(v) FILTER (s = 0 AND t = 1) AS l, avg(v) FILTER (s = 1 AND t = 2) AS r FROM c GROUP BY id) SELECT id, round(CASE WHEN m > 0 AND l + r > 0 THEN log2(m / ((l + r) / 2)) END, 6) AS strength FROM m""")
def tad_strength(spark: SparkSession, sf: str) -> DataFrame:
    v = view.valid(spark, sf)
    d = regions(spark, sf).select(F.col("ix").alias("id"), F.col("ix").alias("first"), (F.col("ix") + 6).alias("last"))
    return aggregate.tad_strength(d, matrix.observed_expected(edges(spark, sf), v), v).select("id", r6("strength", "strength"))


@query("oe tracks valid", """, cut AS (SELECT quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS c FROM tracks t JOIN valid v ON t.ix = v.ix WHERE valid AND score IS NOT NULL), g AS (SELECT t.ix, t.chromosome, CAST(len(list_filter(c, lambda x: x < score)) AS BIGINT) AS g FROM tracks t JOIN valid v ON t.ix = v.ix, cut WHERE valid AND score IS NOT NULL)
    SELECT greatest(x.g, y.g) AS a, least(x.g, y.g) AS b, round(avg(coalesce(oe, 1.0)), 6) AS value, count(*) AS n FROM g x JOIN g y ON x.chromosome = y.chromosome AND y.ix >= x.ix LEFT JOIN oe ON oe.source = x.ix AND oe.sink = y.ix GROUP BY ALL""")
def saddle(spark: SparkSession, sf: str) -> DataFrame:
    v = view.valid(spark, sf)
    out = aggregate.saddle(matrix.observed_expected(edges(spark, sf), v), v, view.tracks(spark, sf).select("ix", "score"), 5)
    return out.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), r6("value", "value"), "n")


@query("ends", "SELECT other AS ix, round(sum(weight) / 3, 6) AS score FROM ends WHERE bin BETWEEN 4 AND 6 GROUP BY other")
def virtual_4c(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.virtual_4c(edges(spark, sf), 4, 6).select("ix", r6("score", "score"))


@query("tracks", "SELECT o AS \"offset\", round(avg(score), 6) AS score, count(score) AS n FROM (SELECT ix AS spot, chromosome AS c FROM regions), (SELECT unnest(range(-5, 6)) AS o) JOIN tracks t ON t.ix = spot + o AND t.chromosome = c GROUP BY o")
def meta_profile(spark: SparkSession, sf: str) -> DataFrame:
    out = aggregate.meta_profile(view.tracks(spark, sf), regions(spark, sf), 5)
    return out.select(F.col("offset").cast("long").alias("offset"), r6("score", "score"), "n")


@query("extent ends", """, a AS (SELECT ix, CASE WHEN ix % 2 = 0 THEN 1 ELSE -1 END AS strand FROM extent WHERE ix - 5 >= first_ AND ix + 5 < first_ + size_), c AS (SELECT a.strand, d, side, coalesce(weight, 0) AS v FROM a, (SELECT unnest(range(1, 6)) AS d), (SELECT unnest([-1, 1]) AS side) LEFT JOIN ends e ON e.bin = a.ix AND e.other = a.ix + side * d)
    SELECT CAST(strand AS BIGINT) AS strand, d AS distance, round(avg(v) FILTER (side * strand > 0) / nullif(avg(v) FILTER (side * strand < 0), 0), 6) AS ratio FROM c GROUP BY strand, d""")
def directionality_bias(spark: SparkSession, sf: str) -> DataFrame:
    a = regions(spark, sf).select(F.col("ix").alias("id"), "ix", F.when(F.col("ix") % 2 == 0, 1).otherwise(-1).alias("strand"))
    out = aggregate.directionality_bias(a, edges(spark, sf), regions(spark, sf), 5)
    return out.select(F.col("strand").cast("long").alias("strand"), F.col("distance").cast("long").alias("distance"), r6("ratio", "ratio"))


# Loops ---------------------------------------------------------------------------------------------
def _until_gone(out: DataFrame, *parts: DataFrame) -> DataFrame:
    """out; what it is made from stays in the cache until it goes."""
    for x in parts:
        weakref.finalize(out, x.unpersist).atexit = False
    return out


@query()
def loop_candidates(spark: SparkSession, sf: str) -> DataFrame:
    v = view.valid(spark, sf).withColumn("bias", F.lit(1.0)).repartition(view.tasks(spark, sf), "ix").persist()
    e = edges(spark, sf, cis=True).persist()
    cis = matrix.with_ends(e, v, "chromosome").where("source_chromosome = sink_chromosome").select(F.col("source_chromosome").alias("chromosome"), "source", "sink", "weight")
    return _until_gone(loops.call(cis, matrix.expected(e, v), v, 1, 4, least_reads=4), v, e)


@query()
def fdr_table(spark: SparkSession, sf: str) -> DataFrame:
    p = loop_candidates(spark, sf)
    return _until_gone(loops.fdr_table(p), p)


@query("oe", "SELECT chromosome, source, sink, weight FROM oe WHERE weight >= 2 AND distance >= 3 AND oe >= 1.2")
def peak_filters(spark: SparkSession, sf: str) -> DataFrame:
    oe = matrix.observed_expected(edges(spark, sf), view.valid(spark, sf))
    flat = {f"{a}_{k}": F.col(c) for k in loops.KINDS for a, c in (("e", "expected"), ("oe", "oe"))}
    rows, _ = masks.apply_filters(oe.withColumns(flat), loops.peak_filters(observed=2, distance=3, enrichment=1.2))
    return masks.visible(rows).select("chromosome", "source", "sink", "weight")


@query()
def enriched_peaks(spark: SparkSession, sf: str) -> DataFrame:
    p = loop_candidates(spark, sf).persist()  # its table and its rows come from one run
    out = loops.with_fdr(p, loops.fdr_table(p)).where(loops.enriched()).select("chromosome", "source", "sink", "weight", *[f"fdr_{k}" for k in loops.KINDS])
    return _until_gone(out, p)


def _strong(spark: SparkSession, sf: str) -> DataFrame:
    oe = matrix.observed_expected(edges(spark, sf), view.valid(spark, sf))
    return oe.where("oe >= 2 and distance >= 2").select("chromosome", "source", "sink", F.col("weight").cast("double").alias("weight"), (1 / F.col("oe")).alias("q"))


@query()
def merge_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return loops.merge_peaks(_strong(spark, sf), 2)


@query()
def overlap_peaks(spark: SparkSession, sf: str) -> DataFrame:
    p = None
    for s in _SAMPLES:
        e = edges(spark, sf, s).where("weight >= 3 and sink - source between 2 and 40").select((F.expr("source div 50")).alias("chromosome"), F.col("source").cast("double").alias("x"), F.col("sink").cast("double").alias("y"), F.col("weight").cast("double").alias("weight"), F.lit(s).alias("sample"))
        p = e if p is None else p.unionByName(e)
    return loops.overlap_peaks(p, 2)


# Further variants ----------------------------------------------------------------------------------
@query("extent cis", """, w AS (SELECT e.ix, least(e.ix - e.first_, 3) AS l, least(e.first_ + e.size_ - 1 - e.ix, 3) AS r FROM extent e), a AS (SELECT sink AS ix, sum(weight) AS s FROM cis WHERE distance BETWEEN 1 AND 3 GROUP BY sink), b AS (SELECT source AS ix, sum(weight) AS s FROM cis WHERE distance BETWEEN 1 AND 3 GROUP BY source)
    SELECT w.ix, round(coalesce(a.s, 0) / nullif(l, 0), 6) AS "left", round(coalesce(b.s, 0) / nullif(r, 0), 6) AS "right" FROM w LEFT JOIN a ON a.ix = w.ix LEFT JOIN b ON b.ix = w.ix""")
def contact_average(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.contact_average(edges(spark, sf), regions(spark, sf), 3).select("ix", r6("left", "left"), r6("right", "right"))


@query("tracks", ", r AS (SELECT chromosome, score, row_number() OVER (PARTITION BY chromosome ORDER BY score) AS r, count(*) OVER (PARTITION BY chromosome) AS n FROM tracks WHERE score IS NOT NULL) SELECT chromosome, round(avg(score), 6) AS mean FROM r WHERE r > floor(n * 0.1) AND r <= n - floor(n * 0.1) GROUP BY chromosome")
def trimmed_mean(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.trimmed_mean(view.tracks(spark, sf), "score", 0.1, "chromosome").select("chromosome", r6("mean", "mean"))


@query("extent cis", _SQUARE.replace("CASE WHEN x > 0 THEN log2(x / avg(x) OVER (PARTITION BY chromosome)) END", "x - avg(x) OVER (PARTITION BY chromosome ORDER BY ix ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"))
def insulation_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.insulation(edges(spark, sf), view.valid(spark, sf), 3, sliding=5, subtract=True, log=False).select("ix", r6("score", "score"))


@query("extent cis", _SQUARE.replace("log2(x / avg(x) OVER (PARTITION BY chromosome))", "log2(x / exp(avg(CASE WHEN x > 0 THEN ln(x) END) OVER (PARTITION BY chromosome)))"))
def insulation_geometric(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.insulation(edges(spark, sf), view.valid(spark, sf), 3, geometric=True).select("ix", r6("score", "score"))


@query("expected", """, p AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY chromosome) AS n, sum(total) OVER w AS t, sum(possible) OVER w AS p FROM expected WINDOW w AS (PARTITION BY chromosome ORDER BY distance ROWS UNBOUNDED PRECEDING)),
    k AS (SELECT chromosome, distance, i, n, unnest(range(n)) AS k FROM p), e AS (SELECT k.chromosome, k.distance, k.k, k.i - k.k <= 0 AND k.i + k.k + 1 >= k.n AS whole, z.t - coalesce(a.t, 0) AS t, z.p - coalesce(a.p, 0) AS p
    FROM k JOIN p z ON z.chromosome = k.chromosome AND z.i = least(k.n - 1, k.i + k.k) LEFT JOIN p a ON a.chromosome = k.chromosome AND a.i = greatest(0, k.i - k.k) - 1)
    SELECT chromosome, distance, round(arg_min(t / p, k), 6) AS expected FROM e WHERE t >= 400 OR whole GROUP BY chromosome, distance""")
def smoothed_expected(spark: SparkSession, sf: str) -> DataFrame:
    out = tracks.smoothed_expected(matrix.expected(edges(spark, sf), view.valid(spark, sf)).where("chromosome is not null"), 400)
    return out.withColumn("expected", rounded("expected", 6))


@query("edges", "SELECT 0 AS level, source, sink, weight FROM edges UNION ALL SELECT 1, source // 2, sink // 2, CAST(sum(weight) AS BIGINT) FROM edges GROUP BY ALL UNION ALL SELECT 2, source // 4, sink // 4, CAST(sum(weight) AS BIGINT) FROM edges GROUP BY ALL")
def zoom_levels(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.zoom_levels(edges(spark, sf), 3, view.tasks(spark, sf))


@query("edges valid", """, n AS (SELECT chromosome, count(*) AS n FROM valid WHERE valid GROUP BY chromosome), c AS (SELECT 1.5 * (SELECT sum(weight) FROM edges WHERE source // 50 <> sink // 50) / (SELECT sum(a.n * b.n) FROM n a JOIN n b ON a.chromosome < b.chromosome) AS cut) SELECT source, sink, weight FROM edges, c WHERE weight >= cut""")
def background_ligation_filter(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.above_background(edges(spark, sf), view.valid(spark, sf), 1.5)


@query("extent ends", f", q AS (SELECT ix AS id, ix AS a, ix AS b FROM regions), w AS (SELECT q.* FROM q {_INSIDE}) " + _PILE.replace("round(avg(v), 6)", "round(avg(v) * pow(abs(i - j) * 1000 + 1000, -0.25), 6)"))
def aggregate_rescaled(spark: SparkSession, sf: str) -> DataFrame:
    w = regions(spark, sf).select(F.col("ix").alias("id"), F.col("ix").alias("row"), F.col("ix").alias("column"))
    out = aggregate.rescaled(aggregate.pile_up(w, edges(spark, sf), view.valid(spark, sf), 3), 1000)
    return out.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r6("value", "value"), "n")


@query("extent oe", _DOMAINS.format("(4 + x.ix % 4)", "n") + """, g AS (SELECT w.id, i, j, lo + CAST(floor((i + 0.5) * (hi - lo + 1) / 15) AS BIGINT) AS x, lo + CAST(floor((j + 0.5) * (hi - lo + 1) / 15) AS BIGINT) AS y FROM w, (SELECT unnest(range(15)) AS i), (SELECT unnest(range(15)) AS j))
    SELECT i, j, round(avg(coalesce(o.oe, 1.0)), 6) AS value, count(*) AS n FROM g JOIN valid p ON p.ix = g.x AND p.valid JOIN valid q ON q.ix = g.y AND q.valid LEFT JOIN oe o ON o.source = least(g.x, g.y) AND o.sink = greatest(g.x, g.y) GROUP BY i, j""")
def aggregate_domains(spark: SparkSession, sf: str) -> DataFrame:
    v = view.valid(spark, sf)
    d = regions(spark, sf).select(F.col("ix").alias("id"), F.col("ix").alias("first"), (F.col("ix") + 4 + F.col("ix") % 4).alias("last"))
    out = aggregate.pile_up_domains(d, matrix.observed_expected(edges(spark, sf), v), v, 15)
    return out.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r6("value", "value"), "n")


@query("oe tracks valid", ORACLES["saddle"][ORACLES["saddle"].index(", cut AS"):].replace("SELECT greatest(x.g", ", s AS (SELECT greatest(x.g").replace("round(avg(coalesce(oe, 1.0)), 6)", "avg(coalesce(oe, 1.0))").replace("    , s AS", ", s AS") + """) SELECT round(ln(max(value) FILTER (a = 4 AND b = 4) * max(value) FILTER (a = 0 AND b = 0) / pow(max(value) FILTER (a = 4 AND b = 0), 2)), 6) AS strength FROM s""")
def compartment_strength(spark: SparkSession, sf: str) -> DataFrame:
    v = view.valid(spark, sf)
    out = aggregate.saddle(matrix.observed_expected(edges(spark, sf), v), v, view.tracks(spark, sf).select("ix", "score"), 5)
    return compartments.strength(out, 5).select(r6("strength", "strength"))


@query("pairs", f"SELECT {PAIR} FROM pairs ORDER BY {PAIR} LIMIT 1 OFFSET 1000")
def nth_pair(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.nth(view.pairs(spark, sf).select(*PAIR.split(", ")), 1000, *PAIR.split(", "))


# Ordering, statistics, streaming -------------------------------------------------------------------
@query("", "SELECT p_brand, p_partkey, row_number() OVER (ORDER BY CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT), p_partkey) - 1 AS n FROM part")
def natural_sort(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "part").select("p_brand", "p_partkey", sequences.natural_key(F.col("p_brand")).alias("_k"))
    return numbered(t, "_k", "p_partkey").drop("_k")


@query("geometry", "SELECT round(quantile_cont(re, 0.5), 6) AS median, round(quantile_cont(re, 0.95), 6) AS p95 FROM geometry")
def site_distance_distribution(spark: SparkSession, sf: str) -> DataFrame:
    d = view.pairs(spark, sf).select((pairs.re_distance("left") + pairs.re_distance("right")).alias("re"))
    return d.agg(r6(F.percentile("re", F.lit(0.5)), "median"), r6(F.percentile("re", F.lit(0.95)), "p95"))


@query("cis", "SELECT distance, CAST(sum(weight) AS BIGINT) AS total FROM cis GROUP BY distance")
def distance_decay(spark: SparkSession, sf: str) -> DataFrame:
    cis = matrix.with_ends(edges(spark, sf), regions(spark, sf), "chromosome").where("source_chromosome = sink_chromosome")
    return cis.groupBy((F.col("sink") - F.col("source")).alias("distance")).agg(F.sum("weight").alias("total"))


@query("pairs", "SELECT source, sink, count(*) AS weight FROM pairs GROUP BY source, sink")
def incremental_contacts(spark: SparkSession, sf: str) -> DataFrame:
    """The batch form of the streaming count; tests/test_operators.py holds the stream against it."""
    from ..streaming.contacts import incremental_edges

    return incremental_edges(view.pairs(spark, sf), view.tasks(spark, sf))


