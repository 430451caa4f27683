"""Operators that SQL cannot express, sources and sinks, and the stream, against brute force and known values."""

from __future__ import annotations

import math
import os

import numpy as np
import pytest
from conftest import SMALL, rows_of
from pyspark.sql import functions as F

from pairloom.functions import sequences
from pairloom.operators import aggregate, balance, compartments, intervals, loops, masks, matrix, pairs, tracks
from pairloom.plans import registry, view
from pairloom.sources import files
from pairloom.streaming import contacts

EDGES = "source long, sink long, weight double"


def dense(rng, n, fill=0.8):
    m = np.triu(rng.integers(1, 20, (n, n)) * (rng.random((n, n)) < fill)).astype(float)
    m[np.arange(n), np.arange(n)] += 1
    return m + np.triu(m, 1).T


def sparse(spark, m):
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(np.triu(m)), strict=True)], EDGES)


def bins(spark, *sizes):
    rows, ix = [], 0
    for c, n in enumerate(sizes):
        for k in range(n):
            rows.append((ix, f"chr{c + 1}", k * 1000 + 1, k * 1000 + 1000, True))
            ix += 1
    return spark.createDataFrame(rows, "ix long, chromosome string, start long, end long, valid boolean")


@pytest.mark.parametrize("method, tolerance", [("kr", 1e-5), ("ice", 0.02)])
def test_balanced_rows_are_even(spark, method, tolerance):
    m = dense(np.random.default_rng(1), 12)
    b = {r.ix: r.bias for r in balance.normalise(sparse(spark, m), method).collect()}
    v = np.array([b[i] for i in range(12)])
    sums = (v[:, None] * m * v[None, :]).sum(axis=1)
    assert np.abs(sums - sums.mean()).max() / sums.mean() < tolerance
    assert method != "kr" or abs(sums.mean() - 1) < 1e-4


@pytest.mark.parametrize("block, tasks", [(3, 5), (1 << 17, 2), (1 << 17, None)])
def test_products_give_one_sum_for_each_bin_of_a_block(spark, monkeypatch, block, tasks):
    monkeypatch.setattr(balance, "BLOCK", block)
    m = dense(np.random.default_rng(3), 15, 0.5)
    m[2, 7] = m[7, 2] = 300.5
    m[3, 3], m[4, 4] = 60_000, 70_000
    rows = [(7 * int(i), 7 * int(j), float(m[i, j])) for i, j in zip(*np.nonzero(np.triu(m)), strict=True)]
    a = balance._Product(spark.createDataFrame(rows, EDGES), tasks)
    x = np.random.default_rng(4).random(15)
    assert a.ix.tolist() == [7 * i for i in range(15)]
    assert np.allclose(a(x), m @ x, rtol=1e-12)
    blocks = a.rows.toArrow()
    sums = sum(len(r) // 4 for r in blocks.column("rows").to_pylist())
    assert sums <= 15 + blocks.num_rows and sum(blocks.column("n").to_pylist()) == 15  # not bins times tasks
    a.close()


def test_balancing_an_empty_matrix_and_one_with_too_many_bins(spark, monkeypatch):
    none = spark.createDataFrame([], EDGES)
    assert balance.kr(none).count() == balance.ice(none).count() == 0
    monkeypatch.setattr(balance, "MOST_BINS", 2)
    with pytest.raises(ValueError, match="3 bins"):
        balance.kr(spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], EDGES))


def test_possible_and_expected_of_a_small_sample(spark):
    r = bins(spark, 5, 3, 4)
    rows = [(i, j, 1.0) for i in range(12) for j in range(i, 12)]
    e = spark.createDataFrame(rows, EDGES)
    got = {(x.chromosome, x.distance): x.possible for x in matrix.possible_contacts(r).collect()}
    assert sum(v for (c, _), v in got.items()) == 15 + 6 + 10 and got["chr1", 0] == 5
    assert matrix.expected_inter(e, r).first().possible == 47
    assert {x.expected for x in matrix.expected(e, r).collect()} == {1.0}


def test_neighbourhood_sums_of_a_window():
    m = np.tile(np.arange(7.0), (7, 1))
    s = loops._area(m)
    got = loops.neighbourhoods(s, 3, 3, 1, 3)
    own = {k: 0.0 for k in loops.KINDS}
    for i in range(7):
        for j in range(7):
            di, dj = i - 3, j - 3
            inner = abs(di) <= 1 and abs(dj) <= 1
            if not inner:
                own["ll"] += m[i, j] * (1 <= di <= 3 and -3 <= dj <= -1)
                own["h"] += m[i, j] * (abs(di) <= 1)
                own["v"] += m[i, j] * (abs(dj) <= 1)
                own["d"] += m[i, j] * (di != 0 and dj != 0)
    assert got == own
    assert [loops.chunk(x) for x in (0.5, 1, 1.2, 1.3, 2, 32, 1024)] == [0, 1, 1, 2, 4, 16, 31]


def test_loop_call_equals_a_direct_evaluation(spark):
    rng = np.random.default_rng(2)
    n = 60
    i, j = np.indices((n, n))
    m = np.triu(rng.poisson(30 / (1 + np.abs(i - j)))).astype(float)
    m[20, 40] = 60
    m = m + np.triu(m, 1).T
    r = bins(spark, n).withColumn("bias", F.lit(1.0))
    e = sparse(spark, m)
    exp = matrix.expected(e, r)
    cis = e.withColumn("chromosome", F.lit("chr1"))
    a = loops.call(cis, exp, r, 1, 3, least_reads=2, tile=200).toPandas().sort_values(["source", "sink"], ignore_index=True)
    b = loops.call(cis, exp, r, 1, 3, least_reads=2, tile=16).toPandas().sort_values(["source", "sink"], ignore_index=True)
    assert len(a) > 100 and len(a) == len(b)  # tiles with a halo change nothing
    for c in ["source", "sink", "weight", "w", *[f"{x}_{k}" for k in loops.KINDS for x in ("e", "oe", "mappability")]]:
        assert np.allclose(a[c].to_numpy(dtype=float), b[c].to_numpy(dtype=float), equal_nan=True), c
    x = a[(a.source == 20) & (a.sink == 40)].iloc[0]
    vec = np.array([np.trace(m, k) / (n - k) for k in range(n)])
    w, ex = int(x.w), vec[np.abs(i - j)]
    donut = [(p, q) for p in range(20 - w, 21 + w) for q in range(40 - w, 41 + w) if (abs(p - 20) > 1 or abs(q - 40) > 1) and p != 20 and q != 40]
    want = sum(m[p] for p in donut) / sum(ex[p] for p in donut) * vec[20]
    assert math.isclose(x.e_d, want, rel_tol=1e-9) and x.oe_d == x.weight / x.e_d


def test_fdr_falls_with_the_count(spark):
    rng = np.random.default_rng(3)
    rows = [(float(k), *[4] * 4) for k in rng.poisson(2, 400)] + [(30.0, *[4] * 4)]
    p = spark.createDataFrame(rows, "weight double, chunk_ll long, chunk_h long, chunk_v long, chunk_d long")
    got = {x.observed: x.fdr for x in loops.fdr_table(p).where("kind = 'd'").collect()}
    tail = [1 - sum(math.exp(-(2 ** (4 / 3))) * (2 ** (4 / 3)) ** k / math.factorial(k) for k in range(o)) for o in range(31)]
    seen = [sum(r[0] >= o for r in rows) / len(rows) for o in range(31)]
    for o in range(31):
        assert math.isclose(got[o], min(1, max(0, tail[o]) / seen[o]), abs_tol=1e-9)
    assert loops.with_fdr(p, loops.fdr_table(p)).where("fdr_d < 0.1").count() >= 1


def test_boundaries_of_a_wave():
    x = np.cos(np.arange(60) / 60 * 6 * np.pi)
    low, high = [i for i, _ in tracks.call_boundaries(x, 3)], [i for i, _ in tracks.call_boundaries(x, 3, maxima=True)]
    assert all(min(abs(i - k) for k in (10, 30, 50)) <= 1 for i in low) and len(low) == 3
    assert all(min(abs(i - k) for k in (20, 40)) <= 1 for i in high) and len(high) == 2


@pytest.mark.parametrize("name", ["pairs_to_edges", "read_pairs", "edge_collection", "merge_matrices", "rebin_nested", "rebin_split", "zoom_levels", "edge_collection_filters", "background_ligation_filter"])
def test_tasks_grow_in_number_with_the_files_and_not_in_size(spark, monkeypatch, name):
    monkeypatch.setattr(view, "TASK_BYTES", 1 << 15)
    n = view.tasks(spark, SMALL)
    size = sum(os.path.getsize(f) for f in [f"{SMALL}/lineitem.parquet"])
    assert n == -(-size // (1 << 15)) > 30
    df = registry.QUERIES[name](spark, SMALL)
    assert df.rdd.getNumPartitions() >= n
    monkeypatch.undo()
    assert rows_of(df.columns, df.collect()) == rows_of(df.columns, registry.QUERIES[name](spark, SMALL).collect())


def test_enriched_peaks_make_their_candidates_once(spark, monkeypatch):
    runs = spark.sparkContext.accumulator(0)
    call = loops.call

    def counted(*args, **how):
        rows = call(*args, **how)

        def count(batches):
            for b in batches:
                runs.add(b.num_rows)
                yield b

        return rows.mapInArrow(count, rows.schema)

    monkeypatch.setattr(loops, "call", counted)
    n = registry.QUERIES["loop_candidates"](spark, SMALL).count()
    assert runs.value == n > 0
    df = registry.QUERIES["enriched_peaks"](spark, SMALL)
    df.collect()
    assert runs.value == 2 * n
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    del df
    assert spark.sparkContext._jsc.getPersistentRDDs().size() < cached


def test_edges_within_chromosomes_and_valid_bins_without_counts(spark):
    e = view.edges(spark, SMALL)
    assert rows_of(e.columns, view.edges(spark, SMALL, cis=True).collect()) == rows_of(e.columns, e.where("source div 50 = sink div 50").collect())
    v = view.valid(spark, SMALL)
    assert rows_of(v.columns, v.collect()) == rows_of(v.columns, matrix.valid_regions(e, view.regions(spark, SMALL)).select(v.columns).collect())


def test_pairs_are_sorted_once_by_their_order(spark):
    plan = view.pairs(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2


def test_rounding_keeps_the_sign_of_zero(spark):
    df = spark.createDataFrame([(-4e-6,), (4e-6,), (0.0,), (-0.000016,), (None,), (math.nan,)], "r double")
    got = [r.r for r in df.select(registry.rounded("r", 5).alias("r")).collect()]
    assert [str(x) for x in got] == ["-0.0", "0.0", "0.0", "-2e-05", "None", "nan"]


def test_correlation_of_chromosomes_with_gaps_single_bins_and_no_cells(spark):
    r = spark.createDataFrame([(0, "a"), (1, "a"), (4, "a"), (5, "b"), (6, "c"), (7, "c")], "ix long, chromosome string")
    oe = spark.createDataFrame([("a", 0, 0, 2.0), ("a", 0, 4, 3.0), ("a", 1, 4, 0.5), ("b", 5, 5, 1.5)], "chromosome string, source long, sink long, oe double")
    got = {(x.source, x.sink): (x.chromosome, x.r) for x in compartments.correlation(oe, r).collect()}
    want = np.corrcoef([[2.0, 1.0, 3.0], [1.0, 1.0, 0.5], [3.0, 0.5, 1.0]])
    for i, a in enumerate((0, 1, 4)):
        for j, b in enumerate((0, 1, 4)):
            assert b < a or math.isclose(got[a, b][1], want[i, j])
    assert {k: c for k, (c, v) in got.items() if math.isnan(v)} == {(5, 5): "b", (6, 6): "c", (6, 7): "c", (7, 7): "c"}
    assert len(got) == 10


def test_eigenvector_splits_two_blocks(spark):
    rows = [(i, j, 2.0 if (i < 5) == (j < 5) else 0.5) for i in range(10) for j in range(i, 10)]
    oe = spark.createDataFrame([("chr1", *r) for r in rows], "chromosome string, source long, sink long, oe double")
    r = bins(spark, 10).withColumn("gc", F.when(F.col("ix") < 5, 0.6).otherwise(0.3))
    got = {x.ix: x.compartment for x in compartments.compartments(compartments.eigenvector(oe, r, guide="gc")).collect()}
    assert got == {i: "A" if i < 5 else "B" for i in range(10)}
    s = spark.createDataFrame([(4, 4, 2.0), (0, 0, 2.0), (4, 0, 0.5)], "a int, b int, value double")
    assert math.isclose(compartments.strength(s, 5).first().strength, math.log(16))


def test_domains_of_other_sizes_are_brought_to_one(spark):
    e = spark.createDataFrame([(i, j, 3.0) for a, b in ((10, 13), (30, 37)) for i in range(a, b + 1) for j in range(i, b + 1)], "source long, sink long, oe double")
    d = spark.createDataFrame([(1, 10, 13), (2, 30, 37)], "id long, first long, last long")
    got = {(x.i, x.j): x.value for x in aggregate.pile_up_domains(d, e, bins(spark, 60), 12).collect()}
    assert got == {(i, j): 3.0 if 4 <= i < 8 and 4 <= j < 8 else 1.0 for i in range(12) for j in range(12)}


def test_duplicates_are_measured_from_their_anchor(spark):
    p = spark.createDataFrame([(k, 1, 1, x, y) for k, (x, y) in enumerate([(10, 50), (12, 51), (13, 50), (15, 50), (40, 50), (40, 60)])], "id long, left_chromosome int, right_chromosome int, left_position long, right_position long")
    got = {x.id: x.duplicate for x in pairs.pcr_duplicates(p, 2, "id").collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False, 5: False}


def test_three_alignments_become_a_pair(spark):
    reads = spark.createDataFrame([("a", "c1", 100, 1, "50M"), ("a", "c1", 300, 1, "70M30S"), ("a", "c2", 900, -1, "90M"), ("b", "c1", 1, 1, "9M"), ("c", "c1", 1, 1, "9M"), ("c", "c2", 5, 1, "9M")], "qname string, rname string, pos long, strand int, cigar string")
    got = {x.qname: {(y.chromosome, y.position) for y in x.pair} for x in pairs.resolve_chimeric(pairs.alignments_by_name(reads)).collect()}
    assert got == {"a": {("c1", 300), ("c2", 900)}, "c": {("c1", 1), ("c2", 5)}}


def test_threshold_is_the_first_even_ratio():
    assert pairs.auto_threshold([(100, 2.0, 500), (500, 0.9, 500), (900, 0.52, 500), (2000, 0.5, 500)]) == 900
    assert pairs.auto_threshold([(100, 0.99, 500)]) is None


def test_masks_admit_rows_by_their_bits(spark):
    t = spark.range(50).withColumnRenamed("id", "b")
    rows, bits = masks.apply_filters(t, {"big": F.col("b") >= 25, "even": F.col("b") % 2 == 0})
    assert masks.visible(rows).count() == 12 and masks.visible(rows, 1 << bits["even"]).count() == 25
    assert {x.name: x.n for x in masks.statistics(rows, bits).collect()} == {"big": 25, "even": 25, "valid": 12}
    assert masks.visible(masks.reset(rows)).count() == 50


def test_digest_and_regions(spark):
    s = spark.createDataFrame([("chr1", "ACGTAAGCTTACGTAAGCTTGG"), ("chr2", "ACGT")], "name string, sequence string")
    got = [(x.chromosome, x.start, x.end) for x in intervals.digest(s, "AAGCTT", 1).orderBy("chromosome", "start").collect()]
    assert got == [("chr1", 1, 5), ("chr1", 6, 15), ("chr1", 16, 22), ("chr2", 1, 4)]
    r = bins(spark, 3)
    assert matrix.regions_identical(r, r) and not matrix.regions_identical(r, r.where("ix > 0"))


def test_functions(spark):
    assert [sequences.bases(x) for x in ("1mb", "500kb", "1,000")] == [10**6, 500_000, 1000]
    assert sequences.parse_region("chr1:1kb-2,000:-") == ("chr1", 1000, 2000, -1) and sequences.parse_region("chrX") == ("chrX", None, None, None)
    row = spark.createDataFrame([("ACGTN", "10M2I5=3S", "@read/1 x")], "s string, c string, n string").select(sequences.reverse_complement(F.col("s")), sequences.cigar_matched(F.col("c")), sequences.read_name(F.col("n")), sequences.trimmed(F.col("s"), 2), sequences.trimmed(F.col("s"), 2, front=True)).first()
    assert tuple(row) == ("NACGT", 15, "read", "ACG", "GTN")
    names = spark.createDataFrame([("chr10",), ("chr2",), ("chr1",)], "n string").orderBy(sequences.natural_key(F.col("n"))).collect()
    assert [x.n for x in names] == ["chr1", "chr2", "chr10"]


def test_text_sources_and_sinks(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    fa = files.load(spark, file("a.fa", ">one x\nACGT\nAC\n>two\nGG\n")).collect()
    assert [(x.name, x.sequence) for x in fa] == [("one", "ACGTAC"), ("two", "GG")]
    fq = files.load(spark, file("a.fq", "@r1 x\nACGT\n+\nIIII\n@r2\nGG\n+\nII\n")).collect()
    assert {(x.name, x.sequence, x.quality.strip()) for x in fq} == {("r1", "ACGT", "IIII"), ("r2", "GG", "II")}
    sam = "@HD\tVN:1\nq1\t0\tc1\t5\t40\t4M\t*\t0\t0\tACGT\tIIII\tAS:i:4\tXS:i:3\nq2\t16\tc1\t9\t10\t4M\t*\t0\t0\tACGT\tIIII\tAS:i:4\nq3\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n"
    s = files.load(spark, file("a.sam", sam))
    assert [(x.qname, x.pos, x.strand) for x in s.collect()] == [("q1", 5, 1), ("q2", 9, -1)]
    keep = files.read_filters(mapq=30, unique=True, bwa_quality=0.9, bwa_unique=True)
    assert {k: s.where(v).count() for k, v in keep.items()} == {"quality": 1, "uniqueness": 1, "bwa_quality": 2, "bwa_uniqueness": 2}
    bed = files.load(spark, file("a.bed", "track x\nc1\t0\t10\tn\t5\t+\nc1\t20\t30\n"))
    assert [(x.start, x.end, x.score, x.strand) for x in bed.collect()] == [(1, 10, 5.0, 1), (21, 30, None, None)]
    files.write_bed(bed, str(tmp_path / "out.bed"), "score")
    assert files.read_bed(spark, str(tmp_path / "out.bed")).select("start", "end").collect() == bed.select("start", "end").collect()
    p = files.load(spark, file("a.pairs", "## pairs\n#columns: readID chr1 pos1 chr2 pos2 strand1 strand2\nr\tc1\t5\tc2\t9\t+\t-\n")).first()
    assert (p.left_chromosome, p.left_position, p.right_position, p.left_strand, p.right_strand) == ("c1", 5, 9, 1, -1)
    d = files.read_dense(spark, file("m.txt", "1\t2\n2\t0\n"))
    assert sorted(map(tuple, d.collect())) == [(0, 0, 1.0), (0, 1, 2.0)]
    files.write_contacts(d, str(tmp_path / "out.txt"))
    assert sorted(map(tuple, files.read_contacts(spark, str(tmp_path / "out.txt")).collect())) == [(0, 0, 1.0), (0, 1, 2.0)]
    e = spark.createDataFrame([(1, 2, 1.0), (5, 2500, 2.0), (1500, 2500, 3.0)], EDGES)
    files.write_matrix(e, bins(spark, 3), str(tmp_path / "m"))
    got, _ = files.read_matrix(spark, str(tmp_path / "m"), (0, 10), (2000, 3000))
    assert [tuple(x) for x in got.collect()] == [(5, 2500, 2.0)]


def test_stream_counts_what_a_batch_counts(spark, tmp_path):
    p = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (1, 2)], "source long, sink long")
    p.repartition(2).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    contacts.start(s, "stream_edges", str(tmp_path / "state")).awaitTermination()
    assert sorted(map(tuple, spark.table("stream_edges").collect())) == sorted(map(tuple, contacts.incremental_edges(p).collect())) == [(1, 2, 3), (3, 3, 1)]
