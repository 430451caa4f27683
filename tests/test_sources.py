"""Binary files made by hand, further text sources, and the command line."""

from __future__ import annotations

import gzip
import io
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.__main__ import main
from pairloom.operators import intervals, matrix, pairs, tracks
from pairloom.sources import binary, files


def bam(names, reads):
    text = b"@HD\tVN:1.6\n"
    out = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(names))
    for n in names:
        out += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 1000)
    for name, flag, ref, pos, mapq, ops, seq, tags in reads:
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + bytes([30] * len(seq)) + tags
        out += struct.pack("<i", len(body)) + body
    return gzip.compress(out[:50]) + gzip.compress(out[50:])


def test_bam_reads_as_sam(spark, tmp_path):
    tags = b"ASC\x04" + b"XSi" + struct.pack("<i", -3) + b"XAZc1,+5,4M,0;\0" + b"ZBBs" + struct.pack("<ihh", 2, 1, -2)
    (tmp_path / "a.bam").write_bytes(bam(["c1", "c2"], [("q1", 0, 0, 4, 40, [(4, "M")], "ACGT", tags), ("q2", 16, 1, 8, 9, [(2, "S"), (3, "M")], "ACGTN", b""), ("q3", 4, -1, -1, 0, [], "AC", b"")]))
    got = files.load(spark, str(tmp_path / "a.bam"))
    assert [(x.qname, x.rname, x.pos, x.mapq, x.cigar, x.seq, x.qual, x.strand) for x in got.collect()] == [("q1", "c1", 5, 40, "4M", "ACGT", "????", 1), ("q2", "c2", 9, 9, "2S3M", "ACGTN", "?????", -1)]
    assert got.first().tags == {"AS": "4", "XS": "-3", "XA": "c1,+5,4M,0;", "ZB": "s,1,-2"} and binary.read_bam(spark, str(tmp_path / "a.bam"), unmapped=True).count() == 3
    files.write_sam(got, str(tmp_path / "out.sam"), by_name=True)
    assert files.read_sam(spark, str(tmp_path / "out.sam")).select("qname", "pos", "tags").collect() == got.select("qname", "pos", "tags").collect()


def hic(version, sizes, bins, counts):
    """A .hic file of two chromosomes; counts: (one, two) -> {(x, y): count}; blocks of both kinds."""
    new, s = version > 8, lambda t: t.encode() + b"\0"
    names = ["All", *sizes]
    head = s("HIC") + struct.pack("<i", version)
    rest = s("test") + (struct.pack("<qq", 0, 0) if new else b"") + struct.pack("<i", 1) + s("software") + s("none")
    rest += struct.pack("<i", len(names)) + b"".join(s(n) + struct.pack("<q" if new else "<i", sizes.get(n, 1)) for n in names) + struct.pack("<ii", 1, bins) + struct.pack("<i", 0)
    body, index = b"", {}
    start = len(head) + 8 + len(rest)
    for k, ((one, two), cells) in enumerate(counts.items()):
        if version == 6:
            raw = struct.pack("<i", len(cells)) + b"".join(struct.pack("<iif", x, y, v) for (x, y), v in cells.items())
        elif k % 2 == 0:
            raw = struct.pack("<iiib", len(cells), 0, 0, 1) + (b"\0\0" if new else b"") + b"\1"
            rows = sorted({y for _, y in cells})
            raw += struct.pack("<h", len(rows))
            for y in rows:
                own = [(x, v) for (x, b), v in cells.items() if b == y]
                raw += struct.pack("<hh", y, len(own)) + b"".join(struct.pack("<hf", x, v) for x, v in own)
        else:
            grid = [int(cells.get((x, y), -32768)) for y in range(3) for x in range(4)]
            raw = struct.pack("<iiib", len(cells), 0, 0, 0) + (b"\0\0" if new else b"") + b"\2" + struct.pack("<ih", 12, 4) + struct.pack("<12h", *grid)
        block = zlib.compress(raw)
        place = start + len(body)
        body += block
        index[f"{one}_{two}"] = start + len(body)
        body += struct.pack("<iii", one, two, 1) + s("BP") + struct.pack("<iffffiiii", 0, 1, 1, 1, 1, bins, 1, 1, 1) + struct.pack("<iqi", 0, place, len(block))
    vector = [2.0, 4.0, 0.0, 1.0]
    at = start + len(body)
    body += struct.pack("<q4f" if new else "<i4d", 4, *vector)
    master = start + len(body)
    foot = struct.pack("<i", len(index)) + b"".join(s(k) + struct.pack("<qi", v, 1) for k, v in index.items())
    expected = struct.pack("<q2f" if new else "<i2d", 2, 1.0, 0.5) + struct.pack("<iif" if new else "<iid", 1, 1, 1.0)
    foot += struct.pack("<i", 1) + s("BP") + struct.pack("<i", bins) + expected
    foot += struct.pack("<i", 1) + s("KR") + s("BP") + struct.pack("<i", bins) + expected
    foot += struct.pack("<i", 1) + s("KR") + struct.pack("<i", 1) + s("BP") + struct.pack("<i", bins) + struct.pack("<q", at) + struct.pack("<q" if new else "<i", 8)
    return head + struct.pack("<q", master) + rest + body + struct.pack("<q" if new else "<i", len(foot)) + foot


@pytest.mark.parametrize("version", [6, 7, 8, 9])
def test_hic_files_of_all_versions(spark, tmp_path, version):
    counts = {(1, 1): {(0, 0): 5.0, (0, 2): 1.5 if version == 6 else 2.0, (1, 3): 7.0}, (1, 2): {(3, 0): 4.0, (0, 2): 9.0}, (2, 2): {(1, 2): 3.0}}
    path = tmp_path / "a.hic"
    path.write_bytes(hic(version, {"c1": 3500, "c2": 3000}, 1000, counts))
    edges, regions = files.load(spark, f"{path}@1kb@KR")
    want = {(x + 4 * (a - 1), y + 4 * (b - 1)): v for (a, b), cells in counts.items() for (x, y), v in cells.items()}
    assert {(e.source, e.sink): e.weight for e in edges.collect()} == want
    rows = regions.orderBy("ix").collect()
    assert [(r.chromosome, r.start, r.end, r.bias) for r in rows[:4]] == [("c1", 1, 1000, 0.5), ("c1", 1001, 2000, 0.25), ("c1", 2001, 3000, 0.0), ("c1", 3001, 3500, 1.0)]
    assert len(rows) == 7 and all(r.bias == 1.0 for r in rows[4:])
    assert binary.hic_metadata(spark, str(path)) == {"version": version, "genome": "test", "attributes": {"software": "none"}, "chromosomes": {"All": 1, "c1": 3500, "c2": 3000}, "resolutions": [1000], "normalisations": ["KR"]}
    with pytest.raises(Exception, match="bins of"):
        binary.read_hic(spark, str(path), 500)[0].count()


def test_further_text_sources(spark, tmp_path):
    m = np.array([[1.0, 2.0], [2.0, 0.0]])
    buffer = io.BytesIO()
    np.save(buffer, m)
    (tmp_path / "m.npy").write_bytes(buffer.getvalue())
    assert sorted(map(tuple, files.load(spark, str(tmp_path / "m.npy")).collect())) == [(0, 0, 1.0), (0, 1, 2.0)]
    (tmp_path / "x.dat").write_bytes(buffer.getvalue())
    assert files.sniff(spark, str(tmp_path / "x.dat")) == "npy" and files.load(spark, str(tmp_path / "x.dat")).count() == 2
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "1.fa").write_text(">c1\nAAGCTTGATCAA\n")
    (tmp_path / "g" / "2.fa").write_text(">c2\nGATTC\n>c3\nA\n")
    g = files.read_genome(spark, str(tmp_path / "g"), exclude=("c3",))
    assert {x.name for x in g.collect()} == {"c1", "c2"}
    cut = lambda how: [(x.ix, x.chromosome, x.start, x.end) for x in files.genome_regions(spark, how, g).orderBy("ix").collect()]
    assert cut("A^AGCTT,GATC") == [(0, "c1", 1, 1), (1, "c1", 2, 6), (2, "c1", 7, 12), (3, "c2", 1, 5)]
    assert cut("GANTC") == [(0, "c1", 1, 12), (1, "c2", 1, 5)] and cut("10b")[:2] == [(0, "c1", 1, 10), (1, "c1", 11, 12)]
    s = spark.createDataFrame([("c", "TTGAACCTTCAA")], "name string, sequence string")
    assert sorted(x.position for x in intervals.cut_sites(s, "TTGAA", 1, both_strands=True).collect()) == [1, 11]
    (tmp_path / "r.bed").write_text("c1\t0\t10\tx\nc1\t10\t20\ty\n")
    (tmp_path / "c.txt").write_text("y\tx\t3\n")
    r = files.read_regions(spark, str(tmp_path / "r.bed"))
    assert [tuple(x) for x in files.read_contacts_by_id(spark, str(tmp_path / "c.txt"), r).collect()] == [(0, 1, 3.0)]
    assert files.count_lines(spark, str(tmp_path / "r.bed")) == 2
    fq = spark.createDataFrame([(f"r{k}", "AC", "II") for k in range(5)], "name string, sequence string, quality string").coalesce(1)
    files.write_fastq_chunks(fq, str(tmp_path / "fq"), 2)
    assert len(list((tmp_path / "fq").glob("*.gz"))) == 3
    assert [tuple(x) for x in intervals.share_of_new(r, spark.createDataFrame([(7, "c1", 6, 15)], "ix long, chromosome string, start long, end long")).orderBy("old_ix").collect()] == [(0, 7, 0.5), (1, 7, 0.5)]


def test_two_files_make_normal_and_chimeric_pairs(spark):
    shape = "qname string, rname string, pos long, strand int, cigar string"
    one = [("n", "c1", 10, 1, "50M"), ("a", "c1", 100, 1, "30M70S"), ("a", "c2", 500, 1, "30S70M"), ("b", "c1", 100, 1, "30M"), ("b", "c2", 9, 1, "30M"), ("c", "c1", 1, 1, "9M"), ("c", "c1", 5, 1, "9M"), ("d", "c1", 1, 1, "9M"), ("z", "c1", 1, 1, "9M")]
    two = [("n", "c2", 70, -1, "50M"), ("a", "c2", 560, -1, "100M"), ("b", "c3", 9, -1, "30M"), ("c", "c1", 8, -1, "9M"), ("d", "c1", 1, 1, "9M"), ("d", "c2", 1, 1, "9M"), ("d", "c3", 1, 1, "9M")]
    got = {x.qname: x for x in pairs.pair_up(spark.createDataFrame(one, shape), spark.createDataFrame(two, shape)).collect()}
    assert {k: x.kind for k, x in got.items()} == {"n": "normal", "a": "chimeric", "b": "abnormal", "c": "abnormal", "d": "abnormal"}
    assert (got["a"].left.rname, got["a"].left.pos, got["a"].right.pos) == ("c1", 100, 560) and got["b"].left is None
    row = spark.createDataFrame([(100, "5S10M2D20M3I20M")], "p long, c string").select(pairs.longest_match(F.col("p"), F.col("c")).alias("m")).first().m
    assert (row.start, row.end) == (112, 132)


def test_boundaries_have_limits_and_places_between_bins():
    x = np.cos(np.arange(60) / 60 * 6 * np.pi) * np.linspace(0.2, 1, 60)
    every = tracks.call_boundaries(x, 3)
    assert len(tracks.call_boundaries(x, 3, least=sorted(s for _, s in every)[-1])) == 1
    exact = tracks.call_boundaries(x, 3, sub_bin=True)
    assert [round(i) for i, _ in exact] == [i for i, _ in every] and any(i != round(i) for i, _ in exact)


def test_imputed_insulation_is_flat_on_a_flat_matrix(spark):
    e, r = files.dummy_matrix(spark, (20,))
    e = e.withColumn("weight", F.lit(2.0)).where("source <> 9 and sink <> 9")
    r = matrix.valid_regions(e, r)
    got = {x.ix: x.score for x in tracks.insulation(e, r, 3, normalise=False, log=False, impute=matrix.expected(e, r)).collect()}
    assert all(abs(v - 2.0) < 1e-9 for v in got.values() if v is not None) and got[9] is not None
    assert {x.w for x in tracks.insulation_windows(e, r, [2, 3]).collect()} == {2, 3}


def test_command_line(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    e, r = files.dummy_matrix(spark, (30, 20))
    files.write_matrix(e, r.drop("valid"), at("m"))
    run = lambda *a: main(list(a), spark)
    run("balance", at("m"), at("b"), "--per-chromosome")
    edges, regions = files.load(spark, at("b"))
    total = matrix.marginals(matrix.normalised(matrix.with_ends(edges, regions, "chromosome").where("source_chromosome = sink_chromosome").select("source", "sink", "weight"), regions))
    assert total.agg(F.max(F.abs(F.col("marginal") - 1))).first()[0] < 1e-5
    run("downsample", at("m"), at("d"), "--n", "0.5")
    assert files.load(spark, at("d"))[0].agg(F.sum("weight")).first()[0] == int(e.agg(F.sum("weight")).first()[0] * 0.5)
    run("dump", at("m"), at("dump"), "--raw", "--only-intra", "--region", "chr1:1-5kb")
    assert files.count_lines(spark, at("dump")) == 15
    for command in ("expected", "cis-trans", "directionality", "compartments"):
        run(command, at("b"), at(command))
        assert files.count_lines(spark, at(command)) > 1
    run("insulation", at("b"), at("insulation"), "--windows", "4kb", "6kb")
    run("boundaries", at("insulation"), at("boundaries"))
    run("stats", at("m"), at("stats"))
    run("compare", at("m"), at("d"), at("c"), "--comparison", "difference")
    assert files.load(spark, at("c"))[0].count() == e.count()
    run("loops", at("m"), at("loops"), "--rao")
    (tmp_path / "g.fa").write_text(">chr1\nAAGATCAA\n")
    run("fragments", at("g.fa"), at("f.bed"), "--cut", "GATC")
    (tmp_path / "x.pairs").write_text("#columns: readID chr1 pos1 chr2 pos2 strand1 strand2\nr\tchr1\t1\tchr1\t6\t+\t-\nq\tchr1\t1\tchr1\t2\t+\t-\n")
    run("pairs", at("x.pairs"), at("p"), "--regions", at("f.bed"), "--self-ligation")
    assert [tuple(x) for x in files.load(spark, at("p"))[0].collect()] == [(0, 1, 1)]
