"""Readers and writers of genomic text formats. Coordinates become 1-based and closed."""

from __future__ import annotations

import functools
import os
import re
import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.sequences import bases, natural_key
from ..operators import intervals
from ..operators.matrix import with_ends
from ..operators.ordering import numbered
from . import binary

SAM = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
VALID_PAIRS = {"chromosome": (1, 4), "position": (2, 5), "strand": (3, 6)}


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence) of each record; gzip is read as it is. A file is one row while it is parsed."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.slice(F.split("value", "(?m)^>"), 2, 1 << 30)).alias("r"))
    return rows.select(F.regexp_extract("r", r"^(\S+)", 1).alias("name"), F.regexp_replace(F.regexp_replace("r", r"^[^\n]*\n?", ""), r"\s", "").alias("sequence"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence, quality) of four-line records, split at record ends."""
    rows = spark.read.option("lineSep", "\n@").text(path)
    f = F.split("value", "\r?\n")
    return rows.where(F.size(f) >= 4).select(F.regexp_extract(F.regexp_replace(F.get(f, 0), "^@", ""), r"^(\S+)", 1).alias("name"), F.get(f, 1).alias("sequence"), F.get(f, 3).alias("quality"))


def read_sam(spark: SparkSession, path: str, unmapped: bool = False) -> DataFrame:
    """Alignments with a map of their tags; header lines and (unless asked for) unmapped reads are left out."""
    c = F.split("value", "\t")
    kinds = {"flag": "int", "pos": "long", "mapq": "int", "pnext": "long", "tlen": "long"}
    cols = [F.get(c, i).cast(kinds.get(n, "string")).alias(n) for i, n in enumerate(SAM)]
    tags = F.transform(F.slice(c, 12, 1 << 20), lambda t: F.struct(F.substr(t, F.lit(1), F.lit(2)), F.substr(t, F.lit(6))))
    rows = spark.read.text(path).where("not value like '@%' and value <> ''").select(*cols, F.map_from_entries(F.filter(tags, lambda t: t["col1"] != "")).alias("tags"))
    rows = rows.withColumn("strand", F.when(F.col("flag").bitwiseAND(F.lit(16)) != 0, -1).otherwise(1).cast("byte"))
    return rows if unmapped else rows.where(F.col("flag").bitwiseAND(F.lit(4)) == 0)


def read_filters(mapq: int | None = None, unique: bool = False, strict: bool = True, bwa_quality: float | None = None, bwa_unique: bool = False) -> dict[str, F.Column]:
    """Conditions that keep an alignment read by read_sam, by name."""
    tag = lambda t: F.col("tags")[t]
    out = {}
    if mapq is not None:
        out["quality"] = F.col("mapq") >= mapq
    if unique:
        out["uniqueness"] = tag("XS").isNull() if strict else tag("XS").isNull() | (tag("AS").cast("int") > tag("XS").cast("int"))
    if bwa_quality is not None:
        n = F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MI=X]"), F.lit(1)), F.lit(0), lambda s, x: s + x.cast("int"))
        out["bwa_quality"] = F.coalesce((n > 0) & (tag("AS").cast("int") / F.nullif(n, F.lit(0)) >= bwa_quality), F.lit(False))
    if bwa_unique:
        alt = F.filter(F.split(tag("XA"), ";"), lambda x: x != "")
        better = F.exists(alt, lambda x: F.coalesce(F.try_element_at(F.split(x, ","), F.lit(4)).cast("int") <= tag("NM").cast("int"), F.lit(True)))
        out["bwa_uniqueness"] = tag("XA").isNull() if strict else ~F.coalesce(better, F.lit(False))
    return out


def read_pairs(spark: SparkSession, path: str, sep: str = "\t", fields: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Valid-pairs text: columns are given by ordinals (left, right); comment lines start with #."""
    fields = fields or VALID_PAIRS
    c = F.split("value", sep)
    kinds = {"position": "long", "strand": "string"}
    cols = [F.get(c, i).cast(kinds.get(n, "string")).alias(f"{side}_{n}") for n, both in fields.items() for side, i in zip(("left", "right"), both, strict=True)]
    rows = spark.read.text(path).where("not value like '#%' and value <> ''").select(*cols)
    for side in ("left", "right"):
        if f"{side}_strand" in rows.columns:
            rows = rows.withColumn(f"{side}_strand", F.when(F.col(f"{side}_strand").isin("+", "1"), 1).otherwise(-1).cast("byte"))
    return rows


def read_4dn_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs whose columns a ``#columns:`` header line names."""
    head = spark.read.text(path).where("value like '#columns:%'").first()
    names = head.value.split(":", 1)[1].split() if head else ["readID", "chr1", "pos1", "chr2", "pos2", "strand1", "strand2"]
    at = {n: i for i, n in enumerate(names)}
    fields = {"chromosome": (at["chr1"], at["chr2"]), "position": (at["pos1"], at["pos2"])}
    if "strand1" in at:
        fields["strand"] = (at["strand1"], at["strand2"])
    return read_pairs(spark, path, "\t", fields)


def read_bed(spark: SparkSession, path: str, zero_based: bool = True) -> DataFrame:
    """(chromosome, start, end, name, score, strand); absent fields and dots are null."""
    c = F.split("value", "\t")
    at = lambda i: F.nullif(F.try_element_at(c, F.lit(i + 1)), F.lit("."))
    rows = spark.read.text(path).where("value <> '' and not value rlike '^(#|track|browser)'")
    strand = F.when(at(5) == "+", 1).when(at(5) == "-", -1).cast("byte")
    return rows.select(at(0).alias("chromosome"), (at(1).cast("long") + int(zero_based)).alias("start"), at(2).cast("long").alias("end"), at(3).alias("name"), F.expr("try_cast(nullif(try_element_at(split(value, '\t'), 5), '.') as double)").alias("score"), strand.alias("strand"))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    c = F.split("value", "\t")
    rows = spark.read.text(path).where("value <> '' and not value like '#%'")
    return rows.select(F.get(c, 0).alias("chromosome"), F.get(c, 3).cast("long").alias("start"), F.get(c, 4).cast("long").alias("end"), F.get(c, 2).alias("feature"), F.expr("try_cast(nullif(get(split(value, '\t'), 5), '.') as double)").alias("score"), F.when(F.get(c, 6) == "-", -1).when(F.get(c, 6) == "+", 1).cast("byte").alias("strand"), F.get(c, 8).alias("attributes"))


def read_bedpe(spark: SparkSession, path: str) -> DataFrame:
    c = F.split("value", "\t")
    rows = spark.read.text(path).where("value <> '' and not value like '#%'")
    cols = [F.get(c, i).cast("string" if i in (0, 3) else "long").alias(n) for i, n in enumerate(("chromosome1", "start1", "end1", "chromosome2", "start2", "end2"))]
    return rows.select(*cols, F.try_element_at(c, F.lit(7)).alias("name"), F.expr("try_cast(try_element_at(split(value, '\t'), 8) as double)").alias("score"))


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chromosome string, length long")


def read_contacts(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Sparse triplets (source, sink, weight); canonical order, zeros left out, comments skipped."""
    rows = spark.read.csv(path, sep=sep, comment="#", schema="a long, b long, weight double").where("weight <> 0")
    return rows.select(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("sink"), "weight")


def read_dense(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Upper triangle of a square text matrix, one line per row, in line order."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\r?\n"), lambda x: (x != "") & ~x.startswith("#"))).alias("source", "line"))
    rows = rows.select("source", F.posexplode(F.split("line", sep)).alias("sink", "w"))
    return rows.select(F.col("source").cast("long"), F.col("sink").cast("long"), F.col("w").cast("double").alias("weight")).where("sink >= source and weight <> 0")


def _text(df: DataFrame, path: str, *cols: F.Column) -> None:
    df.select(F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit(".")) for c in cols]).alias("value")).write.mode("overwrite").text(path)


def write_bed(regions: DataFrame, path: str, score: str | None = None) -> None:
    s = F.col(score) if score else F.lit(".")
    _text(regions.orderBy("chromosome", "start", "end"), path, F.col("chromosome"), F.col("start") - 1, F.col("end"), F.lit("."), s)


def write_bedgraph(scores: DataFrame, path: str) -> None:
    _text(scores.where("score is not null").orderBy("chromosome", "start"), path, F.col("chromosome"), F.col("start") - 1, F.col("end"), F.col("score"))


def write_gff(regions: DataFrame, path: str, feature: str = "region") -> None:
    _text(regions.orderBy("chromosome", "start"), path, F.col("chromosome"), F.lit("pairloom"), F.lit(feature), F.col("start"), F.col("end"), F.lit("."), F.lit("."), F.lit("."), F.lit("."))


def write_bedpe(peaks: DataFrame, path: str) -> None:
    """peaks: chromosome1, start1, end1, chromosome2, start2, end2, name, score (closed, 1-based)."""
    _text(peaks, path, F.col("chromosome1"), F.col("start1") - 1, F.col("end1"), F.col("chromosome2"), F.col("start2") - 1, F.col("end2"), F.col("name"), F.col("score"))


def write_contacts(edges: DataFrame, path: str) -> None:
    _text(edges.orderBy("source", "sink"), path, F.col("source"), F.col("sink"), F.col("weight"))


def write_pre(pairs: DataFrame, path: str) -> None:
    """The eight-column text of contact files: strand, chromosome, position and fragment of both ends."""
    side = lambda s, k: (F.when(F.col(f"{s}_strand") > 0, 0).otherwise(16), F.col(f"{s}_chromosome"), F.col(f"{s}_position"), F.lit(k))
    _text(pairs, path, *side("left", 0), *side("right", 1))


def write_matrix(edges: DataFrame, regions: DataFrame, path: str, size: int = 1000) -> None:
    """Canonical storage: regions, and edges in a grid of (source_part, sink_part) folders for partition pruning."""
    parts = [F.floor(F.col(c) / size).alias(f"{c}_part") for c in ("source", "sink")]
    edges.select("*", *parts).repartition("source_part", "sink_part").sortWithinPartitions("source", "sink").write.mode("overwrite").partitionBy("source_part", "sink_part").parquet(f"{path}/edges")
    regions.write.mode("overwrite").parquet(f"{path}/regions")


def read_matrix(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None, size: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(edges, regions); with ranges of bins only the folders that can hold their edges are read."""
    e = spark.read.parquet(f"{path}/edges")
    if rows and columns:
        part = lambda c, r: (F.col(f"{c}_part") >= r[0] // size) & (F.col(f"{c}_part") <= (r[1] - 1) // size)
        own = lambda c, r: (F.col(c) >= r[0]) & (F.col(c) < r[1])
        e = e.where((part("source", rows) & part("sink", columns)) | (part("source", columns) & part("sink", rows)))
        e = e.where((own("source", rows) & own("sink", columns)) | (own("source", columns) & own("sink", rows)))
    return e.drop("source_part", "sink_part"), spark.read.parquet(f"{path}/regions")


#: Fields of HiC-Pro valid pairs: name, then chromosome, position and strand of both ends.
HIC_PRO = {"chromosome": (1, 4), "position": (2, 5), "strand": (3, 6)}


def read_hicpro_pairs(spark: SparkSession, path: str) -> DataFrame:
    return read_pairs(spark, path, "\t", HIC_PRO)


def read_genome(spark: SparkSession, *paths: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(name, sequence) of FASTA files or folders of them, without the excluded names."""
    rows = functools.reduce(DataFrame.unionByName, [read_fasta(spark, p) for p in paths])
    return rows.where(~F.col("name").isin(*exclude)) if exclude else rows


def genome_regions(spark: SparkSession, source: str, genome: DataFrame | None = None) -> DataFrame:
    """Regions from a file, or of a genome: bins of a size such as ``10kb``, or fragments of a cut site such as ``GATC`` or ``A^AGCTT,GATC``."""
    if genome is None:
        return load(spark, source)
    if re.fullmatch(r"[ACGTNRYWSKMBDHV^,]+", source.upper()):
        sites = [(x.replace("^", ""), max(0, x.find("^"))) for x in source.upper().split(",")]
        return numbered(intervals.digest(genome, sites), "chromosome", "start", name="ix")
    return intervals.fixed_bins(genome.select(F.col("name").alias("chromosome"), F.length("sequence").alias("length")), bases(source))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Regions of a BED file with ix by chromosome and start; a unique fourth column is kept as id."""
    rows = numbered(read_bed(spark, path), "chromosome", "start", "end", name="ix")
    return rows.select("ix", "chromosome", "start", "end", F.col("name").alias("id"))


def read_contacts_by_id(spark: SparkSession, path: str, regions: DataFrame, sep: str = "\t") -> DataFrame:
    """Sparse triplets whose bins are named by the regions' id."""
    rows = spark.read.csv(path, sep=sep, comment="#", schema="a string, b string, weight double").where("weight <> 0")
    for c in ("a", "b"):
        rows = rows.join(regions.select(F.col("id").alias(c), F.col("ix").alias(f"{c}_ix")), c)
    return rows.select(F.least("a_ix", "b_ix").alias("source"), F.greatest("a_ix", "b_ix").alias("sink"), "weight")


def write_fastq_chunks(reads: DataFrame, path: str, size: int) -> None:
    """FASTQ files of at most ``size`` reads (name, sequence, quality), gzipped."""
    rows = reads.select(F.concat_ws("\n", F.concat(F.lit("@"), "name"), "sequence", F.lit("+"), "quality").alias("value"))
    rows.write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", size).text(path)


def _sam_line() -> F.Column:
    tags = F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.when(e["value"].rlike("^-?[0-9]+$"), ":i:").otherwise(":Z:"), e["value"]))
    return F.concat_ws("\t", *[F.col(c).cast("string") for c in SAM], F.when(F.size("tags") > 0, F.array_join(tags, "\t")))


def write_sam(reads: DataFrame, path: str, by_name: bool = False, size: int | None = None) -> None:
    """Alignments of read_sam as headerless SAM text; sorted by name (natural order) and cut into files of ``size`` lines if asked for.

    Several inputs are merged by uniting them first.
    """
    rows = reads.orderBy(natural_key(F.col("qname")), "flag") if by_name else reads
    rows.select(F.rtrim(_sam_line()).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", size or 0).text(path)


def dump(edges: DataFrame, regions: DataFrame, path: str, log2: bool = False, only_intra: bool = False, by_region: bool = True) -> None:
    """Sparse text of a matrix (weights as they are, or log2), by regions or by bin numbers, of all or of cis edges."""
    rows = with_ends(edges, regions, "chromosome", "start", "end")
    if only_intra:
        rows = rows.where("source_chromosome = sink_chromosome")
    value = F.when(F.col("weight") > 0, F.log2("weight")) if log2 else F.col("weight")
    ends = [F.col(f"{e}_{c}") for e in ("source", "sink") for c in ("chromosome", "start", "end")] if by_region else [F.col("source"), F.col("sink")]
    _text(rows.orderBy("source", "sink"), path, *ends, value)


def write_table(table: DataFrame, path: str) -> None:
    """A small result (statistics, expected values, cis/trans ratios, components) as one tab-separated file with a header."""
    table.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def dummy_matrix(spark: SparkSession, sizes: tuple[int, ...] = (5, 3, 4), bin_size: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(edges, regions) of a small full matrix: the weight of an edge is 1 + source + sink."""
    rows, ix = [], 0
    for c, n in enumerate(sizes):
        for k in range(n):
            rows.append((ix, f"chr{c + 1}", k * bin_size + 1, (k + 1) * bin_size, True))
            ix += 1
    edges = spark.range(ix).select(F.col("id").alias("source"), F.explode(F.sequence("id", F.lit(ix - 1))).alias("sink"))
    return edges.withColumn("weight", (1 + F.col("source") + F.col("sink")).cast("double")), spark.createDataFrame(rows, "ix long, chromosome string, start long, end long, valid boolean")


def sniff(spark: SparkSession, path: str) -> str:
    """What a file is by its first bytes: hic, npy, bam, gzip, hdf5, fasta, fastq, sam, pairs, text or parquet."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 4096).alias("h")).first()
    b = bytes(head.h) if head else b""
    if b[:2] == b"\x1f\x8b":
        try:
            b = zlib.decompressobj(31).decompress(b, 4096)
        except zlib.error:
            return "gzip"
    for start, kind in ((b"HIC\0", "hic"), (b"\x93NUMPY", "npy"), (b"BAM\1", "bam"), (b"\x89HDF", "hdf5"), (b"PAR1", "parquet"), (b"@HD\t", "sam"), (b"@SQ\t", "sam"), (b"@PG\t", "sam"), (b"## pairs", "pairs"), (b">", "fasta"), (b"@", "fastq")):
        if b.startswith(start):
            return kind
    return "text"


def load(spark: SparkSession, path: str) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Reads a file by what its name ends with, or else by what it holds; .hic files (``file@resolution@norm``) and matrix folders give (edges, regions)."""
    name = path.lower().removesuffix(".gz")
    if ".hic" in name and name.split("@")[0].endswith(".hic"):
        return binary.read_hic(spark, path)
    kinds = {(".fa", ".fasta"): read_fasta, (".fq", ".fastq"): read_fastq, (".sam",): read_sam, (".bam",): binary.read_bam, (".npy",): binary.read_npy, (".bed", ".narrowpeak"): read_bed, (".gff", ".gtf", ".gff3"): read_gff, (".bedpe",): read_bedpe, (".pairs",): read_4dn_pairs, (".validpairs", ".allvalidpairs"): read_hicpro_pairs, (".sizes",): read_sizes}
    for ends, reader in kinds.items():
        if name.endswith(ends):
            return reader(spark, path)
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    if os.path.isdir(path) and os.path.isdir(os.path.join(path, "regions")):
        return read_matrix(spark, path)
    found = {"hic": binary.read_hic, "npy": binary.read_npy, "bam": binary.read_bam, "fasta": read_fasta, "fastq": read_fastq, "sam": read_sam, "pairs": read_4dn_pairs}
    kind = sniff(spark, path) if "." in os.path.basename(name) else "parquet"
    if kind in ("hdf5", "gzip"):
        raise ValueError(f"{path}: no reader for {kind}")
    return found.get(kind, lambda s, p: s.read.text(p) if kind == "text" else s.read.parquet(p))(spark, path)
