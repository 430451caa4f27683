"""Command line: python -m pairloom COMMAND .. ; matrices are the folders of sources.files.write_matrix."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.sequences import bases, parse_region
from .operators import balance, compare, compartments, intervals, loops, masks, matrix, pairs as pairs_, tracks
from .session import session
from .sources import files


def _matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Raw edges and regions with valid and bias (1 if they have none)."""
    edges, regions = files.load(spark, path)
    regions = matrix.valid_regions(edges, regions)
    return edges, regions if "bias" in regions.columns else regions.withColumn("bias", F.lit(1.0))


def _normalised(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    edges, regions = _matrix(spark, path)
    return matrix.normalised(edges, regions), regions


def fragments(spark: SparkSession, a: argparse.Namespace) -> None:
    files.write_bed(files.genome_regions(spark, a.cut, files.read_genome(spark, *a.input, exclude=tuple(a.exclude))), a.output)


def pairs(spark: SparkSession, a: argparse.Namespace) -> None:
    """Valid pairs of two alignment files or a pairs file: located on regions, filtered, counted."""
    regions = files.read_regions(spark, a.regions)
    if len(a.input) == 2:
        left, right = (files.load(spark, p) for p in a.input)
        if a.mapq:
            left, right = (x.where(F.col("mapq") >= a.mapq) for x in (left, right))
        both = pairs_.pair_up(left, right).where("kind <> 'abnormal'")
        ends = {s: both.select("qname", *[F.col(f"{s}.{c}").alias(n) for c, n in (("rname", "chromosome"), ("pos", "position"), ("strand", "strand"))]) for s in ("left", "right")}
        rows = ends["left"].toDF("qname", "left_chromosome", "left_position", "left_strand").join(ends["right"].toDF("qname", "right_chromosome", "right_position", "right_strand"), "qname")
    else:
        rows = files.load(spark, a.input[0])
    for side, end in (("left", "source"), ("right", "sink")):
        r = regions.select(F.col("ix").alias(end), F.col("chromosome").alias(f"{side}_chromosome"), F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"))
        at = intervals.locate(rows.withColumn("chromosome", F.col(f"{side}_chromosome")), regions, f"{side}_position").withColumnRenamed("ix", end).drop("chromosome")
        rows = at.join(r.drop(f"{side}_chromosome"), end)
    rows, bits = masks.apply_filters(rows, pairs_.filters(a.inward, a.outward, a.re_distance, a.self_ligation))
    files.write_table(masks.statistics(rows, bits), f"{a.output}-statistics")
    files.write_matrix(matrix.edges_from_pairs(masks.visible(rows)), regions.drop("id"), a.output)


def balance_(spark: SparkSession, a: argparse.Namespace) -> None:
    edges, regions = _matrix(spark, a.input)
    if a.low_coverage:
        edges = matrix.low_coverage(edges, relative=a.low_coverage)
    if a.diagonal is not None:
        edges = edges.where(matrix.near_diagonal(a.diagonal))
    how = {"regions": regions} if a.per_chromosome and a.method in ("kr", "ice") else {}
    bias = balance.normalise(edges, a.method, **how)
    files.write_matrix(edges, regions.drop("bias").join(bias, "ix", "left").fillna(0.0, ["bias"]), a.output)


def dump(spark: SparkSession, a: argparse.Namespace) -> None:
    edges, regions = (_matrix if a.raw else _normalised)(spark, a.input)
    if a.region:
        name, start, end, _ = parse_region(a.region)
        inside = regions.where(F.col("chromosome") == name).where((F.col("end") >= (start or 1)) & (F.col("start") <= (end or 1 << 60)))
        for c in ("source", "sink"):
            edges = edges.join(inside.select(F.col("ix").alias(c)), c, "left_semi")
    if a.oe:
        edges = matrix.observed_expected(edges, regions).select("source", "sink", F.col("oe").alias("weight"))
    files.dump(edges, regions, a.output, a.log2, a.only_intra)


def expected(spark: SparkSession, a: argparse.Namespace) -> None:
    files.write_table(matrix.expected(*_normalised(spark, a.input)).orderBy("chromosome", "distance"), a.output)


def cis_trans(spark: SparkSession, a: argparse.Namespace) -> None:
    files.write_table(matrix.cis_trans(*_matrix(spark, a.input), normalise=a.normalise), a.output)


def insulation(spark: SparkSession, a: argparse.Namespace) -> None:
    edges, regions = _normalised(spark, a.input)
    fill = matrix.expected(edges, regions) if a.impute else None
    size = regions.agg(F.max(F.col("end") - F.col("start") + 1)).first()[0]
    scores = tracks.insulation_windows(edges, regions, [max(1, tracks.half_window(bases(w), size)) for w in a.windows], impute=fill)
    files.write_table(scores.join(regions.select("ix", "chromosome", "start", "end"), "ix").orderBy("w", "ix"), a.output)


def boundaries(spark: SparkSession, a: argparse.Namespace) -> None:
    scores = spark.read.csv(a.input, sep="\t", header=True, inferSchema=True)
    files.write_table(tracks.boundaries(scores, a.window, a.maxima, "w", "chromosome", least=a.least), a.output)


def directionality(spark: SparkSession, a: argparse.Namespace) -> None:
    edges, regions = _normalised(spark, a.input)
    files.write_table(tracks.directionality(edges, regions, a.window).join(regions.select("ix", "chromosome", "start", "end"), "ix").orderBy("ix"), a.output)


def compartments_(spark: SparkSession, a: argparse.Namespace) -> None:
    edges, regions = _normalised(spark, a.input)
    track = compartments.compartments(compartments.eigenvector(matrix.observed_expected(edges, regions), regions))
    files.write_table(track.join(regions.select("ix", "start", "end"), "ix").orderBy("ix"), a.output)


def loops_(spark: SparkSession, a: argparse.Namespace) -> None:
    edges, regions = _matrix(spark, a.input)
    cis = matrix.with_ends(edges, regions, "chromosome").where("source_chromosome = sink_chromosome").select(F.col("source_chromosome").alias("chromosome"), "source", "sink", "weight")
    size = regions.agg(F.max(F.col("end") - F.col("start") + 1)).first()[0]
    found = loops.call(cis, matrix.expected(matrix.normalised(edges, regions), regions), regions, *loops.sizes(int(size)), least_reads=a.least_reads)
    found = loops.with_fdr(found, loops.fdr_table(found))
    kept = masks.visible(masks.apply_filters(found, loops.peak_filters(observed=a.observed, fdr=a.fdr, mappability=a.mappability, enrichment=a.enrichment, rao=a.rao))[0])
    files.write_table(kept.drop("mask"), a.output)


def compare_(spark: SparkSession, a: argparse.Namespace) -> None:
    (one, regions), (other, _) = _normalised(spark, a.input[0]), _normalised(spark, a.input[1])
    how = {"fold-change": compare.fold_change, "difference": compare.difference}[a.comparison]
    files.write_matrix(compare.compare_matrices(one, other, how, log=a.log2), regions, a.output)


def downsample(spark: SparkSession, a: argparse.Namespace) -> None:
    edges, regions = _matrix(spark, a.input)
    n = files.load(spark, a.n)[0] if os.path.exists(a.n) else float(a.n)
    files.write_matrix(matrix.downsample(edges, n), regions, a.output)


def stats(spark: SparkSession, a: argparse.Namespace) -> None:
    """How many reads, pairs or contacts each file holds."""
    rows = []
    for p in a.input:
        got = files.load(spark, p)
        rows.append((p, float(got[0].agg(F.sum("weight")).first()[0] or 0) if isinstance(got, tuple) else float(got.count())))
    files.write_table(spark.createDataFrame(rows, "file string, n double"), a.output)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("pairloom")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, inputs: str | None = None, **options: dict) -> None:  # noqa: ANN001
        c = sub.add_parser(name, help=run.__doc__)
        c.add_argument("input", nargs=inputs)
        c.add_argument("output")
        for flag, how in options.items():
            c.add_argument("--" + flag.replace("_", "-"), **how)
        c.set_defaults(run=run)

    yes, number, real = {"action": "store_true"}, {"type": int}, {"type": float}
    command("fragments", fragments, "+", cut={"default": "GATC"}, exclude={"nargs": "*", "default": []})
    command("pairs", pairs, "+", regions={"required": True}, inward=number, outward=number, re_distance=number, self_ligation=yes, mapq=number)
    command("balance", balance_, method={"default": "kr"}, low_coverage=real, diagonal=number, per_chromosome=yes)
    command("dump", dump, raw=yes, oe=yes, log2=yes, only_intra=yes, region={})
    command("expected", expected)
    command("cis-trans", cis_trans, normalise=yes)
    command("insulation", insulation, windows={"nargs": "+", "default": ["5kb"]}, impute=yes)
    command("boundaries", boundaries, window={"type": int, "default": 3}, maxima=yes, least=real)
    command("directionality", directionality, window={"type": int, "default": 5})
    command("compartments", compartments_)
    command("loops", loops_, least_reads={"type": int, "default": 16}, observed=real, fdr=real, mappability=real, enrichment=real, rao=yes)
    command("compare", compare_, "+", comparison={"default": "fold-change", "choices": ["fold-change", "difference"]}, log2=yes)
    command("downsample", downsample, n={"required": True})
    command("stats", stats, "+")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(spark or session(os.environ.get("PAIRLOOM_MASTER", "local[*]")), a)


if __name__ == "__main__":
    main()
