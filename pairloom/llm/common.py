"""What the corpus operators share: tables, staging in the shared folder, components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one of the supplied Parquet tables."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Names for helper columns, made from these, that no column of docs has (in any case of letters)."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as SQL has it."""
    return "`" + name.replace("`", "``") + "`"


def columns(docs: DataFrame, skip: str = "") -> list[Column]:
    """All columns of docs by their names, without the one called skip."""
    return [F.col(quoted(c)) for c in docs.columns if c != skip]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the session names none and is a local one (a test) a temporary folder is made, and kept in
    the session so that later calls use the same one. On a cluster each machine would have its own: an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="pairloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df once into the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if f"{shared_dir(spark)}/".split(":")[-1].lstrip("/") in f:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Edges whose components one task finds at once, for components().
FEW_EDGES = 1 << 14
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15


class WordHashes:
    """64-bit hashes of the words of UTF-8 texts: differences of prefix sums of a polynomial, moved to the front and mixed.

    Words are runs of bytes without space and the five controls from tab on. Powers are kept for the longest text so far.
    """

    def __init__(self) -> None:
        self.power = self.inverse = np.zeros(0, dtype=np.uint64)

    def __call__(self, a: np.ndarray) -> np.ndarray:
        if len(self.power) <= len(a):
            n = len(a) + len(a) // 4 + 64
            self.power = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)], dtype=np.uint64)
            self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)], dtype=np.uint64)
        edge = np.flatnonzero(np.diff(np.r_[True, _SPACE[a], True]))
        start, end = edge[::2], edge[1::2]
        total = np.r_[np.uint64(0), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * self.power[: len(a)], dtype=np.uint64)]
        h = ((total[end] - total[start]) * self.inverse[start] ^ (end - start).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)


def released(spark: SparkSession) -> None:
    """Lets the driver collect what nothing refers to: shuffle files of finished plans go with their objects."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def parsed_apart(spark: SparkSession) -> Iterator[None]:
    """Within it SQL texts are parsed with caches of their own, which go after each.

    Else the parser keeps all its prediction states for the rest of the application: some 40 MB of the driver's heap for the
    nested expressions of pii.py.
    """
    own = {"spark.sql.parser.manageParserCaches": "true", "spark.sql.parser.parserDfaCacheFlushThreshold": "1"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For n nodes and links (i, j): the smallest node that each reaches."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, component) of all edges (u, v) at once."""
    edges = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*([c.to_numpy() for c in b.columns] for b in batches), strict=True)]
    if edges:
        nodes, at = np.unique(np.concatenate(edges), return_inverse=True)
        root = local_roots(len(nodes), *np.split(at, 2))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["u", "component"])


def components(edges: DataFrame, name: str = "cc", few: int = 0) -> DataFrame:
    """Connected components of edges (u long, v long) by alternating large-star and small-star.

    Returns (u, component): every node that has an edge, and the smallest node it reaches. Each half
    round keeps at most the edges it was given, min() is combined before the shuffle, and the joins
    are plain equi-joins, which adaptive execution can split at a hub. Rounds grow with the logarithm
    of the diameter; each is staged in the shared folder. At most ``few`` edges are worked on in one task instead of
    rounds, each of which makes several jobs.
    """

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return (r[0], r[1])

    e = staged(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name
    )
    at = mark(e)
    if at[0] <= few:
        return e.coalesce(1).mapInArrow(_whole, "u long, component long")
    while at[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = big.where("u <> v").distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        small = small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        last, e = e, staged(small, name)
        dropped(last)
        now = mark(e)
        if now == at:
            break
        at = now
    return e.groupBy("u").agg(F.min("v").alias("component")).unionByName(
        e.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct()
    )
