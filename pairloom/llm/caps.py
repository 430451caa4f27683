"""Near-duplicate vectors by spherical-cap filters.

Filter directions are a structured random product code: after a random rotation a vector is cut into
BLOCKS parts, each part has its own random unit codewords, and a filter is one codeword from each. Its
score is the sum of the parts' inner products. A vector lies in the caps of all filters that score within
SLACK of its best one: a cap's height follows the vector, so that every vector lies in some caps and near
vectors in the same ones. They are listed by descending through the blocks and leaving a prefix
as soon as the best codewords of the blocks still to come cannot lift it over the height: the list is
decoded, never all filters scored. Vectors are joined on (label, filter), and each pair that meets is
verified in double precision. More than one rotation (table) may be asked for.

With a cosine of 0.98 or more two vectors share some filter almost surely (the tests measure recall); a
pair below 0.98 is never linked. Equal vectors of a label are collapsed before, with their count.

Counting links exactly: a bucket is cut into blocks of at most BLOCK vectors by hash, and pairs of blocks
are compared by one matrix product each, wherever the bucket is large. A linked pair counts in the first
filter that its two vectors share. Only counts and local components (stars) leave a task, never the pairs.

Nulls: vectors that are null, empty, zero, or that hold a null or non-finite component link with nothing, as
do rows with a null label or vec_id; they come back with n_links 0 and component_id = vec_id. Vectors of several dimensions
are compared within each dimension. Repeated rows are equal vectors of one vec_id and count as separate vectors; of a
component the smallest vec_id is kept. Very long vectors are padded to BLOCKS parts like any other. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import components, staged
from .simhash import local_roots

COSINE = 0.98
TABLES, BLOCKS, WORDS = 1, 4, 32
SLACK = 0.06  # a vector lies in the caps of all filters whose score is this close to its best one
BLOCK = 1024
SMALL = 48  # groups up to this size are compared together, larger ones by a matrix product each


@dataclass
class Code:
    """The random product code of one table."""

    rotation: np.ndarray  # dim x padded dim
    words: np.ndarray  # BLOCKS x WORDS x part
    slack: float

    @classmethod
    def make(cls, dim: int, seed: int, blocks: int = BLOCKS, words: int = WORDS, slack: float = SLACK) -> Code:
        rng = np.random.default_rng(seed)
        part = -(-dim // blocks)
        q, _ = np.linalg.qr(rng.standard_normal((part * blocks, part * blocks)))
        w = rng.standard_normal((blocks, words, part))
        w /= np.linalg.norm(w, axis=2, keepdims=True)
        return cls(q[:dim], w, slack)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters whose score exceeds each unit vector's best score less the slack."""
        blocks, words, part = self.words.shape
        scores = np.einsum("nbp,bwp->bnw", (unit @ self.rotation).reshape(len(unit), blocks, part), self.words)
        best = scores.max(axis=2)
        rest = np.cumsum(best[::-1], axis=0)[::-1]  # the most that this block and those after it can add
        row, code, score = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        need = rest[0] - self.slack
        for b in range(blocks):
            more = rest[b + 1] if b + 1 < blocks else np.zeros(len(unit))
            new = score[:, None] + scores[b][row]
            keep = new + more[row][:, None] >= need[row][:, None]
            i, w = np.nonzero(keep)
            row, code, score = row[i], code[i] * words + w, new[i, w]
        return row, code


def _unit(cells: list, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which lists are usable vectors (of dimension dim), and their unit vectors in double precision."""
    ok, out = [], []
    for i, v in enumerate(cells):
        if v is None or not len(v) or (dim is not None and len(v) != dim):
            continue
        a = np.array([np.nan if x is None else x for x in v], dtype=np.float64) if isinstance(v, list) else np.asarray(v, dtype=np.float64)
        top = np.abs(a).max()
        if np.isfinite(top) and top > 0:
            a = a / top
            ok.append(i)
            out.append(a / np.sqrt(a @ a))
    return np.array(ok, dtype=np.int64), np.array(out).reshape(len(out), -1)


def usable(column: str) -> F.Column:
    """SQL condition: a vector that is not null, empty or zero and has only finite components."""
    return F.expr(f"{column} is not null and size({column}) > 0 and exists({column}, x -> x <> 0) and forall({column}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")


def links(vectors: DataFrame, dim: int, least: float = COSINE, tables: int = TABLES, words: int = WORDS, slack: float = SLACK, block: int = BLOCK) -> DataFrame:
    """(id, n, low): for each of vectors (id, label, v, weight) what one task found: linked weight, and a reachable id."""
    codes = [Code.make(dim, 101 + t, words=words, slack=slack) for t in range(tables)]

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, unit = _unit(b.column(2).to_pylist(), dim)
            if not len(ok):
                continue
            rows, filters = [], []
            for t, code in enumerate(codes):
                r, f = code.decode(unit)
                rows.append(r)
                filters.append(f * tables + t)
            row, filt = np.concatenate(rows), np.concatenate(filters)
            order = np.lexsort((filt, row))
            row, filt = row[order], filt[order]
            start = np.searchsorted(row, np.arange(len(ok) + 1))
            sets = pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(filt))
            take = pa.array(ok)
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(4)), sets], names=["id", "label", "v", "weight", "filters"])

    filed = vectors.select("id", "label", "v", "weight").mapInArrow(file, vectors.select("id", "label", "v", "weight").schema.add("filters", ArrayType(LongType())))
    filed = staged(filed, "caps")
    rows = filed.select("id", "label", F.explode("filters").alias("f"))
    size = rows.groupBy("label", "f").count().where("count > 1")
    rows = rows.join(size, ["label", "f"])  # few vectors share a filter with any other
    parts = F.ceil(F.col("count") / block).cast("int")
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    # Block pair (p, q), p <= q: a vector of block o goes to (o, o..n-1) and (0..o-1, o).
    pair = F.transform(F.sequence(F.lit(0), parts - 1), lambda x: F.struct(F.least(own, x).alias("p"), F.greatest(own, x).alias("q")))
    rows = rows.withColumn("o", own).withColumn("x", F.explode(pair)).select("id", "label", "f", "o", "x.p", "x.q")
    rows = rows.join(filed.select("id", "v", "weight", "filters"), "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: pa.Table) -> pa.RecordBatch:
            g, f, p, q, ids, o, weight = (rows.column(k).to_numpy() for k in range(7))
            unit = rows.column(7).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), dim)
            unit /= np.abs(unit).max(axis=1, keepdims=True, initial=0)
            unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
            sets = rows.column(8).combine_chunks()
            at, filters = sets.offsets.to_numpy(), sets.values.to_numpy()
            start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
            size = np.diff(np.r_[start, len(g)])
            left, right, first = [], [], []
            small = np.repeat(size <= SMALL, size)
            end = np.repeat(start + size, size)
            seen: dict[int, frozenset] = {}

            def filters_of(k: int) -> frozenset:
                if k not in seen:
                    seen[k] = frozenset(filters[at[k] : at[k + 1]].tolist())
                return seen[k]

            for d in range(1, min(SMALL, int(size.max(initial=0)))):
                i = np.arange(len(g) - d)
                i = i[small[i] & (i + d < end[i])]
                i = i[(p[i] == q[i]) | (o[i] != o[i + d])]  # pairs within a block are counted in its own task
                i = i[np.einsum("ij,ij->i", unit[i], unit[i + d]) >= least]
                left.append(i)
                right.append(i + d)
                first.append(np.array([min(filters_of(k) & filters_of(k + d)) == f[k] for k in i.tolist()], dtype=bool))
            for k in np.flatnonzero(size > SMALL):
                at_k = np.arange(start[k], start[k] + size[k])
                i, j = np.nonzero(np.triu(unit[at_k] @ unit[at_k].T >= least - 1e-9, 1))
                i, j = at_k[i], at_k[j]
                ok = (np.einsum("ij,ij->i", unit[i], unit[j]) >= least) & ((p[i] == q[i]) | (o[i] != o[j]))
                i, j = i[ok], j[ok]
                lists = [(x := filters[at[r] : at[r + 1]])[: np.searchsorted(x, f[r])] for r in at_k]
                every, col = np.unique(np.concatenate(lists), return_inverse=True)
                has = np.zeros((len(at_k), len(every)), dtype=np.float32)
                has[np.repeat(np.arange(len(at_k)), [len(x) for x in lists]), col] = 1
                left.append(i)
                right.append(j)
                first.append((has @ has.T)[i - start[k], j - start[k]] == 0)
            i, j, counts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right, first))
            counts = counts.astype(bool)
            root = local_roots(len(ids), i, j)
            i, j = i[counts], j[counts]  # a pair counts where its vectors share no smaller filter
            n = np.bincount(i, weights=weight[j], minlength=len(ids)) + np.bincount(j, weights=weight[i], minlength=len(ids))
            use = np.flatnonzero((n > 0) | (root != np.arange(len(ids))))
            cols = [pa.array(ids[use]), pa.array(n[use].astype(np.int64)), pa.array(ids[root[use]])]
            return pa.RecordBatch.from_arrays(cols, names=["id", "n", "low"])

        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            g = rows.column(0).to_numpy()
            cut = int(np.flatnonzero(g == g[-1])[0])  # the last group may go on in the next batch
            rest = rows.slice(cut).combine_chunks()
            if cut:
                yield found(rows.slice(0, cut).combine_chunks())
        if rest is not None:
            yield found(rest)

    group = F.xxhash64("label", "f", "p", "q")
    rows = rows.select(group.alias("g"), "f", "p", "q", "id", "o", "weight", "v", "filters")
    return rows.repartition("g").sortWithinPartitions("g", "f", "p", "q").mapInArrow(compare, "id long, n long, low long")


def near_duplicates(table: DataFrame, least: float = COSINE, **how: float) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of table (vec_id, embedding, label)."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), "label")
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("v"))
    # Two hashes stand for a vector, so that the vectors themselves travel once.
    same = good.withColumn("h1", F.xxhash64("v", "label")).withColumn("h2", F.xxhash64("label", "v", F.lit("cap")))
    kinds = same.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("v").alias("v"), F.first("label").alias("label"))
    # An id may stand for several vectors (repeated ids with other values), so nodes get numbers, fixed once written.
    kinds = staged(kinds.withColumn("id0", F.col("id")).withColumn("num", F.monotonically_increasing_id()), "caps-kinds")
    nodes = kinds.withColumn("id", F.col("num"))
    dims = sorted(r.d for r in kinds.select(F.size("v").alias("d")).distinct().collect())
    if not dims:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    each = [links(nodes.where(F.size("v") == d).select("id", "label", "v", "weight"), d, least, **how) for d in dims]
    found = staged(functools.reduce(DataFrame.unionByName, each), "caps-links")
    count = found.groupBy("id").agg(F.sum("n").alias("n"))
    part = components(found.select(F.col("id").alias("u"), F.col("low").alias("v")), "caps-cc").withColumnRenamed("u", "id")
    nodes = nodes.select("h1", "h2", "id", "id0", "weight").join(count, "id", "left").join(part, "id", "left")
    nodes = nodes.withColumn("component", F.coalesce("component", "id"))
    first = nodes.groupBy("component").agg(F.min("id0").alias("component_id"))
    nodes = nodes.join(first, "component").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = same.select("vec_id", "h1", "h2").join(nodes, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(F.col("vec_id").isNull() | F.col("label").isNull() | ~F.coalesce(usable("v"), F.lit(False)))
    out = out.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
