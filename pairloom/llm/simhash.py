"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are of 64 bits; two link if at most ``distance`` (here 2) bits differ. Equal fingerprints are
one node. Of four blocks of 16 bits two differing bits leave two blocks alone, so linked fingerprints
share one of six block pairs: these 32 bits are the roots of the index and the key by which the
fingerprints are dealt out. Below a root the fingerprints stand in Gray order and are grouped four by
four; a node holds the bits that all below it share and that no node above it has yet. A search adds up
the differences on its way down and leaves a whole group as soon as they exceed the distance.

A root with more than GROUP fingerprints (a large group of near copies) is not searched in one task.
Its fingerprints are linked through midpoints: two differ in at most 2 bits exactly if some value is
within 1 bit of both. Each emits itself and its 64 neighbours; a value's group has at most 65 members, all
linked to each other. That is linear in the group and exact.

Links leave a task as stars (to the smallest member of each local component), so a clique of copies
makes no more rows than it has members.

near_copies() is the wider setting of the pipeline's stage. At a Jaccard similarity of 0.8 two fingerprints
differ in some ten bits, and no root of the index is both selective and safe at such a distance. Documents
link there as above or if their sets of five-word shingles have a similarity of at least 0.8, by an exact
set join: of a set of n shingle hashes the first n - ceil(0.8 n) + 1 are its keys, and two similar sets
share one, whatever the order, if it is the same for all. The first that they share stands early enough in both that
the rests can hold what the similarity asks for; entries carry size and place, so other pairs are not made. Shingles that are common in a sample come last in
it; the sample sets the work and not the result. Equal sets are one node. Sets that share a key are candidates, at hot
keys first with the key's smallest set alone; those that are left apart meet in blocks, out of which only links come (postings.py). Sizes, and
the parity of 1024 bits to which shingles hash (two sets differ in no fewer shingles than their parities in bits), for
longer sets of at least as many bits as shingles, leave almost only true pairs, which are verified on the whole sets.

Nulls: a null text is an empty one, with fingerprint zero, which links like any other. A row with a null
doc_id gets its fingerprint and its component's smallest known doc_id (null if there is none). Repeated
rows come back repeated. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import postings
from .common import FEW_EDGES, WordHashes, columns, components, dropped, local_roots, released, staged, unused

WORDS, SEED, DISTANCE, GROUP = 3, 42, 2, 1024
CHUNK = 1 << 15
#: Of near_copies: words of a shingle, and the least Jaccard similarity as a fraction.
SHINGLE, SIMILAR = 5, (4, 5)
#: Sets of a key that make all pairs, members of a block, longs of the parity.
SHARED, BLOCK, PARITY = 16, 512, 16
#: So many wanted documents (16 bytes each) are broadcast to the texts; more are joined by a shuffle.
FEW = 1 << 17
#: The order of its shingles: documents that are counted, how many of them make a shingle common, most shingles that are put last.
COUNTED, COMMON, LAST = 20_000, 3, 200_000
PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]


def _shingles(w: list[bytes], words: int) -> list[bytes]:
    return list(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))) if len(w) >= words else [b" ".join(w)]


def fingerprint(raw: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text, as an unsigned number."""
    from xxhash import xxh64_intdigest

    w = raw.lower().split()  # on bytes: A-Z only, and white space is x20 and x09 to x0D
    if not w:
        return 0
    shingles = _shingles(w, words)
    count = np.zeros(64, dtype=np.int64)
    for k in range(0, len(shingles), CHUNK):
        h = np.array([xxh64_intdigest(s, seed) for s in shingles[k : k + CHUNK]], dtype="<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(t) if t else 0 for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, fp long")


_words = WordHashes()


def shingle_set(raw: bytes, words: int = SHINGLE) -> np.ndarray:
    """The hashes of the shingles of a UTF-8 text, sorted, each once."""
    w = _words(np.frombuffer(raw.lower(), dtype=np.uint8))
    n = min(words, len(w))
    if not n:
        return w
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k]
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB))


def parity(s: np.ndarray, size: int = 64 * PARITY) -> np.ndarray:
    """So many bits (a power of two): whether an odd number of the set's hashes falls on each."""
    bits = np.bincount((s >> np.uint64(8) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def wide(s: np.ndarray) -> bytes | None:
    """Of a set with more shingles than its parity has bits: its size and a parity of at least as many bits."""
    n = len(s)
    return np.r_[np.int64(n), parity(s, 1 << (n - 1).bit_length())].tobytes() if n > 64 * PARITY else None


def set_id(s: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(s.tobytes(), 1)
    return x - (1 << 64) if x >> 63 else x


class GrayIndex:
    """Fingerprints sorted by group and, within it, by Gray rank; levels of nodes over them.

    ``levels[0]`` are the fingerprints and ``levels[-1]`` one root for each group. A level holds each
    node's shared bits, their pattern, its first child and the end of its leaves.
    """

    def __init__(self, fp: np.ndarray, group: np.ndarray, fan: int = 4):
        self.fp, n = fp, len(fp)
        ones = np.full(n, ~np.uint64(0))
        self.levels = [(ones, fp, np.arange(n + 1), np.arange(1, n + 1))]
        low, high, g, end = fp, fp, group, np.arange(1, n + 1)
        while True:
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            within = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
            start = np.flatnonzero(within % fan == 0)
            low, high = np.bitwise_and.reduceat(low, start), np.bitwise_or.reduceat(high, start)
            end = end[np.r_[start[1:], len(g)] - 1]
            mask = ~(low ^ high)
            self.levels.append((mask, low & mask, np.r_[start, len(g)], end))
            g = g[start]
            if len(first) == len(start):
                break
        self.group = group

    def links(self, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (i, j), i < j, of one group whose fingerprints differ in at most so many bits."""
        first = np.r_[True, self.group[1:] != self.group[:-1]]
        q, node = np.arange(len(self.fp)), np.cumsum(first) - 1
        mask, pattern, child, end = self.levels[-1]
        spent = np.zeros(len(q), dtype=np.int64)  # a group's members all have the root's bits
        for depth in range(len(self.levels) - 2, -1, -1):
            n = child[node + 1] - child[node]
            q, up, spent = np.repeat(q, n), np.repeat(node, n), np.repeat(spent, n)
            at = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + child[up]
            above = mask[up]
            mask, pattern, child, end = self.levels[depth]
            spent = spent + np.bitwise_count((self.fp[q] ^ pattern[at]) & mask[at] & ~above)
            keep = (spent <= distance) & (end[at] - 1 > q)
            q, node, spent = q[keep], at[keep], spent[keep]
        return q, node


def _gray_rank(fp: Column) -> Column:
    """The rank of a code word in Gray order (bits of a long)."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp


def links(nodes: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """Star links (u, v) that connect exactly what links of at most ``distance`` differing bits connect."""
    if distance > 2:
        raise ValueError("the roots cover distances up to 2")
    block = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    keys = [F.struct(F.lit(c).alias("c"), F.shiftleft(block[a], 16).bitwiseOR(block[b]).alias("k")) for c, (a, b) in enumerate(PAIRS)]
    rows = nodes.select("fp", F.explode(F.array(*keys)).alias("x")).select("fp", "x.c", "x.k")
    size = rows.groupBy("c", "k").count().where("count > 1")
    rows = staged(rows.join(size, ["c", "k"]), "simhash-roots")  # most fingerprints share no root and go here

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(g: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            root = local_roots(len(fp), *GrayIndex(fp.view(np.uint64), g).links(distance)) if len(fp) else np.zeros(0, np.int64)
            own = np.flatnonzero(root != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(fp[root[own]])], names=["u", "v"])

        rest_g, rest = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            c, k, fp = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            g, fp = np.r_[rest_g, c << 32 | k], np.r_[rest, fp]
            if not len(g):
                continue
            cut = int(np.flatnonzero(g == g[-1])[0])  # the last group may go on in the next batch
            rest_g, rest = g[cut:], fp[cut:]
            yield found(g[:cut], fp[:cut])
        yield found(rest_g, rest)

    few = rows.where(F.col("count") <= group).repartition("c", "k").sortWithinPartitions("c", "k", _gray_rank(F.col("fp")))
    stars = few.select("c", "k", "fp").mapInArrow(search, "u long, v long")
    many = rows.where(F.col("count") > group).select("fp").distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    middle = many.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("m"))
    if distance == 2:
        near = middle.groupBy("m").agg(F.collect_set("fp").alias("near")).where("size(near) > 1")  # 65 at most
    else:  # one bit: a midpoint is one of the two
        near = middle.join(many.select(F.col("fp").alias("m"), F.lit(True).alias("own")), "m").where("fp <> m" if distance else "false")
        near = near.select(F.array("fp", "m").alias("near"))
    near = near.select(F.array_min("near").alias("v"), F.explode("near").alias("u")).where("u <> v")
    return stars.unionByName(near.select("u", "v"))


def _common(docs: DataFrame) -> np.ndarray:
    """Shingles that stand in several of at most about COUNTED documents, sorted; at most LAST."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t).view(np.int64))], names=["key"])

    every = max(1, docs.count() // COUNTED)
    rows = docs.where("length(text) > 0").where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select(F.col("text").cast("string").alias("t")).distinct()
    keys = rows.select(F.col("t").cast("binary")).mapInArrow(run, "key long").groupBy("key").count()
    top = keys.where(F.col("count") >= COMMON).orderBy(F.desc("count"), "key").limit(LAST)
    return np.sort(top.select("key").toArrow().column(0).to_numpy().view(np.uint64))


def _placed(docs: DataFrame) -> DataFrame:
    """(d, k1, k2, text): a null doc_id comes last; two hashes of doc_id and text tell documents apart."""
    d, t = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(F.coalesce(d, F.lit((1 << 63) - 1)).alias("d"), F.xxhash64(d, t).alias("k1"), F.xxhash64(t, d, F.lit("copy")).alias("k2"), t.cast("binary").alias("t"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(d, k1, k2, fp, id, n, keys, parity, wide): the fingerprint, and of the set of shingles its id, size, keys and parities."""
    num, den = SIMILAR
    common = docs.sparkSession.sparkContext.broadcast(_common(docs))  # LAST numbers at most
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = ["d", "k1", "k2", "fp", "id", "n", "keys", "parity", "wide"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in b.column(3).to_pylist():
                s = shingle_set(t or b"")
                n, fp = len(s), fingerprint(t) if t else 0
                late = known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s if len(known) else np.zeros(n, bool)
                first = np.r_[s[~late], s[late]][: n + num * n // -den + 1 if n else 0]
                for c, v in zip(cols, (fp - (1 << 64) if fp >> 63 else fp, set_id(s), n, first.tobytes(), parity(s).tobytes(), wide(s)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, k) for c, k in zip(cols, kinds[3:], strict=True))], names=names)

    return _placed(docs).mapInArrow(run, "d long, k1 long, k2 long, fp long, id long, n int, keys binary, parity binary, wide binary")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[postings.Entries, postings.Entries]]:
    for b in batches:
        keys = [np.frombuffer(k, dtype=np.uint64) for k in b.column(1).to_pylist()]
        count = np.array([len(k) for k in keys], dtype=np.int64)
        ids, n = (np.repeat(b.column(c).to_numpy().astype(np.int64), count) for c in (0, 2))
        mark = np.where(n < 1 << 16, n << 16 | np.arange(len(n)) - np.repeat(np.cumsum(count) - count, count), 0)
        yield (np.concatenate([*keys, np.zeros(0, np.uint64)]), ids, mark.astype(np.uint32)), (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32))


def _may_meet(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether two sets may be similar whose first common key has these marks: size and place in the order (0: not known).

    They have no more shingles in common than the shorter rest from that key on.
    """
    num, den = SIMILAR
    n, m, i, j = (v.astype(np.int64) for v in (x >> 16, y >> 16, x & 0xFFFF, y & 0xFFFF))
    return (n == 0) | (m == 0) | ((num + den) * np.minimum(n - i, m - j) >= num * (n + m))


def _longs() -> list[Column]:
    """The parity as PARITY longs (of reversed bytes, the same for all)."""
    return [F.conv(F.hex(F.substring("parity", 8 * k + 1, 8)), 16, -10).cast("long").alias(f"p{k}") for k in range(PARITY)]


def _may(n: np.ndarray, m: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles whose parities differ in so many bits may be similar."""
    num, den = SIMILAR
    return (den * np.minimum(n, m) >= num * np.maximum(n, m)) & ((den + num) * bits <= (den - num) * (n + m))


def _near(c: dict[str, np.ndarray], x: slice) -> np.ndarray:
    every = [c[f"p{k}"].view(np.uint64) for k in range(PARITY)]  # of signed numbers the bits of the absolute value would count
    bits = sum(np.bitwise_count(p[x, None] ^ p).astype(np.int64) for p in every)
    return _may(c["n"][x, None], c["n"], bits)


def _may_wide(x: bytes | None, y: bytes | None) -> bool:
    """_may() of two wide parities, the longer one folded; sets without one are left to the parity of all."""
    if x is None or y is None:
        return True
    p, q = sorted((np.frombuffer(z, dtype=np.uint64) for z in (x, y)), key=len)
    bits = np.bitwise_count(p[1:] ^ np.bitwise_xor.reduce(q[1:].reshape(-1, len(p) - 1), axis=0)).sum(dtype=np.int64)
    return bool(_may(p[0].astype(np.int64), q[0].astype(np.int64), bits))


def _likely(pairs: DataFrame, kinds: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of set ids whose sizes and parities allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), dtype=np.uint64).reshape(-1, PARITY) for k in (4, 5))
            n, m = (b.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            ok = pa.array(_may(n, m, np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["u", "v"])

    one, two = (kinds.select(F.col("id").alias(c), F.col("n").alias("n" + c), F.col("parity").alias("p" + c)) for c in "ab")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "pa", "pb")
    some = staged(both.mapInArrow(run, "u long, v long"), "simhash-may")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = pa.array([_may_wide(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["u", "v"])

    one, two = (kinds.select(F.col("id").alias(c), F.col("wide").alias("w" + c)) for c in "uv")
    out = staged(some.join(one, "u").join(two, "v").select("u", "v", "wu", "wv").mapInArrow(again, "u long, v long"), "simhash-likely")
    dropped(some)
    return out


def _sets(docs: DataFrame, kinds: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, s): the whole sets, as bytes, of the wanted ids (id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [shingle_set(t or b"") for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in s], pa.int64()), pa.array([x.tobytes() for x in s], pa.binary())], names=["id", "s"])

    wanted = staged(kinds.join(ids.distinct(), "id").select("at.k1", "at.k2"), "simhash-wanted")
    rows = _placed(docs).join(F.broadcast(wanted) if wanted.count() <= FEW else wanted, ["k1", "k2"]).select("t")
    of = staged(rows.mapInArrow(run, "id long, s binary").dropDuplicates(["id"]), "simhash-sets")
    dropped(wanted)
    return of


def _similar(x: bytes, y: bytes) -> bool:
    num, den = SIMILAR
    both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]), kind="stable")
    n = int((both[1:] == both[:-1]).sum())
    return den * n >= num * (len(both) - n)


def _verified(docs: DataFrame, kinds: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) of set ids whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = pa.array([_similar(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["u", "v"])

    of = _sets(docs, kinds, pairs.select(F.explode(F.array("u", "v")).alias("id")))
    both = pairs.join(of.select(F.col("id").alias("u"), "s"), "u").join(of.select(F.col("id").alias("v"), F.col("s").alias("r")), "v")
    links = staged(both.select("u", "v", "s", "r").mapInArrow(run, "u long, v long"), "simhash-similar")
    dropped(of)
    del both, of
    released(docs.sparkSession)
    return links


def _once(some: DataFrame) -> DataFrame:
    """Members (key, id) without keys that would compare the same ones again: one key stands for all with equal sums of hashes."""
    sums = [F.sum(F.xxhash64("id", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in range(2)]
    alone = some.groupBy("key").agg(F.count("*").alias("size"), *sums).groupBy("size", "s0", "s1").agg(F.min("key").alias("key"))
    return staged(some.join(alone.select("key"), "key", "left_semi"), "simhash-keys")


def similar_sets(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """Links (u, v) of set ids that connect exactly what similar sets connect."""
    entries = (kinds.agg(F.sum("n")).first()[0] or 0) // SIMILAR[1]
    found = staged(postings.candidates(postings.packed(kinds.select("id", "keys", "n"), _entries, postings.buckets_for(entries)), SHARED, _may_meet), "simhash-candidates")
    released(docs.sparkSession)
    # Whole sets travel with pairs, so each set meets its smallest partner first; then those pairs that this leaves apart.
    likely = _likely(postings.pairs(found), kinds)
    first = staged(likely.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), "simhash-first")
    links = _verified(docs, kinds, first)
    part = components(links, "simhash-near", FEW_EDGES)
    rest = likely.join(first, ["u", "v"], "left_anti")
    for end, c in (("u", "x"), ("v", "y")):
        rest = rest.join(part.select(F.col("u").alias(end), F.col("component").alias(c)), end, "left").withColumn(c, F.coalesce(c, end))
    links = links.unionByName(_verified(docs, kinds, staged(rest.where("x <> y").select("u", "v"), "simhash-others")))
    dropped(likely)
    released(docs.sparkSession)
    members = found.where("role > 0").select("key", F.col("b").alias("id"), "role")
    if members.isEmpty():
        return links
    part = components(links, "simhash-near", FEW_EDGES).withColumnRenamed("u", "id")
    nodes = kinds.join(part, "id", "left").select("id", F.coalesce("component", "id").alias("part"), "n", *_longs())
    long = ["key", F.col("id").alias("num"), "part", "role"]
    rows = members.join(nodes, "id").select(*long, F.lit(0).cast("long").alias("bytes"), "n", *(f"p{k}" for k in range(PARITY)))
    some = staged(postings.apart(rows, _near, None, BLOCK).toDF("key", "id"), "simhash-mixed")
    once = _once(some)
    # Of long sets the short parity says nothing, so wide ones travel first and whole sets for those that they leave.
    wides = kinds.select(F.col("id").alias("num"), F.col("wide").alias("s"))
    rows = members.join(once, ["key", "id"]).join(nodes, "id")
    rows = rows.select(*long, (F.col("n") / 8).cast("long").alias("bytes"), "n", *(f"p{k}" for k in range(PARITY)))
    left = staged(postings.apart(rows, _near, _may_wide, BLOCK, wides, marks=True).toDF("key", "id"), "simhash-left")
    last = _once(left)
    rows = members.join(last, ["key", "id"]).join(nodes, "id")
    rows = rows.select(*long, (8 * F.col("n")).cast("long").alias("bytes"), "n", *(f"p{k}" for k in range(PARITY)))
    sets = _sets(docs, kinds, left.select("id")).select(F.col("id").alias("num"), "s")
    links = links.unionByName(staged(postings.apart(rows, _near, _similar, BLOCK, sets), "simhash-rest"))
    for used in (found, some, once, left, last):
        dropped(used)
    released(docs.sparkSession)
    return links


def near_copies(docs: DataFrame) -> DataFrame:
    """(d, k1, k2, component) of each document, of links by fingerprints and by similar sets."""
    seen = staged(_keyed(docs), "simhash-seen")
    nodes = seen.select("fp").distinct()
    kinds = seen.groupBy("id").agg(F.min("n").alias("n"), F.min(F.struct("k1", "k2")).alias("at"), F.first("keys").alias("keys"), F.first("parity").alias("parity"), F.first("wide").alias("wide"))
    kinds = staged(kinds, "simhash-kinds")
    edges = links(nodes).unionByName(similar_sets(docs, kinds)).unionByName(seen.select(F.col("fp").alias("u"), F.col("id").alias("v")))
    part = components(edges, "simhash-cc", FEW_EDGES).withColumnRenamed("u", "fp")
    out = staged(seen.select("d", "k1", "k2", "fp").join(part, "fp", "left").select("d", "k1", "k2", F.coalesce("component", "fp").alias("component")), "simhash-parts")
    dropped(seen)
    dropped(kinds)
    released(docs.sparkSession)
    return out


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each document."""
    fps = staged(fingerprints(docs), "simhash")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    part = components(links(nodes, distance, group), "simhash-cc").withColumnRenamed("u", "fp")
    nodes = nodes.join(part, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = nodes.groupBy("component").agg(F.min("low").alias("component_id"))
    nodes = nodes.join(least, "component").select("fp", "component_id")
    out = fps.join(nodes, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component of near_copies(), with all its columns: that of the smallest doc_id, then hashes.

    A row without a doc_id comes after all others. Of rows with equal doc_id and text one stays.
    """
    k1, k2, row = unused(docs, "k1", "k2", "row")
    stays = near_copies(docs).groupBy("component").agg(F.min(F.struct("d", "k1", "k2")).alias("first"))
    stays = stays.select(F.col("first.k1").alias(k1), F.col("first.k2").alias(k2))
    d, t = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.withColumn(k1, F.xxhash64(d, t)).withColumn(k2, F.xxhash64(t, d, F.lit("copy"))).join(stays, [k1, k2], "left_semi")
    order = F.xxhash64(F.to_json(F.struct(*columns(docs))))
    rows = rows.withColumn(row, order)
    again = rows.groupBy(k1, k2).agg(F.min(row).alias(row))
    return rows.join(again, [k1, k2, row], "left_semi").dropDuplicates([k1, k2, row]).select(*columns(docs))
