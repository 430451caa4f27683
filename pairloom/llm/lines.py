"""Line dedup by a segment-partition edit join.

Lines are compared in a normal form (lower case, white space squeezed). Equal lines of at least SHORTEST
characters are one line. Lines of at least MIN_CHARS also link within an edit distance that grows with the
shorter one's length: one edit, two from the first of STEPS on, three from the second on. A line of length l
that allows t edits is cut into t + 1 even segments, indexed under (l, number, segment); two lines within t
share a segment, so each line probes, for every shorter or equal length, the substrings at the positions that
such a match can have. The keys of all segments and substrings come from prefix sums of a polynomial, for many lines at
once. They travel packed, by buckets of keys; each bucket is matched by sorting. Candidates are verified with banded
bit-parallel edit distance. Linked lines form components, and of each component only the first line in the
corpus stays (by doc_id, then line), with the document around it.

A key that more than HOT different lines share (near copies of one page) does not make all pairs. All its lines meet
its smallest one first; after the components of these links, lines of different components of a key meet in
blocks of BLOCK, where lengths and the parity of hashed character pairs (an edit changes four bits at most) leave
almost only true pairs; those that nothing connects yet are verified, and only links leave the block. Work is linear but for lines that share a segment and are not linked.

Results: the documents with their other columns; the text without the dropped lines; and, from
``deduplicated``, n_lines and n_dropped (with an underscore where docs has such columns). Nulls: a null text stays null
and has no lines; null doc_ids come after all others. Repeated rows are one document and lose the same
lines. Lines that differ in case or white space count as equal, and the first of equals stays. A very long text or line is
worked on whole. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import postings
from .common import FEW_EDGES, columns, components, dropped, quoted, released, staged, unused

SHORTEST, MIN_CHARS, STEPS = 8, 24, (64, 128)
HOT, BLOCK = 32, 1024
#: Characters that a task hashes at a time, lines that it remembers.
CHARS, KNOWN = 1 << 18, 1 << 19
MOST = 1 + len(STEPS)
_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], dtype=np.uint64)


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def allowed(size: int) -> int:
    """How many edits a line of this length allows."""
    return 0 if size < MIN_CHARS else 1 + sum(size >= x for x in STEPS)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_id(text: str) -> tuple[int, int]:
    """128 bits of a normal line, as two signed longs."""
    from xxhash import xxh3_128_intdigest

    h = xxh3_128_intdigest(text.encode("utf-8", "surrogatepass"))
    return _signed(h >> 64), _signed(h & _M64)


class Keys:
    """Hashes of lines' own segments and of the substrings with which they probe other lines'."""

    def __init__(self) -> None:
        self.power = self.inverse = np.zeros(0, dtype=np.uint64)

    def __call__(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, line) of own segments, then of probes; all lines have MIN_CHARS or more."""
        c = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        if len(self.power) <= len(c):
            n = len(c) + 64
            self.power = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)], dtype=np.uint64)
            self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)], dtype=np.uint64)
        total = np.r_[np.uint64(0), np.cumsum((c + np.uint64(1)) * self.power[: len(c)], dtype=np.uint64)]
        size = np.array([len(x) for x in lines], dtype=np.int64)
        start = np.cumsum(size) - size
        own_key, own_line, probe_key, probe_line = [], [], [], []
        for t in range(1, MOST + 1):
            for more in range(t + 1):  # the probing line is so much longer
                length = size - more
                fits = (length >= MIN_CHARS) & (1 + sum((length >= x).astype(np.int64) for x in STEPS) == t)
                use = np.flatnonzero(fits)
                if not len(use):
                    continue
                l, s, at = length[use], size[use], start[use]
                short, long = l // (t + 1), l % (t + 1)
                for i in range(t + 1):
                    p, n = short * i + np.maximum(0, i - (t + 1 - long)), short + (i >= t + 1 - long)
                    salt = (l * 8 + i).astype(np.uint64) * _MIX[2]
                    for shift in range(max(-i, more - t + i), min(i, more + t - i) + 1):
                        ok = np.flatnonzero((p + shift >= 0) & (p + shift + n <= s))
                        q = at[ok] + p[ok] + shift
                        h = ((total[q + n[ok]] - total[q]) * self.inverse[q] ^ salt[ok]) * _MIX[0]
                        h = (h ^ h >> np.uint64(31)) * _MIX[1]
                        h ^= h >> np.uint64(29)
                        mine = not more and not shift
                        (own_key if mine else probe_key).append(h)
                        (own_line if mine else probe_line).append(use[ok])
        empty = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        return tuple(np.concatenate(x + y) for x, y in zip((own_key, own_line, probe_key, probe_line), (*empty, *empty), strict=True))


def within(a: str, b: str, threshold: int) -> bool:
    """Whether the edit distance of two strings is at most threshold: a bit-parallel band around the diagonal.

    Common ends are cut off first. The band has 2 * threshold + 1 bits; bit i of column j stands for row
    j - threshold + i. The score is followed along the band's lowest diagonal and then the last row.
    """
    if abs(len(a) - len(b)) > threshold:
        return False
    if a == b or not threshold:
        return a == b

    def same(x: str, y: str) -> int:
        low, high = 0, min(len(x), len(y))
        while low < high:
            mid = (low + high + 1) // 2
            if x[:mid] == y[:mid]:
                low = mid
            else:
                high = mid - 1
        return low

    n = same(a, b)
    a, b = a[n:], b[n:]
    n = same(a[::-1], b[::-1])
    a, b = a[: len(a) - n], b[: len(b) - n]
    m, n, t = len(a), len(b), threshold
    if min(m, n) <= t:  # what is left is shorter than the band
        row = list(range(n + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[n] <= t
    width = 2 * t + 1
    mask = (1 << width) - 1
    rows: dict[str, int] = {}  # for each character, the rows where it stands in a
    for i, c in enumerate(a):
        rows[c] = rows.get(c, 0) | 1 << i
    up, down, score, along = mask & ~((1 << t) - 1), 0, t, 1 << (width - 2)
    for j, c in enumerate(b):
        first = j - t  # the row of the band's lowest bit
        eq = rows.get(c, 0)
        eq = (eq >> first if first >= 0 else eq << -first) & mask
        same_diag = ((((eq & up) + up) ^ up) | eq | down) & mask
        right_up, right_down = down | (mask & ~(same_diag | up)), same_diag & up
        if j < m - t:  # down the band's lowest diagonal, then along the last row
            score += not same_diag >> (width - 1)
        else:
            score += bool(right_up & along) - bool(right_down & along)
            along >>= 1
        if score > 2 * t + n - (m - t):
            return False
        up, down = right_down | (mask & ~(same_diag >> 1 | right_up)), same_diag >> 1 & right_up
    return score <= t


def _with_key(docs: DataFrame, k1: str, k2: str) -> DataFrame:
    """Two hashes of (doc_id, text): what repeated rows have in common."""
    d, t = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.withColumn(k1, F.xxhash64(d, t)).withColumn(k2, F.xxhash64(t, d, F.lit("line")))


def occurrences(docs: DataFrame) -> DataFrame:
    """(h1, h2, at) of each line that takes part; at says where it stands."""
    rows = _with_key(docs.select("doc_id", "text"), "k1", "k2").select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("d"), "k1", "k2", F.col("text").cast("string").alias("t"))
    names = ["h1", "h2", "d", "k1", "k2", "line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for d, k1, k2, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for i, line in enumerate(t.split("\n") if t else ()):
                    s = normal(line)
                    if len(s) >= SHORTEST:
                        for c, v in zip(cols, (*line_id(s), d, k1, k2, i), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "line" else pa.int64()) for c, n in zip(cols, names, strict=True)], names=names)

    out = rows.mapInArrow(run, "h1 long, h2 long, d long, k1 long, k2 long, line int")
    return out.select("h1", "h2", F.struct("d", "k1", "k2", "line").alias("at"))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[postings.Entries, postings.Entries]]:
    """Own and probing keys of all lines; an id is h1 of a line. A task sends a line once while it remembers it."""
    keys, known, waiting, chars = Keys(), set(), [], 0

    def hashed() -> tuple[postings.Entries, postings.Entries]:
        ids = np.array([i for i, _ in waiting], dtype=np.int64)
        k, at, pk, pat = keys([s for _, s in waiting])
        return (k, ids[at]), (pk, ids[pat])

    for b in batches:
        for t in b.column(0).to_pylist():
            for line in t.split("\n") if t else ():
                if len(line) >= MIN_CHARS and len(s := normal(line)) >= MIN_CHARS and (i := line_id(s)[0]) not in known:
                    if len(known) > KNOWN:
                        known.clear()
                    known.add(i)
                    waiting.append((i, s))
                    chars += len(s)
                    if chars > CHARS:
                        yield hashed()
                        waiting, chars = [], 0
    if waiting:
        yield hashed()


def signature(text: str) -> tuple[int, int]:
    """128 bits: the parity of the character pairs that hash to each. One edit changes four of them at most."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    h = (c[:-1] * _MIX[0] ^ c[1:]) * _MIX[1]
    bits = np.bincount((h >> np.uint64(57)).astype(np.int64), minlength=128) & 1
    low, high = np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8").tolist()
    return low, high


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(num, h1, s, size, p1, p2): normal form, length and signature of the lines that wanted (k1, k2, lines: line, num) names."""
    names = ["num", "h1", "s", "size", "p1", "p2"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, lines in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                every = t.split("\n")
                for x in lines:
                    s = normal(every[x["line"]])
                    rows.append((x["num"], line_id(s)[0], s, len(s), *signature(s)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in range(6)], names=names)

    rows = _with_key(docs.select("doc_id", "text"), "k1", "k2").select("k1", "k2", F.col("text").cast("string").alias("t"))
    rows = rows.join(wanted, ["k1", "k2"]).select("t", "lines")
    return rows.mapInArrow(run, "num long, h1 long, s string, size int, p1 long, p2 long").dropDuplicates(["num"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): numbers of the lines that pairs (a, b) names by h1 and that are near enough."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = pa.array([_linked(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["u", "v"])

    one = texts.select(F.col("h1").alias("a"), F.col("num").alias("u"), F.col("s").alias("x"))
    two = texts.select(F.col("h1").alias("b"), F.col("num").alias("v"), F.col("s").alias("y"))
    both = pairs.join(one, "a").join(two, "b").select("u", "v", "x", "y")
    return staged(both.mapInArrow(verify, "u long, v long"), "line-links")


def _linked(x: str, y: str) -> bool:
    return within(x, y, allowed(min(len(x), len(y))))


def _near(c: dict[str, np.ndarray], x: slice) -> np.ndarray:
    """Which lines may be near by length and signature."""
    size = c["size"]
    low = np.minimum(size[x, None], size)
    edits = 1 + sum((low >= s).astype(np.int64) for s in STEPS)
    p, q = c["p1"].view(np.uint64), c["p2"].view(np.uint64)  # of signed numbers the bits of the absolute value would count
    bits = np.bitwise_count(p[x, None] ^ p).astype(np.int64) + np.bitwise_count(q[x, None] ^ q)
    return (np.abs(size[x, None] - size) <= edits) & (bits <= 4 * edits)


def dropped_lines(docs: DataFrame, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(k1, k2, drop): for each document that loses lines, the numbers of these lines."""
    seen = staged(occurrences(docs), "lines")
    kinds = seen.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    kinds = staged(kinds.withColumn("num", F.monotonically_increasing_id()), "line-kinds")  # fixed once written
    entries = postings.packed(docs.select(F.col("text").cast("string")), _entries, postings.buckets_for(kinds.count() * 24))
    found = staged(postings.candidates(entries, hot), "line-candidates")
    pairs = postings.pairs(found)
    members = found.where("role > 0").select("key", F.col("b").alias("a"), "role")
    ids = found.select(F.explode(F.expr("if(role = 0, array(a, b), array(b))")).alias("h1")).distinct()  # a hot key's first line is a member too
    places = kinds.select("h1", "num", "first").join(ids, "h1")
    wanted = places.groupBy(F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2")).agg(F.collect_list(F.struct("first.line", "num")).alias("lines"))
    texts = staged(_texts(docs, wanted), "line-texts")
    released(docs.sparkSession)
    links = _verified(pairs, texts)
    part = components(links, "line-cc", FEW_EDGES)
    if not members.isEmpty():
        nodes = texts.join(part.withColumnRenamed("u", "num"), "num", "left").withColumn("part", F.coalesce("component", "num"))
        rows = members.join(nodes.select(F.col("h1").alias("a"), "num", "part", "size", "p1", "p2"), "a")
        rows = rows.groupBy("key", "num").agg(F.min("role").alias("role"), *(F.first(c).alias(c) for c in ("part", "size", "p1", "p2")))
        rest = postings.apart(rows.select("key", "num", "part", "role", F.col("size").alias("bytes"), "size", "p1", "p2"), _near, _linked, block, texts.select("num", "s"))
        links = links.unionByName(staged(rest, "line-rest"))
        part = components(links, "line-cc", FEW_EDGES)
    linked = kinds.join(part.withColumnRenamed("u", "num"), "num", "left").withColumn("component", F.coalesce("component", "num"))
    first = linked.groupBy("component").agg(F.min("first").alias("stays"))
    again = linked.join(first, "component").where("n > 1 or first <> stays").select("h1", "h2", "stays")
    gone = seen.select("h1", "h2", "at").join(again, ["h1", "h2"]).where("at <> stays")
    gone = staged(gone.groupBy(F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2")).agg(F.collect_set("at.line").alias("drop")), "line-gone")
    for used in (seen, kinds, found, texts):
        dropped(used)
    released(docs.sparkSession)
    return gone


def deduplicated(docs: DataFrame, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """The rows of docs without their dropped lines, with two more columns, last: n_lines and n_dropped."""
    k1, k2, drop, lines, total, less = unused(docs, "k1", "k2", "drop", "lines", "n_lines", "n_dropped")
    gone = dropped_lines(docs, hot, block).toDF(k1, k2, drop)
    rows = _with_key(docs, k1, k2).join(gone, [k1, k2], "left")
    rows = rows.withColumn(lines, F.split(F.col("text").cast("string"), "\n", -1))
    kept = f"array_join(transform(array_except(sequence(0, size({lines}) - 1), {drop}), i -> {lines}[i]), '\n')"
    return rows.select(
        *[F.expr(f"if({drop} is null, {quoted(c)}, {kept})").alias(c) if c.lower() == "text" else F.col(quoted(c)) for c in docs.columns],
        F.expr(f"if({lines} is null, 0, size({lines}))").alias(total),
        F.expr(f"if({drop} is null, 0, size({drop}))").alias(less),
    )


def without_copies(docs: DataFrame, **how: int) -> DataFrame:
    """The documents with their columns and without their dropped lines; those that lost lines and keep nothing but blank ones go."""
    rows = deduplicated(docs, **how)
    return rows.where((F.col(rows.columns[-1]) == 0) | F.col("text").rlike(r"(?U)\S")).select(*columns(docs))
