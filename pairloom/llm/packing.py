"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

A bin is filled greedily with the longest piece that still fits. If a gap is left, the bin's shortest
piece is taken out, and the two unpacked pieces that fill the widened gap most tightly (and more
tightly than the piece did) go in instead.

Packing depends on lengths alone, and there are at most ``capacity`` different lengths. So the plan is
made on the histogram of lengths (a table of bounded size): a bin's filling is repeated as often as the
counts allow, which gives a list of patterns with multiplicities. The pieces are then numbered within
their length, in parallel, and take the places of that number. No piece is sent to the driver.

Nulls: a null text is an empty one, which is one end token; a null doc_id stays null and is packed like
any other. Repeated rows are packed each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import staged

CAPACITY = 2048
END_ID = 0
#: Characters for which the normaliser is plain lower-casing and the split pattern is the one below.
PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÿ]*")
_LETTERS = "a-zß-öø-ÿ"
WORDS = re.compile(rf"[{_LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s0-9{_LETTERS}]+")
CACHE_WORDS = 500_000
CACHE_CHARS = 64


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write UTF-8 bytes."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(other)}


LETTERS = _byte_letters()


class WordTokenizer:
    """Token ids of whole texts as little-endian 32-bit bytes, with a bounded cache of words.

    The vocabulary's merges never cross its pre-tokens, so a text's ids are the ids of its pre-tokens,
    one after another. Texts with characters outside PLAIN, or with what may be a special token's
    string, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        self.bytes = [i.to_bytes(4, "little") for i in range(self.lib.get_vocab_size())]
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.lib.encode_batch(texts, add_special_tokens=False)]

    def _chunk(self, chunk: str) -> bytes:
        """Ids of what stands between white space; no pre-token reaches over white space."""
        out = []
        for w in WORDS.findall(chunk):
            got = self.words.get(w)
            if got is None:
                plain = w if w.isascii() else "".join([LETTERS[b] for b in w.encode()])
                got = b"".join([self.bytes[t.id] for t in self.model.tokenize(plain)])
                if len(w) <= CACHE_CHARS:
                    self.words[w] = got
            out.append(got)
        got = b"".join(out)
        if len(chunk) <= CACHE_CHARS:
            self.chunks[chunk] = got
        return got

    def encode(self, text: str) -> bytes:
        if "<|" in text or not PLAIN.fullmatch(text):
            return self._library([text])[0]
        for name in ("words", "chunks"):
            if len(getattr(self, name)) > CACHE_WORDS:  # those that came first are the frequent ones
                setattr(self, name, dict(itertools.islice(getattr(self, name).items(), CACHE_WORDS // 4)))
        get, chunk = self.chunks.get, self._chunk
        return b"".join([get(c) or chunk(c) for c in text.lower().split()])


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and an end id, cut at capacity."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = _tokenizer(tokenizer), np.asarray([end_id], dtype="<u4").tobytes()
        width = 4 * capacity
        for b in batches:
            cols: list[list] = [[] for _ in fields]
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = (tok.encode(t) if t else b"") + end
                for k in range(0, len(ids), width):
                    part = ids[k : k + width]
                    row = (d, k // width, k // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, dtype="<i4"))
                    for c, v in zip(cols, row, strict=False):
                        c.append(v)
            yield pa.record_batch([pa.array(c, f[1]) for c, f in zip(cols, fields, strict=True)], schema=pa.schema(fields))

    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, out)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths of a bin, longest first) with multiplicities, from how many pieces have each length."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for k, n in counts.items():
        left[k] = n
    patterns = []
    while True:
        avail = np.flatnonzero(left)
        if not len(avail):
            return patterns
        need: dict[int, int] = {}
        gap, at = capacity, len(avail)
        while gap and at:
            at = min(at, int(np.searchsorted(avail, gap, "right")))
            if not at:
                break
            at -= 1
            size = int(avail[at])
            n = int(min(left[size], gap // size))
            need[size] = n
            gap -= n * size
        small = min(need)
        if gap:
            room = gap + small
            need[small] -= 1
            free = np.asarray([x for x in avail[: np.searchsorted(avail, room, "right")] if left[x] > need.get(int(x), 0)], dtype=np.int64)
            if len(free):
                j = np.searchsorted(free, room - free, "right") - 1
                same = (j >= 0) & (free[np.maximum(j, 0)] == free)
                twice = np.asarray([left[x] - need.get(int(x), 0) >= 2 for x in free])
                j = np.where(same & ~twice, j - 1, j)
                total = np.where(j >= 0, free + free[np.maximum(j, 0)], 0)
                best = len(total) - 1 - int(np.argmax(total[::-1]))
                if total[best] > small:
                    for x in (int(free[best]), int(free[j[best]])):
                        need[x] = need.get(x, 0) + 1
                else:
                    need[small] += 1
            else:
                need[small] += 1
        need = {k: n for k, n in need.items() if n}
        times = int(min(left[k] // n for k, n in need.items()))
        for k, n in need.items():
            left[k] -= n * times
        patterns.append(([k for k in sorted(need, reverse=True) for _ in range(need[k])], times))


def _places(patterns: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ranks within a length: sorted keys (length << 40 | first rank), first sequence, offset."""
    seen: dict[int, int] = {}
    rows, base = [], 0
    for lengths, times in patterns:
        at = 0
        for size in lengths:
            r = seen.get(size, 0)
            rows.append((size << 40 | r, base, at))
            seen[size] = r + times
            at += size
        base += times
    a = np.asarray(sorted(rows), dtype=np.int64).reshape(-1, 3)
    return a[:, 0].copy(), a[:, 1].copy(), a[:, 2].copy()


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows that have length (1 to capacity) and an identity (doc_id, piece)."""
    counts = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # at most capacity rows
    keys, bases, offsets = _places(plan(counts, capacity))
    buckets = max(64, sum(counts.values()) // 20_000)
    rows = parts.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = rows.groupBy("length", "_b").count()
    w = Window.partitionBy("length").orderBy("_b")  # no more rows than buckets for a length
    before = before.select("length", "_b", (F.sum("count").over(w) - F.col("count")).alias("_before"))
    w = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")
    rows = rows.withColumn("_r", F.row_number().over(w)).join(before, ["length", "_b"])
    rows = rows.withColumn("_r", F.col("_r") - 1 + F.col("_before")).drop("_b", "_before")
    shape = rows.drop("_r").schema
    at = rows.columns.index("_r"), rows.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank, size = (b.column(i).to_numpy(zero_copy_only=False) for i in at)
            slot = np.searchsorted(keys, (size << 40) + rank, "right") - 1
            seq, off = bases[slot] + (size << 40) + rank - keys[slot], offsets[slot]
            cols = [(n, c) for n, c in zip(b.schema.names, b.columns, strict=True) if n != "_r"]
            cols += [("sequence_id", pa.array(seq)), ("offset", pa.array(off))]
            yield pa.RecordBatch.from_arrays([c for _, c in cols], names=[n for n, _ in cols])

    return rows.mapInArrow(run, shape.add("sequence_id", "long").add("offset", "long"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises once into the shared folder (without the ids), then packs."""
    out = pack(staged(pieces(docs, tokenizer, capacity), "pieces"), capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
