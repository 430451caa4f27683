"""Offset-preserving SentencePiece encoding and decoding.

Normalising walks the text by the longest prefix that the model's compiled character map knows (a
double-array trie of UTF-8 keys) and notes for each normalised byte the source byte it comes from.
Segmentation then runs on the normalised text, and each piece is projected back through that
alignment to the byte span of the original text.

Segmentation is byte-pair merging of the normalised text: the best-scored adjacent pair first. Where no
piece has the space mark but at its front (or consists of marks), merges never cross the start of a run
of marks, so each such chunk is merged on its own and kept in a bounded cache. Characters that no piece covers
become byte pieces, or the unknown id if the model has none. Decoding joins the pieces' surfaces, without
the mark of the dummy prefix, and reads runs of byte pieces as UTF-8 (a broken byte becomes U+FFFD).
The library itself takes no part; the tests hold ids and texts against it.

Nulls: a null text is an empty one (the end id alone; it decodes to an empty text). Ids of repeated
rows are repeated. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
CHUNKS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
CACHE_CHUNKS = 300_000
CACHE_CHARS = 64
SHORT, ABREAST, TOGETHER = 64, 1 << 14, 1 << 20
NO_PIECE, GONE, NEVER = -1, -2, 1 << 30
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a serialised protocol buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        v = s = 0
        while True:
            x = b[i]
            i += 1
            v |= (x & 127) << s
            s += 7
            if x < 128:
                return v

    while i < len(b):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        n = number() if kind == 2 else 4 if kind == 5 else 8
        yield tag >> 3, b[i : i + n]
        i += n


class CharMap:
    """The compiled character map: size of the trie, its units, then the replacements, each ended by NUL."""

    def __init__(self, blob: bytes):
        self.units, self.text = [], b""
        if blob:
            n = struct.unpack_from("<I", blob)[0]
            self.units = list(struct.unpack_from(f"<{n // 4}I", blob, 4))
            self.text = blob[4 + n :]

    def longest(self, b: bytes, at: int) -> tuple[bytes, int]:
        """The replacement of the longest known prefix of b[at:], and how many source bytes it takes (0: none)."""
        if not self.units:
            return b"", 0
        found, pos, unit = (-1, 0), 0, self.units[0]
        pos ^= (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(b)):
            pos ^= b[i]
            if pos >= len(self.units):
                break
            unit = self.units[pos]
            if unit & 0x800000FF != b[i]:
                break
            pos ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (self.units[pos] & 0x7FFFFFFF, i + 1 - at)
        if not found[1]:
            return b"", 0
        return self.text[found[0] : self.text.index(b"\0", found[0])], found[1]


class Pairs:
    """Which two symbols merge, and how soon: an open-addressing table over pairs of symbol numbers.

    Symbols are the pieces and, numbered after them, characters that stand in pieces without being one.
    """

    def __init__(self, ids: dict[str, int], cost: dict[str, float], n: int):
        symbols = dict(ids)
        for c in sorted(set("".join(ids))):
            if c not in symbols:
                symbols[c] = n
                n += 1
        self.n = n
        self.char = np.full(0x110000, NO_PIECE, dtype=np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.char[ord(c)] = i
        rank = {c: i for i, c in enumerate(sorted(set(cost.values())))}
        rows = [(symbols[s[:i]] * n + symbols[s[i:]], rank[cost[s]], p) for s, p in ids.items() for i in range(1, len(s)) if s[:i] in symbols and s[i:] in symbols]
        code, soon, piece = np.array(rows, dtype=np.int64).reshape(-1, 3).T
        self.bits = max(8, int(len(rows) * 8).bit_length())
        self.key, self.soon, self.piece = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER, np.int32), np.full(1 << self.bits, NO_PIECE, np.int32)
        rest, at = np.arange(len(rows)), self._slot(code)
        while len(rest):  # one of those that want a free place takes it, the others go on
            free = self.key[at] == -1
            self.key[at[free]] = code[rest[free]]
            done = self.key[at] == code[rest]
            self.soon[at[done]], self.piece[at[done]] = soon[rest[done]], piece[rest[done]]
            rest, at = rest[~done], (at[~done] + 1) & (len(self.key) - 1)

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs in the table; that of an absent pair holds NEVER."""
        code = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.n + right, -2)
        at = self._slot(code)
        while True:
            more = np.flatnonzero((self.key[at] != code) & (self.key[at] != -1))
            if not len(more):
                return at
            at[more] = (at[more] + 1) & (len(self.key) - 1)

    def merge(self, chars: np.ndarray) -> np.ndarray:
        """The symbols of words of one length (a row of code points each); what merging frees is GONE."""
        out = self.char[chars]
        soon = self.soon[self.find(out[:, :-1].ravel(), out[:, 1:].ravel())].reshape(len(out), -1)
        rows, col = np.arange(len(out)), np.arange(out.shape[1])
        while soon.shape[1]:
            best = soon.argmin(axis=1)
            go = np.flatnonzero(soon[np.arange(len(rows)), best] != NEVER)
            if not len(go):
                break
            rows, soon, best = rows[go], soon[go], best[go]
            sym, all_ = out[rows], np.arange(len(go))
            sym[all_, best] = self.piece[self.find(sym[all_, best], sym[all_, best + 1])]
            sym = np.c_[sym, np.full(len(go), GONE, np.int32)][all_[:, None], col + (col > best[:, None])]
            soon = np.c_[soon, np.full(len(go), NEVER, np.int32)][all_[:, None], col[:-1] + (col[:-1] >= best[:, None])]
            left = np.flatnonzero(best > 0)
            soon[left, best[left] - 1] = self.soon[self.find(sym[left, best[left] - 1], sym[left, best[left]])]
            soon[all_, np.minimum(best, soon.shape[1] - 1)] = self.soon[self.find(sym[all_, best], sym[all_, np.minimum(best + 1, len(col) - 1)])]
            out[rows] = sym
        return out


class Pieces:
    """A SentencePiece BPE model read from its file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = f.read()
        self.ids, self.cost, self.byte, self.kind, self.strings = {}, {}, {}, [], []
        norm, trainer = {}, {}
        for field, v in _fields(model):
            if field == 1:
                p = dict(_fields(v))
                s, i, k = p[1].decode(), len(self.strings), p.get(3, NORMAL)
                self.strings.append(s)
                self.kind.append(k)
                if k in (NORMAL, USER, UNUSED):
                    self.ids[s], self.cost[s] = i, -struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0]
                elif k == BYTE:
                    self.byte[int(s[3:5], 16)] = i
            elif field == 2:
                trainer = dict(_fields(v))
            elif field == 3:
                norm = dict(_fields(v))
        if trainer.get(3, 1) != 2:
            raise ValueError("only BPE models are supported")
        if USER in self.kind or UNUSED in self.kind:
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.map = CharMap(norm.get(2, b""))
        self.prefix, self.squeeze, self.escape = bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        self.free = not any(MARK in s.lstrip(MARK) for s in self.ids)
        self.plain = not self.map.units and not self.squeeze and self.escape and self.prefix
        self.unk = self.kind.index(UNKNOWN)
        self.end = self.strings.index(trainer.get(47, b"</s>").decode())
        self.pairs = Pairs(self.ids, self.cost, len(self.strings))
        self.cache: dict[str, tuple] = {}
        self.byte_of = {i: x for x, i in self.byte.items()}
        self.size = np.array([-1 if k == BYTE else len(x.encode()) for k, x in zip(self.kind, self.strings, strict=True)])
        unknown = trainer.get(44, " \u2047 ".encode()).decode()
        self.surface = [None if k == BYTE else "" if k == CONTROL else unknown if k == UNKNOWN else s.replace(MARK, " ") for k, s in zip(self.kind, self.strings, strict=True)]

    # Normalisation ---------------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the source byte where it begins."""
        b = text.encode()
        if not b:
            return "", np.zeros(1, dtype=np.int32)
        if self.plain:
            src = np.frombuffer(b, dtype=np.uint8)
            at = np.repeat(np.arange(len(b), dtype=np.int32), np.where(src == 32, 3, 1))
            return MARK + text.replace(" ", MARK), np.concatenate([np.zeros(3, np.int32), at, np.full(1, len(b), np.int32)])
        out, at, i = bytearray(), [], 0
        space = MARK.encode() if self.escape else b" "

        def step(i: int) -> tuple[bytes, int]:
            rep, n = self.map.longest(b, i)
            if n:
                return rep, n
            n = 1 if b[i] < 0x80 else 2 if b[i] < 0xE0 else 3 if b[i] < 0xF0 else 4
            return b[i : i + n], n

        while self.squeeze and i < len(b):
            rep, n = step(i)
            if rep != b" ":
                break
            i += n
        if i == len(b):
            return "", np.zeros(1, dtype=np.int32)
        if self.prefix:
            out += space
            at += [i] * len(space)
        after_space = self.squeeze
        while i < len(b):
            rep, n = step(i)
            while after_space and rep.startswith(b" "):
                rep = rep[1:]
            for k in range(len(rep)):
                x = space if rep[k] == 32 else rep[k : k + 1]
                out += x
                at += [i] * len(x)
            if rep:
                after_space = self.squeeze and rep.endswith(b" ")
            i += n
        while self.squeeze and out.endswith(space):
            del out[-len(space) :]
            i = at[len(out)]
            del at[len(out) :]
        return out.decode(), np.asarray([*at, i], dtype=np.int32)

    # Segmentation ----------------------------------------------------------------------------------

    def merge(self, chunk: str) -> list[str]:
        """The BPE pieces of a chunk: always the best-scored adjacent pair first, the leftmost of equals."""
        sym: list[str] = list(chunk)
        prev, nxt = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1]
        heap: list[tuple] = []

        def push(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := self.cost.get(sym[i] + sym[j])) is not None:
                heapq.heappush(heap, (s, i, j, sym[i], sym[j]))

        for i in range(len(sym) - 1):
            push(i, i + 1)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if sym[i] != a or sym[j] != b or nxt[i] != j:
                continue
            sym[i], sym[j] = a + b, ""
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            push(prev[i], i)
            push(i, nxt[i])
        return [s for s in sym if s]

    def _char(self, ch: str) -> list[int]:
        """A character that no piece covers: its byte pieces, or minus its bytes where the model has none."""
        raw = ch.encode()
        return [self.byte[x] for x in raw] if self.byte else [-len(raw)]

    def _merged(self, chunk: str) -> tuple[int, ...]:
        return tuple(itertools.chain.from_iterable([[self.ids[s]] if s in self.ids else self._char(s) for s in self.merge(chunk)]))

    def _merged_all(self, chunks: list[str]) -> dict[str, tuple[int, ...]]:
        """_merged() of many chunks: the short ones of a length are merged side by side, a step at a time."""
        found, by_size = {}, {}
        for c in chunks:
            by_size.setdefault(len(c), []).append(c)
        for size, group in by_size.items():
            if size > SHORT or len(group) < 8:
                found.update(zip(group, map(self._merged, group), strict=True))
                continue
            for k in range(0, len(group), ABREAST):
                some = group[k : k + ABREAST]
                sym = self.pairs.merge(np.frombuffer("".join(some).encode("utf-32-le"), dtype="<u4").reshape(-1, size))
                whole = ((sym < len(self.strings)) & (sym != NO_PIECE)).all(axis=1).tolist()
                flat, stop = sym[sym != GONE].tolist(), np.cumsum((sym != GONE).sum(axis=1)).tolist()
                for c, fine, i, j in zip(some, whole, [0, *stop], stop, strict=False):
                    ids = flat[i:j]
                    if not fine:
                        at, out = 0, []
                        for x in ids:
                            if 0 <= x < len(self.strings):
                                out.append(x)
                                at += len(self.strings[x])
                            else:
                                out += self._char(c[at])
                                at += 1
                        ids = out
                    found[c] = tuple(ids)
        return found

    def segment_all(self, normals: list[str]) -> list[list[tuple[int, ...]]]:
        """For each normalised text the ids of its chunks (minus its bytes for an unknown character)."""
        if not self.free:
            return [[self._merged(n)] if n else [] for n in normals]
        cache = self.cache
        if len(cache) > CACHE_CHUNKS:  # those that came first are the frequent ones
            self.cache = cache = dict(itertools.islice(cache.items(), CACHE_CHUNKS // 4))
        split = [CHUNKS.findall(n) for n in normals]
        out = [list(map(cache.get, chunks)) for chunks in split]
        missing = [[i for i, got in enumerate(row) if got is None] for row in out]
        found = self._merged_all(list(dict.fromkeys([c for chunks, places in zip(split, missing, strict=True) for c in map(chunks.__getitem__, places)])))
        cache.update([(c, x) for c, x in found.items() if len(c) <= CACHE_CHARS])
        for row, chunks, places in zip(out, split, missing, strict=True):
            for i in places:
                row[i] = found[chunks[i]]
        return out

    def spans(self, ids: list[int], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last source byte of each of the ids, and of the end id."""
        a = np.asarray(ids, dtype=np.int64)
        sizes = np.where(a < 0, -a, self.size[a])
        for k in np.flatnonzero(sizes < 0):  # of a character's byte pieces the last one takes all of it
            if sizes[k] < 0:
                x = self.byte_of[ids[k]]
                n = 1 if x < 0x80 else 2 if x < 0xE0 else 3 if x < 0xF0 else 4
                sizes[k : k + n] = [0] * (n - 1) + [n]
        stop, last = np.cumsum(sizes), at[-1:]
        return np.concatenate([at[stop - sizes], last]), np.concatenate([at[stop], last])

    def encode_all(self, texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """For each text its ids with the end id, and the first and past-the-last source byte of each piece."""
        at = 0
        while at < len(texts):
            end, n = at, 0
            while end < len(texts) and (end == at or n + len(texts[end]) <= TOGETHER):
                n += len(texts[end])
                end += 1
            normal = [self.normalise(t) for t in texts[at:end]]
            for (_, source), parts in zip(normal, self.segment_all([n for n, _ in normal]), strict=True):
                ids = list(itertools.chain.from_iterable(parts))
                starts, ends = self.spans(ids, source)
                if not self.byte:
                    ids = [x if x >= 0 else self.unk for x in ids]
                yield [*ids, self.end], starts, ends
            at = end

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        return next(self.encode_all([text]))

    # Decoding --------------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; control pieces have none."""
        head = 0  # a dummy prefix (or, if spaces are squeezed, all leading ones) goes
        while head < len(ids) and self.kind[ids[head]] == CONTROL:
            head += 1
        text: list[str | None] = []
        if (self.prefix or self.squeeze) and self.escape:
            while head < len(ids) and self.kind[ids[head]] == NORMAL and self.surface[ids[head]].startswith(" "):
                s = self.surface[ids[head]]
                text = [s.lstrip(" ") if self.squeeze else s[1:]]
                head += 1
                if not self.squeeze or text[0]:
                    break
        text += map(self.surface.__getitem__, itertools.islice(ids, head, None))
        try:
            return "".join(text)
        except TypeError:  # byte pieces have no surface of their own
            skipped = len(ids) - len(text)
            i = 0
            while i < len(text):
                j = i
                while j < len(text) and text[j] is None:
                    j += 1
                if j > i:
                    text[i:j] = [_utf8(bytes([self.byte_of[x] for x in ids[i + skipped : j + skipped]])), *[""] * (j - i - 1)]
                i = j + 1
            return "".join(text)


def _utf8(b: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that begins no whole character."""
    try:
        return b.decode()
    except UnicodeDecodeError:
        out, i = "", 0
        while i < len(b):
            n = 1 if b[i] < 0x80 else 2 if b[i] < 0xE0 else 3 if b[i] < 0xF0 else 4
            try:
                out += b[i : i + n].decode()
            except UnicodeDecodeError:
                out, n = out + "\ufffd", 1
            i += n
        return out


_models: dict[str, Pieces] = {}


def _model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, starts, ends): the ids of each text, and the source byte span of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model)
        for b in batches:
            rows = list(m.encode_all([t or "" for t in b.column(1).to_pylist()]))
            cols = [pa.array([r[k] for r in rows], type=pa.list_(pa.int32())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "ids", "starts", "ends"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, ids array<int>, starts array<int>, ends array<int>"
    )


def decode(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model)
        for b in batches:
            text = pa.array([m.decode(x or []) for x in b.column(1).to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), text], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """The round trip of each text in one pass: counts and digests of its ids, decoded text and spans.

    The same Pieces does the work as in encode() and decode(); only the ids and spans themselves are
    not kept. spans_sha256 is of the starts, then the ends, as little-endian 32-bit numbers.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model)
        for b in batches:
            n, a, d, s = [], [], [], []
            for ids, starts, ends in m.encode_all([t or "" for t in b.column(1).to_pylist()]):
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                d.append(hashlib.sha256(m.decode(ids).encode()).hexdigest())
                s.append(hashlib.sha256(np.concatenate([starts, ends]).astype("<i4").tobytes()).hexdigest())
            cols = [b.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in (a, d, s))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    shape = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, shape)
