"""Packed postings: which ids share a 64-bit key, found by sorting within buckets of keys.

Tasks pack (key, id) entries by bucket, so that an entry takes KEY_BYTES + 8 bytes in the shuffle. There are own
entries, which meet each other, and probing ones, which meet own ones alone. The low KEY_BYTES of a key tell keys of a
bucket apart: what meets by chance is a candidate that does not verify. A key of at most ``hot`` ids makes all pairs
of them. A hotter key lists its members, each with the key's smallest own id (a star), for a second search among those
that the stars left apart (apart()). Entries may have marks of 4 bytes, by which pairs are denied before they are made.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Entries that a task holds, entries of a bucket, and bytes of payload in a block.
HELD, BUCKET, BYTES = 1 << 18, 1 << 18, 1 << 24
#: Ids of a hot key whose pairs of marks are tried at once.
TRIED = 1024
KEY_BYTES = 5
OWN, PROBE = 0, 1
#: Keys, ids, and marks or no third.
Entries = tuple[np.ndarray, ...]
May = Callable[[np.ndarray, np.ndarray], np.ndarray]


def buckets_for(entries: int) -> int:
    return min(max(64, entries // BUCKET), 1 << 22)


def _rows(side: int, buckets: int, key: np.ndarray, ids: np.ndarray, marks: np.ndarray | None = None) -> pa.RecordBatch:
    key = key.astype(np.uint64)
    bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    which, first = np.unique(bucket[order], return_index=True)
    raw = np.ascontiguousarray(key[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])
    ids = ids[order].astype("<i8")
    marks = np.zeros((len(order), 0)) if marks is None else marks[order].astype("<u4")
    spans = list(itertools.pairwise([*first.tolist(), len(order)])) if len(order) else []
    cols = [pa.array(which, pa.int32()), pa.array(np.full(len(which), side), pa.int8())]
    cols += [pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for x in (raw, ids, marks)]
    return pa.RecordBatch.from_arrays(cols, names=["bucket", "side", "keys", "ids", "marks"])


def packed(rows: DataFrame, entries: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[Entries, Entries]]], buckets: int) -> DataFrame:
    """(bucket, side, keys, ids, marks) of what ``entries`` makes of the rows: pairs of own and probing entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[Entries, Entries]] = []
        for some in itertools.chain(entries(batches), [None]):
            if some is not None:
                held.append(some)
            if held and (some is None or sum(len(side[0]) for both in held for side in both) > HELD):
                for side in (OWN, PROBE):
                    yield _rows(side, buckets, *(np.concatenate(x) for x in zip(*(both[side] for both in held), strict=True)))
                held = []

    return rows.mapInArrow(run, "bucket int, side byte, keys binary, ids binary, marks binary")


def _distinct(key: np.ndarray, ids: np.ndarray, marks: np.ndarray | None = None) -> Entries:
    """Each (key, id) once, in order, with its smallest mark."""
    marks = np.zeros(len(key), np.uint32) if marks is None else marks
    order = np.lexsort((marks, ids, key))
    key, ids, marks = key[order], ids[order], marks[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])] if len(key) else np.zeros(0, bool)
    return key[new], ids[new], marks[new]


def matched(own: Entries, probe: Entries, bucket: int, hot: int, may: May | None = None) -> list[np.ndarray]:
    """[role, key, a, b] of a bucket: pairs of ids (role 0), and members b of hot keys (1 own, 2 probing) with the smallest own id as a.

    ``may`` says which pairs of marks go on. A hot key of at most TRIED ids whose pairs it makes no more than ids is not
    hot, and else lists those that have a pair. A member that it denies the star has itself as a.
    """
    k, a, mark = _distinct(*own)
    at = np.searchsorted(k, probe[0]) if len(k) else np.zeros(len(probe[0]), np.int64)
    hit = k[np.minimum(at, len(k) - 1)] == probe[0] if len(k) else np.zeros(len(probe[0]), bool)
    pk, other_ids, other_mark = _distinct(*(x[hit] for x in probe))
    new = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    count = np.diff(np.r_[new, len(k)])
    low, high = np.searchsorted(pk, k[new], "left"), np.searchsorted(pk, k[new], "right")
    left, right, centre, member, name, role = [], [], [], [], [], []
    for g in np.flatnonzero((count > 1) | (high > low)).tolist():
        m, n = count[g], high[g] - low[g]
        every = np.r_[a[new[g] : new[g] + m], other_ids[low[g] : high[g]]]
        marks = np.r_[mark[new[g] : new[g] + m], other_mark[low[g] : high[g]]]
        kind, few = np.repeat(np.array([1, 2], np.int8), [m, n]), m + n <= hot
        if few or may and m + n <= TRIED:
            i, j = np.triu_indices(m + n, 1)
            fine = (i < m) & may(marks[i], marks[j]) if may else i < m
            i, j = i[fine], j[fine]
            if few or len(i) <= m + n:
                left.append(every[i])
                right.append(every[j])
                continue
            some = np.unique(np.r_[i, j])  # the first is an own one
            every, marks, kind = every[some], marks[some], kind[some]
        star = may(marks[:1], marks) if may else np.ones(len(every), bool)
        centre.append(np.where(star, every[0], every))
        member.append(every)
        name.append(np.full(len(every), int(k[new[g]]) | bucket << 8 * KEY_BYTES))
        role.append(kind)
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
    x, y = np.minimum(x, y), np.maximum(x, y)
    x, y, _ = _distinct(x[x != y], y[x != y])
    c, m, n, r = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (centre, member, name, role))
    return [np.r_[np.zeros(len(x), np.int8), r.astype(np.int8)], np.r_[np.zeros(len(x), np.int64), n], np.r_[x, c], np.r_[y, m]]


def pairs(found: DataFrame) -> DataFrame:
    """(a, b), a < b, each once: the pairs of candidates() and the stars of its hot keys."""
    return found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def candidates(entries: DataFrame, hot: int, may: May | None = None) -> DataFrame:
    """(role, key, a, b) of all buckets of packed entries, see matched()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(bucket: int, rows: list[tuple[int, bytes, bytes, bytes]]) -> pa.RecordBatch:
            sides = []
            for side in (OWN, PROBE):
                k, i, m = (b"".join([x[c] for x in rows if x[0] == side]) for c in (1, 2, 3))
                raw = np.frombuffer(k, dtype=np.uint8).reshape(-1, KEY_BYTES)
                key = np.zeros((len(raw), 8), dtype=np.uint8)
                key[:, :KEY_BYTES] = raw
                sides.append((key.view("<i8").ravel(), np.frombuffer(i, dtype="<i8"), *([np.frombuffer(m, dtype="<u4")] if may else [])))
            role, key, a, b = matched(*sides, bucket, hot, may)
            return pa.RecordBatch.from_arrays([pa.array(role, pa.int8()), pa.array(key), pa.array(a), pa.array(b)], names=["role", "key", "a", "b"])

        now, rows = None, []
        for b in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != now and rows:
                    yield found(now, rows)
                    rows = []
                now = bucket
                rows.append(tuple(row))
        if rows:
            yield found(now, rows)

    return entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "role byte, key long, a long, b long")


def apart(members: DataFrame, near: Callable[[dict[str, np.ndarray], slice], np.ndarray], same: Callable[[object, object], bool] | None, block: int, payload: DataFrame | None = None, marks: bool = False) -> DataFrame:
    """(u, v): verified links between members of a key that have different parts.

    Without ``same``, or with ``marks``, instead (u, v) = (key, num) of the members that may be near to one of another part
    (with ``marks``: as ``same`` says of sketches), so that payloads need to travel for these alone.

    members: key, num, part, role, bytes (of the payload) and other longs; payload: (num, s), which joins them when they are
    dealt out, so that it travels once. A key's members are cut into blocks of at
    most ``block`` rows and about BYTES of payload; each pair of blocks is compared in one task. There ``near`` says which of the rows of a slice
    may be near to which of all rows, and ``same`` decides on the payloads of those that nothing connects yet. Only
    links that connect leave the task, so there are fewer of them than rows.
    """
    mixed = members.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.count("*").alias("rows"), F.sum("bytes").alias("weight"))
    mixed = mixed.where("x <> y").select("key", F.ceil(F.greatest(F.col("rows") / block, F.col("weight") / BYTES)).cast("int").alias("parts"))
    rows = members.join(mixed, "key")
    parts = F.col("parts")
    own = F.pmod(F.xxhash64("num"), parts).cast("int")
    pair = F.transform(F.sequence(F.lit(0), parts - 1), lambda x: F.struct(F.least(own, x).alias("p"), F.greatest(own, x).alias("q")))
    names = ["p", "q", "o", *members.columns]
    rows = rows.withColumn("o", own).withColumn("x", F.explode(pair)).select("x.p", "x.q", "o", *members.columns)
    rows = rows.withColumn("s", F.lit(None).cast("binary")) if payload is None else rows.join(payload, "num").select(*names, "s")
    group = [names.index(c) for c in ("key", "p", "q")]

    def found(g: np.ndarray, payload: list) -> tuple[list[int], list[int]]:
        c = dict(zip(names, g, strict=True))
        num, root = c["num"], list(range(g.shape[1]))
        first: dict[int, int] = {}
        for k, x in enumerate(c["part"].tolist()):
            root[k] = first.setdefault(x, k)

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        left, right, has = [], [], np.zeros(len(num), dtype=bool)
        for i in range(0, len(num), 256):
            x = slice(i, i + 256)
            fine = (c["part"][x, None] != c["part"]) & (num[x, None] < num) & ((c["role"][x, None] == 1) | (c["role"] == 1))
            fine &= (c["o"][x, None] != c["o"]) | (c["p"] == c["q"])  # of two blocks pairs across, of one block all
            fine &= near(c, x)
            if same is None:
                has[x] |= fine.any(axis=1)
                has |= fine.any(axis=0)
                continue
            a, b = np.nonzero(fine)
            for m, n in zip((a + i).tolist(), b.tolist(), strict=True):
                if marks:
                    if not (has[m] and has[n]) and same(payload[m], payload[n]):
                        has[m] = has[n] = True
                    continue
                y, z = top(m), top(n)
                if y != z and same(payload[m], payload[n]):
                    root[max(y, z)] = min(y, z)
                    left.append(int(num[m]))
                    right.append(int(num[n]))
        return (left, right) if same and not marks else (c["key"][has].tolist(), num[has].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, payload = np.zeros((len(names), 0), np.int64), []
        for b in itertools.chain(batches, [None]):
            if b is not None:
                g = np.concatenate([g, np.array([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns[:-1]])], axis=1)
                payload += b.column(len(names)).to_pylist()
            if not g.shape[1]:
                continue
            edge = [*np.flatnonzero(np.r_[True, (g[group][:, 1:] != g[group][:, :-1]).any(axis=0)]).tolist(), g.shape[1]]
            done = edge if b is None else edge[:-1]  # the last group may go on in the next batch
            links = [found(g[:, i:j], payload[i:j]) for i, j in itertools.pairwise(done)]
            g, payload = g[:, done[-1] :], payload[done[-1] :]
            yield pa.RecordBatch.from_arrays([pa.array([v for x in links for v in x[k]], pa.int64()) for k in range(2)], names=["u", "v"])

    return rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(run, "u long, v long").distinct()
