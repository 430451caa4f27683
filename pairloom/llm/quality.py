"""Quality classifier: naive Bayes support vectors over n-gram indicators.

A text's features are indicators of n-grams over the whole text, hashed into 2**BITS places: of its words (1
and 2), of which words equal the one before (1 to 3 signs), of its bytes (1 to 3) and of its shape (3 to 5; letters, capitals and digits stand for their kind, runs
of small letters for one letter). Each indicator is scaled by its class log-count ratio, r = log((p / |p|) / (q / |q|)) with
add-alpha counts over the training rows, and the vector is brought to unit length in the indicators. A
linear model with hinge loss is then fitted by dual coordinate descent. A logistic curve, fitted on a
third of the training rows that a first fit did not see, turns margins into scores from 0 to 1.

Training reads at most SAMPLE labelled rows (those with the smallest hashes of their doc_id), as
indices of features; scoring covers every row. Labels, lang, source and doc_id are never inputs.

Nulls: a null text is an empty one and gets the score of no feature at all; a null doc_id is scored and
is not held out; null labels and contradicting labels of a doc_id do not train. Repeated rows come back
repeated and train once; equal texts get equal scores. A very long text has more indicators and is brought to the same
length. Other columns are kept by accepted() and are otherwise not read. Empty tables give empty results; without labels of both classes every score is the share of
good labels (1 without any label).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import WordHashes, columns, staged, unused

SAMPLE = 4000
BITS = 20
WORDS, REPEATS, BYTES, SHAPES = (1, 2), (1, 2, 3), (1, 2, 3), (3, 4, 5)
THRESHOLD = 0.7
_MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917), np.uint32(668265263), np.uint32(374761393))


_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[128:], _KIND[48:58] = 97, 65, 97, 48


class Indicators:
    """The distinct hashed n-grams of a text, found without sorting them."""

    def __init__(self, bits: int = BITS):
        self.bits = bits
        self.stamp = np.zeros(1 << bits, dtype=np.int32)
        self.words = WordHashes()

    def _grams(self, a: np.ndarray, orders: tuple[int, ...], salt: int) -> Iterator[np.ndarray]:
        a = a.astype(np.uint32)
        for n in orders:
            if len(a) >= n:
                h = np.full(len(a) - n + 1, n + salt, dtype=np.uint32)
                for k in range(n):
                    h ^= a[k : len(a) - n + 1 + k]
                    h *= _MULTIPLIERS[k]
                    h ^= h >> np.uint32(15)
                yield (h * _MULTIPLIERS[-1]) >> np.uint32(32 - self.bits)

    def __call__(self, raw: bytes) -> np.ndarray:
        a = np.frombuffer(raw, dtype=np.uint8)
        kind = _KIND[a]
        if len(kind):
            kind = kind[np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] != 97)]]
        own = (self.words(a) >> np.uint64(32)).astype(np.uint32)
        parts = [*self._grams(own, WORDS, 200), *self._grams(own[1:] == own[:-1], REPEATS, 300), *self._grams(a, BYTES, 0), *self._grams(kind, SHAPES, 100)]
        if not parts:
            return np.zeros(0, dtype=np.uint32)
        h = np.concatenate(parts)
        order = np.arange(len(h), dtype=np.int32)
        self.stamp[h] = order
        return h[self.stamp[h] == order]


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + shift))), margin = sum(weights at indicators) / sqrt(number) + bias."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, index: np.ndarray) -> float:
        return float(self.weights[index].sum() / np.sqrt(max(1, len(index)))) + self.bias

    def score(self, index: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(index) + self.shift, -500, 500))))


def _hinge(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, c: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the squared-norm, hinge-loss problem; the bias is one more feature."""
    w, bias = np.zeros_like(r), 0.0
    alpha = np.zeros(len(rows))
    at = lambda i: r[rows[i]] / np.sqrt(max(1, len(rows[i])))  # noqa: E731  scaled anew each time: the rows alone are kept
    norm = np.array([float(x @ x) + 1.0 for x in map(at, range(len(rows)))])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x = at(i)
            g = y[i] * (float(w[rows[i]] @ x) + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), c)
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * x
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4 * c:
            break
    return w * r, bias


def _platt(m: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift of a logistic curve, with the usual softened targets, by damped Newton steps."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0

    def loss(a: float, b: float) -> float:
        x = a * m + b
        return float((np.logaddexp(0, x) - t * x).sum() + 0.5e-3 * a * a)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -500, 500)))
        d, h = p - t, p * (1 - p) + 1e-9
        ga, gb = d @ m + 1e-3 * a, d.sum()
        haa, hab, hbb = (h * m) @ m + 1e-3, h @ m, h.sum()
        det = haa * hbb - hab * hab + 1e-12
        sa, sb = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step, now = 1.0, loss(a, b)
        while step > 1e-6 and loss(a - step * sa, b - step * sb) > now:
            step /= 2
        a, b = a - step * sa, b - step * sb
        if step <= 1e-6 or abs(sa) + abs(sb) < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, alpha: float = 1.0, c: float = 1.0, epochs: int = 30, seed: int = 7) -> Model:
    """Fits the model to rows of indicator indices and labels 0 or 1."""
    y = np.where(np.asarray(labels) > 0, 1, -1)
    size = 1 << bits
    if len(set(y.tolist())) < 2:
        p = float(np.clip((y > 0).mean() if len(y) else 1.0, 1e-6, 1 - 1e-6))
        return Model(np.zeros(size, dtype=np.float32), 0.0, 0.0, float(np.log(p / (1 - p))))

    def one(use: np.ndarray) -> tuple[np.ndarray, float]:
        p, q = np.full(size, alpha), np.full(size, alpha)
        for i in use:
            (p if y[i] > 0 else q)[rows[i]] += 1
        r = np.log(p / p.sum()) - np.log(q / q.sum())
        return _hinge([rows[i] for i in use], y[use], r, c, epochs, seed)

    part = np.arange(len(rows)) % 3
    if min((y[part != 0] > 0).sum(), (y[part != 0] < 0).sum(), (y[part == 0] > 0).sum(), (y[part == 0] < 0).sum()):
        w, bias = one(np.flatnonzero(part != 0))
        first = Model(w, bias, 1.0, 0.0)
        seen = np.flatnonzero(part == 0)
    else:
        first, seen = None, np.arange(len(rows))
    w, bias = one(np.arange(len(rows)))
    model = Model(w, bias, 1.0, 0.0)
    m = np.array([(first or model).margin(rows[i]) for i in seen])
    a, b = _platt(m, y[seen])
    return Model(w.astype(np.float32), bias, a, b)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def training_ids(labels: DataFrame, label: str, parts: int, part: int, sample: int) -> DataFrame:
    """(doc_id, label) of at most ``sample`` rows that are not held out, by the hash of their doc_id."""
    rows = labels.where(f"doc_id is not null and {label} is not null").where(~held_out(F.col("doc_id"), parts, part))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("label"), F.max(label).alias("_most"))
    rows = rows.where("label = _most").select("doc_id", F.col("label").cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def labelled(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, sample: int) -> DataFrame:
    """(doc_id, label, text): at most ``sample`` different labelled texts that are not held out, each once; staged."""
    ids = training_ids(labels, label, parts, part, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(ids), "doc_id").withColumn("h", F.xxhash64("text", "doc_id"))  # ids: ``sample`` rows at most
    rows = staged(rows.dropDuplicates(["doc_id", "h"]), "labelled")
    keys = rows.select("doc_id", "h").orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(sample)
    rows = rows.join(F.broadcast(keys), ["doc_id", "h"]).select("doc_id", "label", "text")
    return staged(rows.repartition(16), "labelled-sample")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, part: int = 2, sample: int = SAMPLE) -> Model:
    """Collects the sample's feature indices (its bound is ``sample`` rows of at most 2**BITS each) and fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Indicators()
        for b in batches:
            x = [np.sort(find(t or b"")).astype("<u4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary())], names=["label", "x"])

    rows = labelled(docs, labels, label, parts, part, sample).select("label", F.col("text").cast("binary").alias("t"))
    got = rows.mapInArrow(run, "label int, x binary").distinct().toArrow()
    order = sorted(zip(got.column(1).to_pylist(), got.column(0).to_pylist(), strict=True))
    del got
    return fit([np.frombuffer(x, dtype="<i4") for x, _ in order], np.array([y for _, y in order]))


def score(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """Adds a last column, the score, to doc_id or, with keep, to all columns of docs; every whole text is scored."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # 2**BITS floats, whatever the data
    rows = docs if keep else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    at = [c.lower() for c in rows.columns].index("text")
    out = rows if keep else rows.drop("text")
    [name] = unused(out, "score")
    names = [*out.columns, name]
    shape = StructType([*out.schema.fields]).add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, find = sent.value, Indicators()
        for b in batches:
            s = pa.array([m.score(find((t or "").encode("utf-8", "surrogatepass"))) for t in b.column(at).to_pylist()], pa.float64())
            cols = [c for i, c in enumerate(b.columns) if keep or i != at]
            yield pa.RecordBatch.from_arrays([*cols, s], names=names)

    return rows.mapInArrow(run, shape)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    rows = score(docs, train(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of at least threshold, with all their columns."""
    rows = score(docs, train(docs, labels), keep=True)
    return rows.where(F.col(rows.columns[-1]) >= threshold).select(*columns(docs))
