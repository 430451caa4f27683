"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as its own embedding (for the VOCABULARY words whose document frequencies differ most
between the classes; one more row stands for all others) beside the mean embedding of its hashed character
trigrams and beginnings. Two gated recurrent layers read a window of WINDOW words from both ends, attention weighs the
positions, and a linear layer gives the window's logit. A text is scored through all its overlapping windows (one begins at
every STRIDE-th word, and the last one reaches the last word); its score is the largest logit, put through a logistic curve
fitted on training texts that a first fit did not see.

Labels belong to whole texts, so training picks windows: every labelled text of the sample trains with at least one
and at most PICKED of its windows. Of a toxic text these are the ones with the strongest words by the class statistics, and
after a first fit the one that the network ranks highest; of a clean text one that a hash picks and the one with the strongest
words, and after the first fit also the one that the network ranks highest. The sample has at most SAMPLE different
labelled texts (smallest hashes of doc_id, then text). Word statistics, windows and logits are found in the tasks: only
VOCABULARY words, SAMPLE * PICKED windows and SAMPLE logits come to the driver. Scoring covers every row. Labels, lang,
source and doc_id are never inputs.

Nulls: a null text is an empty one, scored as one empty window; a null doc_id is scored and is not held
out; null labels and contradicting labels of a doc_id do not train. Repeated rows come back repeated and train once. Words
of over LONG characters count as several, so a very long text without spaces has windows too. Other columns are not read. Empty tables
give empty results; without labels of both classes every score is the share of toxic labels (0 without any).
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .quality import _platt, held_out, labelled

SAMPLE, THRESHOLD = 6000, 0.5
PICKED, LONG, FOLDS, EPOCHS = 4, 64, 3, 8
WINDOW, STRIDE = 24, 12
HIDDEN, WORD_DIM, CHAR_DIM, ATTEND = 8, 8, 8, 8
VOCABULARY, GRAMS = 2048, 8192
CACHE_WORDS = 200_000
BATCH = 4096
STEPS = 400


def words(text: str) -> list[str]:
    """Lower-case words; each LONG characters of a longer one are a word."""
    out = text.lower().split()
    if max(map(len, out), default=0) > LONG:
        out = [w[k : k + LONG] for w in out for k in range(0, len(w), LONG)]
    return out


def letters(token: str) -> str:
    """A token without what isn't a letter."""
    return token if token.isalpha() else "".join([c for c in token if c.isalpha()])


def grams(own: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words' character trigrams and of their beginnings of 4 to 8 characters, word after word, and where each word's begin."""
    size = np.array([max(1, len(w)) for w in own], dtype=np.int64)
    text = "".join([f"<{w or ' '}>" for w in own])
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    more = np.clip(size - 3, 0, 5)
    start = np.cumsum(np.r_[0, size + more])
    out = np.zeros(start[-1], dtype=np.int64)
    word = np.repeat(np.arange(len(own)), size)
    nth = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    at = nth + (np.cumsum(size + 2) - size - 2)[word]
    out[start[word] + nth] = _hashed((c[at] * _MIX[0] ^ c[at + 1]) * _MIX[1] ^ c[at + 2])
    first = np.cumsum(size + 2) - size - 1
    h = np.full(len(own), 94, dtype=np.uint64)
    for n in range(8):
        use = np.flatnonzero(size > n)
        h[use] = (h[use] ^ c[first[use] + n]) * _MIX[2]
        h[use] ^= h[use] >> np.uint64(29)
        if n >= 3:
            out[start[use] + size[use] + n - 3] = _hashed(h[use])
    return out, start[:-1]


_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


def _hashed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _MIX[1]
    return ((x ^ x >> np.uint64(27)) * _MIX[2] >> np.uint64(40)).astype(np.int64) % GRAMS


def windows(n: int, stride: int = STRIDE) -> np.ndarray:
    """First words of all windows over n words; the last one reaches the last word."""
    return np.arange(max(1, -(-(n - WINDOW) // stride) + 1 if n > WINDOW else 1)) * stride


def _add_rows(to: np.ndarray, index: np.ndarray, rows: np.ndarray) -> None:
    """Adds rows to the places of ``to`` that index names, repeats included."""
    order = np.argsort(index, kind="stable")
    at = index[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    to[at[first]] += np.add.reduceat(rows[order], first, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """The parameters, a forward pass, and its gradients."""

    def __init__(self, vocabulary: dict[str, float], seed: int = 1):
        r = np.random.default_rng(seed)
        h, d = HIDDEN, WORD_DIM + CHAR_DIM
        some = lambda *s: (r.standard_normal(s) * 0.3 / np.sqrt(max(1, s[0]))).astype(np.float32)
        self.vocabulary = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.p = {"word": (r.standard_normal((len(vocabulary) + 1, WORD_DIM)) * 0.05).astype(np.float32), "char": (r.standard_normal((GRAMS, CHAR_DIM)) * 0.05).astype(np.float32)}
        if vocabulary:  # a word's own evidence is where its embedding starts
            self.p["word"][1:, 0] = np.clip(np.array(list(vocabulary.values())) / 10, -2, 2)
        for k in "fb":
            self.p |= {f"W{k}": some(d, 3 * h), f"U{k}": some(h, 3 * h), f"b{k}": np.zeros(3 * h, np.float32)}
        self.p |= {"A": some(2 * h, ATTEND), "a": np.zeros(ATTEND, np.float32), "v": some(ATTEND), "w": some(2 * h), "c": np.zeros(1, np.float32)}
        self.slope, self.shift = 1.0, 0.0

    def embed(self, own: list[str]) -> np.ndarray:
        """The input vectors of words (letters alone): word embedding, then the mean of the character embeddings."""
        if not own:
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        every, start = grams(own)
        c = np.add.reduceat(self.p["char"][every], start, axis=0) / np.diff(np.r_[start, len(every)])[:, None]
        return np.c_[self.p["word"][[self.vocabulary.get(w, 0) for w in own]], c].astype(np.float32)

    def _layer(self, gx: np.ndarray, mask: np.ndarray, k: str, keep: list | None) -> np.ndarray:
        """States of one direction. gx: batch x window x 3h input gates; keep collects what gradients need."""
        p, h = self.p, HIDDEN
        state, out = np.zeros((len(gx), h), np.float32), np.zeros((gx.shape[1], len(gx), h), np.float32).transpose(1, 0, 2)
        order = range(gx.shape[1]) if k == "f" else range(gx.shape[1] - 1, -1, -1)
        for t in order:
            u, g, m = state @ p[f"U{k}"], gx[:, t], mask[:, t, None]
            zr = _sigmoid(g[:, : 2 * h] + u[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(g[:, 2 * h :] + r * u[:, 2 * h :])
            new = n + z * (state - n)
            if keep is not None:
                keep.append((t, state, z, r, n, u[:, 2 * h :]))
            state = np.where(m, new, state)
            out[:, t] = state
        return out

    def forward(self, gf: np.ndarray, gb: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows from their input gates in both directions."""
        p = self.p
        kf, kb = ([], []) if keep is not None else (None, None)
        s = np.concatenate([self._layer(gf, mask, "f", kf), self._layer(gb, mask, "b", kb)], axis=2)
        q = np.tanh(s @ p["A"] + p["a"])
        e = np.where(mask, q @ p["v"], -1e9)
        e = np.exp(e - e.max(axis=1, keepdims=True))
        e = e / e.sum(axis=1, keepdims=True)
        pooled = np.einsum("bt,bth->bh", e, s)
        if keep is not None:
            keep |= {"f": kf, "b": kb, "s": s, "q": q, "e": e, "pooled": pooled}
        return pooled @ p["w"] + p["c"][0]

    def backward(self, d: np.ndarray, x: np.ndarray, mask: np.ndarray, keep: dict) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters but the embeddings, and of the inputs x, from those of the logits."""
        p, h, g = self.p, HIDDEN, {}
        s, q, e = keep["s"], keep["q"], keep["e"]
        g["w"], g["c"] = d @ keep["pooled"], d.sum(keepdims=True)
        dp = d[:, None] * p["w"]
        de = np.einsum("bh,bth->bt", dp, s)
        de = e * (de - (e * de).sum(axis=1, keepdims=True)) * mask
        ds = e[:, :, None] * dp[:, None, :]
        g["v"] = np.einsum("bt,btk->k", de, q)
        dq = de[:, :, None] * p["v"] * (1 - q * q)
        g["A"], g["a"] = np.einsum("bth,btk->hk", s, dq), dq.sum(axis=(0, 1))
        ds = ds + dq @ p["A"].T
        dx = np.zeros_like(x)
        for k, part in (("f", ds[:, :, :h]), ("b", ds[:, :, h:])):
            dg, du_w = np.zeros((*x.shape[:2], 3 * h), np.float32), np.zeros_like(p[f"U{k}"])
            carry = np.zeros((len(x), h), np.float32)
            for t, before, z, r, n, un in reversed(keep[k]):
                m = mask[:, t, None]
                total = part[:, t] + carry
                dn = total * (1 - z) * (1 - n * n) * m
                dz = total * (before - n) * z * (1 - z) * m
                dr = dn * un * r * (1 - r)
                dg[:, t] = np.concatenate([dz, dr, dn], axis=1)
                du = np.concatenate([dz, dr, dn * r], axis=1)
                du_w += before.T @ du
                carry = np.where(m, total * z, total) + du @ p[f"U{k}"].T
            g[f"U{k}"], g[f"W{k}"], g[f"b{k}"] = du_w, np.einsum("btd,btg->dg", x, dg), dg.sum(axis=(0, 1))
            dx += dg @ p[f"W{k}"].T
        return g, dx

    def fit(self, texts: list[list[str]], y: np.ndarray, epochs: int = EPOCHS, steps: int = STEPS, rate: float = 0.01, batch: int = 128, seed: int = 2) -> None:
        """Adam on the logistic loss of windows (lists of words): so many epochs, or more until there are ``steps`` steps."""
        table = {w: i for i, w in enumerate(dict.fromkeys(itertools.chain.from_iterable(texts)))}
        own = [letters(t) for t in table]
        ids = np.array([self.vocabulary.get(w, 0) for w in own], dtype=np.int64)
        flat = np.split(*(lambda every, start: (every, start[1:]))(*grams(own)))
        x_ids = np.zeros((len(texts), WINDOW), dtype=np.int64)
        mask = np.zeros((len(texts), WINDOW), dtype=bool)
        for i, t in enumerate(texts):
            x_ids[i, : len(t)], mask[i, : len(t)] = [table[w] for w in t], True
        r = np.random.default_rng(seed)
        mean, var, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for _ in range(max(epochs, -(-steps // -(-len(texts) // batch)))):
            order = r.permutation(len(texts))
            for at in range(0, len(order), batch):
                use = order[at : at + batch]
                kinds, where = np.unique(x_ids[use], return_inverse=True)
                where, m = where.reshape(len(use), WINDOW), mask[use]
                sizes = np.array([len(flat[k]) for k in kinds])
                every, start = np.concatenate([flat[k] for k in kinds]), np.cumsum(np.r_[0, sizes[:-1]])
                emb = np.c_[self.p["word"][ids[kinds]], np.add.reduceat(self.p["char"][every], start, axis=0) / sizes[:, None]].astype(np.float32)
                x = emb[where] * m[:, :, None]
                keep: dict = {}
                logit = self.forward(x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"], m, keep)
                d = ((_sigmoid(logit) - y[use]) / len(use)).astype(np.float32)
                g, dx = self.backward(d, x, m, keep)
                de = np.zeros_like(emb)
                _add_rows(de, where.ravel(), (dx * m[:, :, None]).reshape(-1, emb.shape[1]))
                g["word"], g["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
                _add_rows(g["word"], ids[kinds], de[:, :WORD_DIM])
                _add_rows(g["char"], every, np.repeat(de[:, WORD_DIM:] / sizes[:, None], sizes, axis=0))
                step += 1
                for k, v in g.items():
                    mean[k] += 0.1 * (v - mean[k])
                    var[k] += 0.001 * (v * v - var[k])
                    self.p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


class Scorer:
    """Largest window logits of whole texts, with a bounded cache of the words' input gates."""

    def __init__(self, network: Network, stride: int = STRIDE):
        self.net, self.stride, self.ids, self.own = network, stride, {}, {}
        self.gates, self.used = np.zeros((4096, 6 * HIDDEN), np.float32), 1  # row 0 pads; grows by doubling

    def _rows(self, tokens: list[str]) -> list[int]:
        ids = self.ids
        out = list(map(ids.get, tokens))
        if None not in out:
            return out
        if len(ids) > CACHE_WORDS:
            ids.clear()
            self.own.clear()
            self.used = 1
        new = [t for t in dict.fromkeys(tokens) if t not in ids]
        plain = [letters(t) for t in new]
        fresh = [w for w in dict.fromkeys(plain) if w not in self.own]  # many tokens are the same letters
        p = self.net.p
        x = self.net.embed(fresh)
        end = self.used + len(fresh)
        if end > len(self.gates):
            self.gates = np.concatenate([self.gates, np.zeros((max(end, len(self.gates)), 6 * HIDDEN), np.float32)])
        self.gates[self.used : end] = np.c_[x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]]
        self.own.update(zip(fresh, range(self.used, end), strict=True))
        self.used = end
        ids.update(zip(new, [self.own[w] for w in plain], strict=True))
        return list(map(ids.__getitem__, tokens))

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(largest logit, first word of its window) of each text."""
        split = [words(t) for t in texts]
        best, where = np.full(len(texts), -np.inf), np.zeros(len(texts), dtype=np.int64)
        at = 0
        while at < len(split):  # enough texts for a large batch of words, at least one
            end, n = at, 0
            while end < len(split) and (end == at or n + len(split[end]) <= BATCH * self.stride):
                n += len(split[end])
                end += 1
            rows = self._rows(list(itertools.chain.from_iterable(split[at:end])))
            rows = np.array([*rows, *[0] * WINDOW], dtype=np.int64)
            base, starts, stops, text = 0, [], [], []
            for k in range(at, end):
                s = windows(len(split[k]), self.stride)
                starts.append(s + base)
                stops.append(np.minimum(s + WINDOW, len(split[k])) + base)
                text.append(np.full(len(s), k))
                base += len(split[k])
            starts, stops, text = map(np.concatenate, (starts, stops, text))
            for k in range(0, len(starts), BATCH):
                s, e, t = starts[k : k + BATCH], stops[k : k + BATCH], text[k : k + BATCH]
                place = s[:, None] + np.arange(WINDOW)
                mask = place < e[:, None]
                g = self.gates[np.where(mask, rows[np.minimum(place, len(rows) - 1)], 0).T].transpose(1, 0, 2)  # a step's gates stand together
                logit = self.net.forward(g[:, :, : 3 * HIDDEN], g[:, :, 3 * HIDDEN :], mask)
                first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])  # a text's windows stand together
                most = np.maximum.reduceat(logit, first)
                top = np.flatnonzero(logit == np.repeat(most, np.diff(np.r_[first, len(t)])))
                top = top[np.r_[True, t[top][1:] != t[top][:-1]]]
                top = top[logit[top] > best[t[top]]]
                best[t[top]], where[t[top]] = logit[top], s[top]
            offset = np.cumsum([0, *map(len, split[at:end])])[:-1]
            where[at:end] -= offset
            at = end
        return best, where

    def scores(self, texts: list[str]) -> np.ndarray:
        best, _ = self.logits(texts)
        return _sigmoid(np.clip(self.net.slope * best + self.net.shift, -500, 500))


def _tallied(sample: DataFrame) -> DataFrame:
    """(word, pos, neg): in how many toxic and other texts a word (its letters) stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: tuple[Counter, Counter] = (Counter(), Counter())
            for y, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                count[y].update({letters(w) for w in set(words(t))} - {""})
            kinds = list({**count[0], **count[1]})
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), *(pa.array([count[y][w] for w in kinds], pa.int64()) for y in (1, 0))], names=["word", "pos", "neg"])

    return sample.select("label", "text").mapInArrow(run, "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def evidence(sample: DataFrame) -> dict[str, float]:
    """z of the difference between a word's document frequencies in toxic and other texts, for the VOCABULARY most telling words."""
    size = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    p, q = max(1, size.get(1, 0)), max(1, size.get(0, 0))
    z = (F.col("pos") / p - F.col("neg") / q) / F.sqrt((F.col("pos") + F.col("neg") + 1) / (p + q) * (1 / p + 1 / q))
    return {r.word: r.z for r in _tallied(sample).select("word", z.alias("z")).orderBy(F.desc(F.abs("z")), "word").limit(VOCABULARY).collect()}


def _strongest(split: list[str], z: dict[str, float], toxic: bool) -> list[int]:
    """First words of the windows that a text trains with at first."""
    at = windows(len(split)).tolist()
    value = [z.get(letters(w), 0.0) for w in split]
    each = sorted(((-max(value[k : k + WINDOW], default=0.0), k) for k in at))
    if toxic:
        return [k for v, k in each if v <= 0.6 * each[0][0]][:PICKED] or [each[0][1]]
    return list(dict.fromkeys([each[0][1], at[zlib.crc32(" ".join(split[:WINDOW]).encode("utf-8", "surrogatepass")) % len(at)]]))


def _picked(sample: DataFrame, z: dict[str, float] | None, net: Network | None) -> list[tuple[int, list[str]]]:
    """(label, words) of training windows, by the evidence z or by a network; at most PICKED rows of WINDOW words a text."""
    sent = sample.sparkSession.sparkContext.broadcast((z, net))  # bounded by VOCABULARY and GRAMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, net = sent.value
        scorer = Scorer(net) if net else None
        for b in batches:
            labels, own = b.column(0).to_pylist(), [words(t) for t in b.column(1).to_pylist()]
            if scorer:
                best, at = scorer.logits(b.column(1).to_pylist())
                places = [[int(k)] if y or v > -2 else [] for y, v, k in zip(labels, best, at, strict=True)]
            else:
                places = [_strongest(w, z, y == 1) for y, w in zip(labels, own, strict=True)]
            rows = [(y, w[k : k + WINDOW]) for y, w, ks in zip(labels, own, places, strict=True) for k in ks]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in rows], pa.int32()), pa.array([w for _, w in rows], pa.list_(pa.string()))], names=["label", "words"])

    got = sample.select("label", "text").mapInArrow(run, "label int, words array<string>").toArrow()
    return sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))


def _logits(sample: DataFrame, net: Network) -> tuple[np.ndarray, np.ndarray]:
    """Largest logits and labels of the sample's texts."""
    sent = sample.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.logits(b.column(1).to_pylist())[0].astype(np.float64))], names=["label", "logit"])

    got = sample.select("label", "text").mapInArrow(run, "label int, logit double").toArrow()
    y, v = (got.column(k).to_numpy() for k in range(2))
    order = np.lexsort((y, v))
    return v[order], y[order]


def train(sample: DataFrame, seed: int = 1) -> Network:
    """A calibrated network from (label, text, fold): whole texts, labels 0 or 1, and a number below FOLDS."""
    size = {(r.fold, r.label): r["count"] for r in sample.groupBy("fold", "label").count().collect()}
    n = [sum(v for (_, y), v in size.items() if y == label) for label in (0, 1)]
    if not all(n):
        net = Network({}, seed)
        share = float(np.clip(n[1] / max(1, sum(n)), 1e-6, 1 - 1e-6))
        net.slope, net.shift = 0.0, float(np.log(share / (1 - share)))
        return net

    def one(use: DataFrame) -> Network:
        z = evidence(use)
        net = Network(z, seed)
        clean, toxic = [], []
        for y, w in _picked(use, z, None):
            (toxic if y else clean).append(w)
        for last in (False, True):
            net.fit(clean + toxic, np.r_[np.zeros(len(clean)), np.ones(len(toxic))].astype(np.float32))
            if not last:
                again = _picked(use, None, net)
                clean += [w for y, w in again if not y]
                toxic = [w for y, w in again if y]
        return net

    net = one(sample)
    apart = all(size.get((0, y)) and any(size.get((k, y)) for k in range(1, FOLDS)) for y in (0, 1))
    seen = _logits(sample.where("fold = 0"), one(sample.where("fold <> 0"))) if apart else _logits(sample, net)
    net.slope, net.shift = _platt(seen[0], np.where(seen[1] > 0, 1, -1))
    return net


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, stride: int = STRIDE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = labelled(rows, labels, "toxic", 5, 0, sample)
    net = train(seen.select("label", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(FOLDS)).cast("int").alias("fold")))
    sent = docs.sparkSession.sparkContext.broadcast(net)  # bounded by VOCABULARY and GRAMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value, stride)
        for b in batches:
            s = scorer.scores([t or "" for t in b.column(1).to_pylist()]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
