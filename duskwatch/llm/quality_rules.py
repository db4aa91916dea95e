"""Quality rules: a hashed n-gram logistic regression, calibrated, held against fixed thresholds.

Features are relative frequencies of hashed character bigrams and trigrams (case kept, so shouting and
symbol noise show), of lower-cased words, and of word bigrams, in which a word followed by itself is one
feature of its own.  The weights are fitted by AdaGrad with an L2 penalty on labelled rows, the score is
mapped to a probability by Platt scaling on labelled rows held out of the fit, and the probability is
compared with fixed thresholds.

Toxic texts are told by a few words among many, which a relative frequency does not show.  A second model has the hashed words that
occur in toxic labelled rows more often than chance allows (`TOXIC_Z` standard deviations), each counted once a text, with smoothed log-odds as
weights.  Its probability has a fixed threshold of its own, beyond which a text is rejected whatever its quality.

Plan: the labelled rows to fit on are the `max_rows` with the lowest id hash, picked from the narrow label
table; that bounded list is broadcast to fetch their texts, and the model is fitted on the driver.  Scoring is
one pass over the documents in Arrow batches, without a shuffle: the score is linear in the
counts, so a batch costs array gathers and no work for each document in Python.

Defined results
---------------
* A null, empty or blank text has no features: probability 0.0, decision ``reject``.
* Ids labelled both ways are left out of the fit; repeated equal labels count once; null labels and ids are ignored.
* With fewer than `MIN_CLASS` labelled documents of either kind there is nothing to learn: every
  document that has text gets a null probability and decision ``keep``.
* The same holds for the labels of the toxic model; without one ``p_toxic`` is null and rejects nothing.  A text without words to weigh has the share of toxic rows among the labelled ones.
* A probability that equals a threshold has reached it: kept at `keep_at`, high at `high_at`, toxic at `toxic_at`.
* Of an id that several rows share, the text with the lowest hash is fitted on; the texts together have `max_bytes` at most, in order of id hash.
* Repeated rows are scored alike; a null id is carried along.  Only ids and texts are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import slices, training_texts

MAX_ROWS = 6000
MAX_BYTES = 256 << 20
KEEP_AT = 0.5
HIGH_AT = 0.9
TOXIC_AT = 0.5
TOXIC_Z = 6.0
TOXIC_PURE = 0.8  # share of toxic rows among those that have the word
TOXIC_ROWS, TOXIC_SHARE = 5, 0.003  # labelled rows that a word must occur in, and their share: copies of a few texts make no rule
TOXIC_BITS = 20
MIN_CLASS = 8
BITS = 18
GROUPS = 4
SCHEMA = "doc_id long, p_quality double, grade string, decision string, p_toxic double"
_U = np.uint32


def _mix32(h: np.ndarray) -> np.ndarray:
    h ^= h >> _U(15)
    h *= _U(0x2C1B3C6D)
    h ^= h >> _U(13)
    return h


def char_grams(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of all texts together, which of them lie within one text, and where each text begins."""
    lens = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    at = np.concatenate([[0], np.cumsum(lens)])
    codes = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=_U)
    m = max(0, len(codes) - n + 1)
    h = np.full(m, n, dtype=_U)
    for k in range(n):
        h *= _U(0x9E3779B1)
        h ^= codes[k : k + m]
    b = _mix32(h * _U(0x85EBCA77)) >> _U(32 - BITS)
    ok = np.ones(len(codes), dtype=bool)
    for k in range(1, n):
        ends = at[1:] - k
        ok[ends[ends >= 0]] = False
    ok[m:] = False
    return b, ok[:m], at


def groups(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each group of features: buckets, whether each counts, and where each text begins among them."""
    yield char_grams(texts, 2)
    yield char_grams(texts, 3)
    h, at = textops.words(texts)
    shift = np.uint64(64 - BITS)
    yield (h >> shift).astype(np.int64), np.ones(len(h), dtype=bool), at
    pair = textops.mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:])
    pair[h[:-1] == h[1:]] = 0
    ok = np.ones(len(pair), dtype=bool)
    last = at[1:] - 1
    ok[last[(last >= 0) & (last < len(pair))]] = False
    yield (pair >> shift).astype(np.int64), ok, at


def rows(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse features of each text: indices and values."""
    out: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
    for g, (b, ok, at) in enumerate(groups(texts)):
        for i in range(len(texts)):
            own = b[at[i] : at[i + 1]][ok[at[i] : at[i + 1]]]
            if len(own):
                u, c = np.unique(own, return_counts=True)
                out[i].append((u.astype(np.int32) + (g << BITS), (c / len(own)).astype(np.float32)))
    none = (np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32))
    return [(np.concatenate([p[0] for p in o]), np.concatenate([p[1] for p in o])) if o else none for o in out]


@dataclass
class Model:
    weights: np.ndarray  # of all groups
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, texts: list[str | None]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        for g, (b, ok, at) in enumerate(groups(texts)):
            w = self.weights[g << BITS : (g + 1) << BITS]
            v = np.where(ok, w[b], 0.0)
            c = np.concatenate([[0.0], np.cumsum(v, dtype=np.float64)])
            n = np.concatenate([[0], np.cumsum(ok)])
            top = np.minimum(at, len(v))
            total += (c[top[1:]] - c[top[:-1]]) / np.maximum(1, n[top[1:]] - n[top[:-1]])
        return 1 / (1 + np.exp(-np.clip(self.slope * total + self.shift, -30, 30)))


def _platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that minimise the log loss of sigmoid(slope * s + shift), by Newton's method on smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([s, np.ones_like(s)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (p - t) + 1e-6 * (w - [1.0, 0.0]))
        w -= step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def fit(texts: list[str], y: np.ndarray, epochs: int = 8, rate: float = 0.5, l2: float = 1e-6, held: int = 5) -> Model | None:
    """Fit and calibrate; every `held`-th row is kept for calibration.  None if either class is too small."""
    if min(int(y.sum()), int(len(y) - y.sum())) < MIN_CLASS:
        return None
    x = [r for i in range(0, len(texts), 256) for r in rows(texts[i : i + 256])]
    out = np.arange(len(y)) % held == held - 1
    if min(y[out].sum(), (1 - y[out]).sum()) < 2:
        out[:] = False
    w = np.zeros(GROUPS << BITS)
    g2 = np.full(GROUPS << BITS, 1e-8)
    bias, b2 = 0.0, 1e-8
    rng = np.random.default_rng(7)
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for i in rng.permutation(np.flatnonzero(~out)):
            idx, v = x[i]
            e = 1 / (1 + np.exp(-np.clip(w[idx] @ v + bias, -30, 30))) - y[i]
            g = e * v + l2 * w[idx]
            g2[idx] += g * g
            w[idx] -= step * g / np.sqrt(g2[idx])
            b2 += e * e
            bias -= step * e / np.sqrt(b2)
    use = out if out.any() else ~out
    s = np.array([w[x[i][0]] @ x[i][1] + bias for i in np.flatnonzero(use)])
    slope, shift = _platt(s, y[use])
    return Model(w.astype(np.float32), float(bias), slope, shift)


def _present(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the distinct word buckets of each text."""
    h, at = textops.words(texts)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(at))
    k = np.unique((doc << TOXIC_BITS) | (h >> np.uint64(64 - TOXIC_BITS)).astype(np.int64))
    return k >> TOXIC_BITS, k & ((1 << TOXIC_BITS) - 1)


@dataclass
class Toxic:
    weights: np.ndarray  # of word buckets
    bias: float

    def probability(self, texts: list[str | None]) -> np.ndarray:
        d, b = _present(texts)
        s = self.bias + np.bincount(d, weights=self.weights[b], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def fit_toxic(texts: list[str], y: np.ndarray) -> Toxic | None:
    """The words that mark toxic texts, with their weights.  None if either class is too small."""
    if min(int(y.sum()), int(len(y) - y.sum())) < MIN_CLASS:
        return None
    n, pos = np.zeros(1 << TOXIC_BITS), np.zeros(1 << TOXIC_BITS)
    for i in range(0, len(texts), 256):
        d, b = _present(texts[i : i + 256])
        n += np.bincount(b, minlength=len(n))
        pos += np.bincount(b, weights=y[i : i + 256][d], minlength=len(n))
    share = y.mean()
    bias = float(np.log(share / (1 - share)))
    z = (pos - n * share) / np.sqrt(np.maximum(n, 1) * share * (1 - share))
    w = np.where((z > TOXIC_Z) & (pos >= TOXIC_PURE * n) & (n >= max(TOXIC_ROWS, TOXIC_SHARE * len(y))), np.log((pos + 0.5) / (n - pos + 0.5)) - bias, 0.0)
    return Toxic(w.astype(np.float32), bias)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, how: Callable = fit) -> Model | Toxic | None:
    """A model fitted on at most `max_rows` labelled ids of `docs`, one text of each, and `max_bytes` of text."""
    one = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    one = one.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y_max")).where("y = y_max").select("id", "y")
    few = one.withColumn("k", F.xxhash64("id")).orderBy("k", "id").limit(max_rows)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    got = training_texts(own, few, max_bytes)
    if not got.num_rows:
        return None
    return how(got["t"].to_pylist(), got["y"].to_numpy().astype(float))


def train_toxic(docs: DataFrame, labels: DataFrame, **options) -> Toxic | None:
    """The model of toxic texts, fitted as `train` does."""
    return train(docs, labels, **{"label_col": "toxic", "how": fit_toxic} | options)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT, high_at: float = HIGH_AT, toxic: Toxic | None = None, toxic_at: float = TOXIC_AT) -> DataFrame:
    """(doc_id, p_quality, grade, decision, p_toxic) of every row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast((model, toxic))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, tox = shared.value
        for b in batches:
            for begin, texts in slices(b, 1):
                p, q = _decide(m, texts), _decide(tox, texts)
                grade = ["none" if x is None else "high" if x >= high_at else "fair" if x >= keep_at else "low" for x in p]
                decision = ["keep" if _kept(x, y, keep_at, toxic_at) else "reject" for x, y in zip(p, q, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, len(texts)), pa.array(p, pa.float64()), pa.array(grade), pa.array(decision), pa.array(q, pa.float64())], names=["doc_id", "p_quality", "grade", "decision", "p_toxic"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, SCHEMA)


def _kept(p: float | None, toxic: float | None, keep_at: float, toxic_at: float) -> bool:
    return (p is None or p >= keep_at) and (toxic is None or toxic < toxic_at)


def _decide(model: Model | Toxic | None, texts: list[str | None]) -> list[float | None]:
    has = [bool(t and t.strip()) for t in texts]
    if model is None:
        return [None if h else 0.0 for h in has]
    return [round(float(x), 6) if h else 0.0 for h, x in zip(has, model.probability(texts), strict=True)]


def keep(docs: DataFrame, model: Model | None, text_col: str = "text", keep_at: float = KEEP_AT, toxic: Toxic | None = None, toxic_at: float = TOXIC_AT) -> DataFrame:
    """The rows of `docs` that are not rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast((model, toxic))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, tox = shared.value
        for b in batches:
            mask = [_kept(x, y, keep_at, toxic_at) for _, texts in slices(b, at) for x, y in zip(_decide(m, texts), _decide(tox, texts), strict=True)]
            yield b.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
