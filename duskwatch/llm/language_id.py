"""Language identification: sparse multinomial logistic regression over TF-IDF character n-grams.

Texts are lower-cased, anything that is not a letter becomes one space, and n-grams of one to three
characters are hashed.  Inverse document frequencies come from all documents.  The classifier is trained with
FTRL-proximal under an elastic-net penalty, which leaves most weights exactly zero, on labelled rows
(`lang`), and a temperature is then fitted on held-out rows so that the probabilities mean what they say.

Plan: one pass counts document frequencies, each task handing on one fixed-size table that combines on
the map side; a bounded sample (`max_rows` lowest id hashes, one text of each, `max_bytes` together) trains on the driver; one pass scores in Arrow batches.
No text is shuffled.

Defined results
---------------
* A text without letters, an empty one or a null one is ``und`` with probability 0.0.
* Rows with a null or empty label take no part in training; with no label, or only one, no classifier can be trained: every text with letters gets that label,
  or ``und`` if there is none, with a null probability.
* Ties between languages go to the first in alphabetical order.  Repeated rows are scored alike, each of them; a null id is carried along.
* Only id, text and label are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, training_texts

MAX_ROWS = 4000
MAX_BYTES = 256 << 20
BITS = 15
BUCKETS = 1 << BITS
SCHEMA = "doc_id long, declared string, predicted string, probability double"
_U = np.uint32
_ASCII_LETTER = np.zeros(128, dtype=bool)
_ASCII_LETTER[97:123] = True


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, order by order (3 x N), which count, and where each text begins among the N positions."""
    joined = "".join(" " + t.lower() + " " if t else " " for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=_U)
    lens = np.fromiter((len(t.lower()) + 2 if t else 1 for t in texts), np.int64, len(texts))
    letter = (codes >= 128) | _ASCII_LETTER[np.minimum(codes, 127)]
    codes = np.where(letter, codes, _U(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of other characters, the first
    keep[np.cumsum(lens) - lens] = True  # and the one before the text
    at = np.concatenate([[0], np.cumsum(keep)[np.cumsum(lens) - 1]])
    c = codes[keep]
    n = len(c)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    out = np.zeros((3, n), dtype=np.int64)
    ok = np.zeros((3, n), dtype=bool)
    for k in range(1, 4):
        m = max(0, n - k + 1)
        h = np.full(m, k, dtype=_U)
        for j in range(k):
            h *= _U(0x9E3779B1)
            h ^= c[j : j + m]
        h ^= h >> _U(15)
        h *= _U(0x85EBCA77)
        h ^= h >> _U(13)
        h *= _U(0xC2B2AE3D)
        out[k - 1, :m] = h >> _U(32 - BITS)
        ok[k - 1, :m] = doc[:m] == doc[k - 1 : k - 1 + m]
    ok[0] &= c != 32
    return out, ok, at


def counts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text, its buckets and how often each occurs; nothing for a text without letters."""
    b, ok, at = grams(texts)
    none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    for i in range(len(texts)):
        s = slice(at[i], at[i + 1])
        if not ok[0, s].any():
            yield none
            continue
        own = b[:, s][ok[:, s]]
        c = np.bincount(own, minlength=BUCKETS)
        nz = np.flatnonzero(c)
        yield nz, c[nz]


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents with each bucket, and documents with any, over all of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS + 1, dtype=np.int64)
        for b in batches:
            for _, texts in slices(b, 0, 1 << 20):
                for nz, _ in counts(texts):
                    if len(nz):
                        df[nz] += 1
                        df[BUCKETS] += 1
        nz = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(nz, pa.int32()), pa.array(df[nz])], names=["bucket", "df"])

    got = docs.select(text_col).mapInArrow(run, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    out[got["bucket"].to_numpy()] = got["df"].to_numpy()
    return out[:BUCKETS], int(out[BUCKETS])


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x labels
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, nz: np.ndarray, c: np.ndarray) -> np.ndarray:
        return vector(nz, c, self.idf) @ self.weights[nz] + self.bias


def vector(nz: np.ndarray, c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(c)) * idf[nz]
    return v / max(1e-12, float(np.sqrt(v @ v)))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], y: list[str], idf: np.ndarray, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, held: int = 5) -> Model | None:
    """FTRL-proximal with elastic net; every `held`-th row sets the temperature."""
    labels = sorted(set(y))
    k = len(labels)
    if k < 2:
        return Model(labels, idf, np.zeros((BUCKETS, k)), np.zeros(k)) if k else None
    code = np.array([labels.index(v) for v in y])
    x = [(nz, vector(nz, c, idf)) for i in range(0, len(texts), 128) for nz, c in counts(texts[i : i + 128])]
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    z_one = np.eye(k)

    def weights(idx: np.ndarray | slice) -> np.ndarray:
        zi = z[idx]
        return np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[idx])) / alpha + l2), 0.0)

    use = [i for i in range(len(y)) if len(x[i][0])]
    fitted = [i for p, i in enumerate(use) if p % held != held - 1]
    out = [i for p, i in enumerate(use) if p % held == held - 1] or fitted
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(fitted):
            idx, v = np.append(x[i][0], BUCKETS), np.append(x[i][1], 1.0)
            w = weights(idx)
            g = v[:, None] * (softmax(v @ w) - z_one[code[i]])
            sigma = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / alpha
            z[idx] += g - sigma * w
            n[idx] += g * g
    w = weights(slice(None))
    m = Model(labels, idf, w[:BUCKETS], w[BUCKETS])
    if out:
        logit = np.array([x[i][1] @ m.weights[x[i][0]] + m.bias for i in out])
        m.temperature = temperature(logit, code[out])
    return m


def temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden section over its logarithm."""

    def loss(t: float) -> float:
        p = softmax(logit / np.exp(t))
        return -float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())

    a, b, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model | None:
    """A model fitted on at most `max_rows` ids of `docs`, one text of each, and `max_bytes` of text; document frequencies are of all."""
    df, n = document_frequencies(docs, text_col)
    idf = np.log((1 + n) / (1 + df)) + 1
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), F.col(label_col).alias("y")).where("id IS NOT NULL AND y <> '' AND t <> ''")
    few = own.select("id").distinct().withColumn("k", F.xxhash64("id")).orderBy("k", "id").limit(max_rows)
    got = training_texts(own, few, max_bytes)
    if not got.num_rows:
        return None
    return fit(got["t"].to_pylist(), got["y"].to_pylist(), idf)


def predict(m: Model | None, texts: list[str | None]) -> list[tuple[str, float | None]]:
    out: list[tuple[str, float | None]] = []
    for nz, c in counts(texts):
        if not len(nz):
            out.append(("und", 0.0))
        elif m is None or len(m.labels) < 2:
            out.append((m.labels[0] if m and m.labels else "und", None))
        else:
            p = softmax(m.logits(nz, c) / m.temperature)
            k = int(p.argmax())
            out.append((m.labels[k], round(float(p[k]), 6)))
    return out


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", label_col: str | None = "lang") -> DataFrame:
    """(doc_id, declared, predicted, probability) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    declared = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, texts in slices(b, 2, 1 << 20):
                got = predict(shared.value, texts)
                n = len(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, n), b.column(1).slice(begin, n), pa.array([g[0] for g in got]), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "declared", "predicted", "probability"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), declared.alias("declared"), F.col(text_col)).mapInArrow(run, SCHEMA)
