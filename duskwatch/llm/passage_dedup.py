"""Passage dedup: exact search for passages of 50 or more words that an earlier document has.

Line dedup compares whole lines, three at a time; a passage within one line, or one that does not fill three whole lines, is beyond it.
Here every run of `WINDOW` words of a document is a window, wherever lines end.  A window seen more than once in the corpus keeps its
first occurrence (lowest ``doc_id``, then lowest position); the words that its later occurrences cover are merged, and they go.

Plan: of each window the least of its 26 hashes of 25 words is its mark.  Equal windows have equal marks, and neighbours mostly share theirs, so
the marks (about one in 13 words) are shuffled first.  Those of more than one document go into a bit set of fixed size, which is broadcast; only
windows whose mark is in it are shuffled in full.  A false hit there costs a row and changes nothing.  Windows whose mark more than `HOT` documents have are spread by document
over `SPREAD` tasks; the first of each task meet once more.  The text moves once, to meet the windows that its document has to give up.

Defined results
---------------
* A word is a run of anything but ASCII white space, compared as it is, case kept.  A text of fewer than `WINDOW` words stays as it is.
* Of the white space on both sides of what is cut, the one with more line feeds stays (the first, if equal); at either end of the text none.
* Null texts, repeated ids, null ids and repeats within a row are treated as in line dedup; so are ``n_chars`` and other columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .common import place, slices
from .line_dedup import meet

WINDOW = 50
HALF = 25
SIEVE_BITS = 27
HOT = 20_000
SPREAD = 64
_LATER = "__later_passages__"
_U = np.uint64
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of runs of words from those of their first and second parts."""
    x = a * _U(0x9E3779B97F4A7C15) + (b ^ (b >> _U(29))) * _U(0xC2B2AE3D27D4EB4F)
    x ^= x >> _U(31)
    return x


def _runs(h: np.ndarray) -> np.ndarray:
    """Hashes of runs of `HALF` words (16 + 8 + 1)."""
    g = [h]
    for k in (1, 2, 4, 8):
        g.append(_pair(g[-1][: max(0, len(g[-1]) - k)], g[-1][k:]))
    m = max(0, len(h) - HALF + 1)
    return textops.mix64(_pair(_pair(g[4][:m], g[3][16 : 16 + m]), h[24 : 24 + m]))


def _least(g: np.ndarray) -> np.ndarray:
    """The least of each `HALF` + 1 neighbours."""
    m = max(0, len(g) - HALF)
    for k in (1, 2, 4, 8):
        g = np.minimum(g[: max(0, len(g) - k)], g[k:])
    return np.minimum(g[:m], g[10 : 10 + m])


@dataclass
class Passages:
    """The windows of a list of texts."""

    buf: np.ndarray
    at: np.ndarray  # where each text begins in `buf`
    begin: np.ndarray  # of words
    end: np.ndarray
    first: np.ndarray  # word at which each text begins
    word: np.ndarray  # first word of each window
    doc: np.ndarray  # its text
    key: np.ndarray
    mark: np.ndarray


def passages(texts: list[str | None]) -> Passages:
    buf, at = textops.join(textops.encode(texts, lower=False))
    edge = np.diff(_WORD[buf].astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.searchsorted(s, at)
    g = _runs(textops.span_hashes(buf, s, e))
    m = max(0, len(s) - WINDOW + 1)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    word = np.flatnonzero(doc[:m] == doc[WINDOW - 1 : WINDOW - 1 + m])
    key = textops.mix64(_pair(g[:m], g[HALF : HALF + m]))[word]
    mark = textops.mix64(_least(g)[word])
    return Passages(buf, at, s, e, first, word, doc[word], key, mark)


def _rows(docs: DataFrame, id_col: str, text_col: str, name: str, pick) -> DataFrame:
    """(name, hot, none, id, t): the distinct hashes that `pick` takes from the windows of each row, whether each is hot, and the row's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, texts in slices(b, 0):
                h, d, hot = pick(passages(texts))
                if len(h):
                    h, bounds = textops.unique_per_doc(h, d, len(texts))
                    row = pa.array(np.repeat(np.arange(begin, begin + len(texts)), np.diff(bounds)))
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.isin(h, hot)), *(b.column(i).take(row) for i in (1, 2, 3))], names=[name, "hot", "none", "id", "t"])

    return docs.select(F.col(text_col).alias("text"), place(F.col(id_col), text_col).alias("p")).select("text", "p.*").mapInArrow(run, f"{name} long, hot boolean, none boolean, id long, t long")


def _place(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of a mark in the bit set."""
    return (mark >> _U(64 - SIEVE_BITS + 6)).astype(np.int64), (mark >> _U(64 - SIEVE_BITS)) & _U(63)


def shared_marks(docs: DataFrame, id_col: str, text_col: str, hot: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """Two bit sets: the marks that more than one document has, and those that more than `hot` have."""
    none = np.zeros(0, dtype=_U)
    p = F.struct("none", "id", "t")
    m = _rows(docs, id_col, text_col, "m", lambda p: (p.mark, p.doc, none)).groupBy("m").agg(F.min(p).alias("lo"), F.max(p).alias("hi"), F.count("*").alias("c")).where("lo < hi")
    w, bit = F.shiftrightunsigned("m", 64 - SIEVE_BITS + 6), F.shiftrightunsigned("m", 64 - SIEVE_BITS).bitwiseAND(F.lit(63)).cast("int")
    b = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    got = m.select(w.alias("w"), b.alias("b"), F.when(F.col("c") > hot, b).otherwise(0).alias("hot")).groupBy("w").agg(F.bit_or("b").alias("b"), F.bit_or("hot").alias("hot")).toArrow()
    out = []
    for name in ("b", "hot"):
        sieve = np.zeros(1 << (SIEVE_BITS - 6), dtype=_U)
        sieve[got["w"].to_numpy()] = got[name].to_numpy().astype(np.int64).view(_U)
        out.append(sieve)
    return out[0], out[1]


def later_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(none, id, t, hashes): the windows that each row shares with an earlier one."""
    marks = shared_marks(docs, id_col, text_col, hot)
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def pick(p: Passages) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w, bit = _place(p.mark)
        hit = (shared.value[0][w] >> bit) & _U(1) > 0
        key = p.key[hit]
        return key, p.doc[hit], key[(shared.value[1][w[hit]] >> bit[hit]) & _U(1) > 0]

    p = F.struct("none", "id", "t")
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("none", "id", "t"), F.lit(SPREAD))).otherwise(0)
    rows = _rows(docs, id_col, text_col, "h", pick).withColumn("part", part).withColumn("lo", F.min(p).over(Window.partitionBy("h", "part")))
    found = rows.where(p > F.col("lo")).select("none", "id", "t", "h")
    if marks[1].any():  # of a hot window the first of each part meet
        ends = rows.where(F.col("hot") & (p == F.col("lo"))).select("h", "none", "id", "t").distinct().withColumn("lo", F.min(p).over(Window.partitionBy("h")))
        found = found.unionByName(ends.where(p > F.col("lo")).select("none", "id", "t", "h"))
    return found.groupBy("none", "id", "t").agg(F.collect_set("h").alias(_LATER))


def _cut(p: Passages, i: int, covered: np.ndarray) -> str:
    """Text i without its covered words."""
    lo, hi = p.first[i], p.first[i + 1]
    edge = np.diff(covered.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    out, held = [], int(p.at[i])
    top = int(p.at[i + 1]) - 1
    for a, b in zip(np.flatnonzero(edge == 1) + lo, np.flatnonzero(edge == -1) + lo, strict=True):
        s0, s1 = (int(p.end[a - 1]) if a > lo else int(p.at[i])), int(p.begin[a])
        e0, e1 = int(p.end[b - 1]), (int(p.begin[b]) if b < hi else top)
        before, after = p.buf[s0:s1].tobytes(), p.buf[e0:e1].tobytes()
        out.append(p.buf[held:s0].tobytes())
        if a > lo and b < hi:
            out.append(after if after.count(b"\n") > before.count(b"\n") else before)
        held = e1
    out.append(p.buf[held:top].tobytes())
    return b"".join(out).decode()


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None, hot: int = HOT) -> DataFrame:
    """`docs` with later occurrences of repeated passages cut from the text.

    ``n_chars``, where there is one, follows the new text.  `removed_col` names a column to add with the number of words cut.
    """
    joined = meet(docs, later_passages(docs, id_col, text_col, hot), id_col, text_col, _LATER)
    names = docs.columns
    at, chars = names.index(text_col), names.index("n_chars") if "n_chars" in names else None
    schema = T.StructType([*docs.schema.fields, *([T.StructField(removed_col, T.LongType())] if removed_col else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns)
            gone = cols.pop()
            out: list[str | None] = []
            cut: list[int] = []
            for begin, texts in slices(b, at):
                p = passages(texts)
                hit = np.ones(len(p.key), dtype=bool)
                hit[np.unique(p.key ^ textops.mix64(p.doc.astype(_U)), return_index=True)[1]] = False
                bounds = np.searchsorted(p.doc, np.arange(len(texts) + 1))
                for i, t in enumerate(texts):
                    own = slice(bounds[i], bounds[i + 1])
                    if (drop := gone[begin + i].as_py()) is not None:
                        hit[own] |= np.isin(p.key[own].view(np.int64), np.array(drop, dtype=np.int64))
                    at_word = p.word[own][hit[own]] - p.first[i]
                    if not len(at_word):
                        out.append(t)
                        cut.append(0)
                        continue
                    turn = np.zeros(p.first[i + 1] - p.first[i] + 1, dtype=np.int64)
                    np.add.at(turn, at_word, 1)
                    np.add.at(turn, at_word + WINDOW, -1)
                    covered = np.cumsum(turn)[:-1] > 0
                    out.append(_cut(p, i, covered))
                    cut.append(int(covered.sum()))
            cols[at] = pa.array(out, type=b.schema.field(at).type)
            if chars is not None:
                kind = cols[chars].type
                cols[chars] = pa.array([old if not c else len(t) for old, c, t in zip(cols[chars].to_pylist(), cut, out, strict=True)], type=kind)
            if removed_col:
                cols.append(pa.array(cut, type=pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return joined.mapInArrow(run, schema)
