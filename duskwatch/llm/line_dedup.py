"""Line dedup over overlapping three-line windows.

Each run of three consecutive non-blank lines of a document is hashed.  A window seen more
than once in the corpus keeps its first occurrence (lowest ``doc_id``, then lowest position);
the positions that its later occurrences cover are merged, and those lines go.

Plan: the window hashes (with the place of their row, never the text) are written once, shuffled once for the aggregate,
which combines on the map side, and once for the join that finds later occurrences; a hot
window thus costs one row a task in the former, and AQE splits it in the latter.  The text
moves once, to meet the hashes that its document has to give up.

Defined results
---------------
* A null text stays null; an empty text, and one of fewer than three non-blank lines, stays as it is.
* Lines are compared without surrounding blanks, tabs and carriage returns; a blank line belongs to no window and stays.
* Rows that share a ``doc_id`` are ordered by the hash of their text, and so are rows with null ids, which come after all others.  Rows that are equal in id and text (64 bits of its hash)
  are one document: they do not take lines from each other.  Within a row the first occurrence of a window stays.
* Columns other than id, text and ``n_chars`` pass through unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .common import place, slices, written

WINDOW = 3
BLANK = " \t\r"
_REMOVED = "__later_windows__"
_K = np.uint64(0x9E3779B97F4A7C15)


def _windows(texts: list[str | None], n: int) -> tuple[list[list[str]], list[np.ndarray], list[np.ndarray]]:
    """For each text its lines, the positions of its non-blank lines, and the hashes of its windows."""
    lines = [t.split("\n") if t else [] for t in texts]
    at, keys = [], []
    for own in lines:
        kept = [(i, k) for i, x in enumerate(own) if (k := x.strip(BLANK))]
        at.append(np.array([i for i, _ in kept], dtype=np.int64))
        h = np.array([xxhash.xxh3_64_intdigest(k) for _, k in kept], dtype=np.uint64)
        m = max(0, len(h) - n + 1)
        acc = np.zeros(m, dtype=np.uint64)
        for j in range(n):
            acc = (acc ^ h[j : j + m]) * _K
            acc ^= acc >> np.uint64(29)
        keys.append(textops.mix64(acc).view(np.int64))
    return lines, at, keys


def window_hashes(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(h, none, id, t): the distinct windows of each row, and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, texts in slices(b, 0):
                _, _, keys = _windows(texts, n)
                keys = [np.unique(k) for k in keys]
                row = np.repeat(np.arange(begin, begin + len(texts)), [len(k) for k in keys])
                if len(row):
                    row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *(b.column(i).take(row) for i in (1, 2, 3))], names=["h", "none", "id", "t"])

    return docs.select(F.col(text_col).alias("text"), place(F.col(id_col), text_col).alias("p")).select("text", "p.*").mapInArrow(run, "h long, none boolean, id long, t long")


def later(windows: DataFrame, hashes: str = _REMOVED) -> DataFrame:
    """(none, id, t, hashes): of written (h, none, id, t) the windows that each place shares with an earlier one."""
    p = F.struct("none", "id", "t")
    first = windows.groupBy("h").agg(F.min(p).alias("lo"), F.max(p).alias("hi")).where("lo < hi").select("h", "lo")
    return windows.join(first, "h").where(p > F.col("lo")).groupBy("none", "id", "t").agg(F.collect_set("h").alias(hashes))


def meet(docs: DataFrame, given_up: DataFrame, id_col: str, text_col: str, hashes: str = _REMOVED) -> DataFrame:
    """`docs` with one column more: what each row has to give up."""
    keyed = docs.withColumn("__place__", place(F.col(id_col), text_col))
    own = given_up.select(F.struct("none", "id", "t").alias("__given__"), hashes)
    same = [F.col(f"__place__.{x}") == F.col(f"__given__.{x}") for x in ("none", "id", "t")]
    return keyed.join(own.hint("shuffle_hash"), same, "left").drop("__place__", "__given__")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW, removed_col: str | None = None) -> DataFrame:
    """`docs` with later occurrences of repeated windows cut from the text.

    ``n_chars``, where there is one, follows the new text.  `removed_col` names a column to add with the number of lines cut.
    """
    joined = meet(docs, later(written(window_hashes(docs, id_col, text_col, n), "windows")), id_col, text_col)
    names = docs.columns
    at, chars = names.index(text_col), names.index("n_chars") if "n_chars" in names else None
    schema = T.StructType([*docs.schema.fields, *([T.StructField(removed_col, T.LongType())] if removed_col else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns)
            gone = cols.pop().to_pylist()
            out: list[str | None] = []
            cut: list[int] = []
            for begin, texts in slices(b, at):
                lines, where, keys = _windows(texts, n)
                for i, t in enumerate(texts):
                    k, drop = keys[i], gone[begin + i]
                    hit = np.ones(len(k), dtype=bool)
                    hit[np.unique(k, return_index=True)[1]] = False
                    if drop:
                        hit |= np.isin(k, np.array(drop, dtype=np.int64))
                    covered = np.zeros(len(where[i]), dtype=bool)
                    for j in range(n):
                        covered[j : j + len(k)] |= hit
                    c = set(where[i][covered].tolist())
                    cut.append(len(c))
                    out.append("\n".join(x for p, x in enumerate(lines[i]) if p not in c) if c else t)
            field = b.schema.field(at)
            cols[at] = pa.array(out, type=field.type)
            if chars is not None:
                kind = cols[chars].type
                cols[chars] = pa.array([old if not c else len(t) for old, c, t in zip(cols[chars].to_pylist(), cut, out, strict=True)], type=kind)
            if removed_col:
                cols.append(pa.array(cut, type=pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return joined.mapInArrow(run, schema)


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), nb AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i
  FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
), w AS (
  SELECT doc_id, i, k, lead(k, 1) OVER (PARTITION BY doc_id ORDER BY i) AS k2, lead(k, 2) OVER (PARTITION BY doc_id ORDER BY i) AS k3 FROM nb
), r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY k, k2, k3 ORDER BY doc_id, i) AS rn FROM w WHERE k3 IS NOT NULL
), c AS (
  SELECT DISTINCT doc_id, i + o AS i FROM r CROSS JOIN (SELECT unnest([0, 1, 2]) AS o) WHERE rn > 1
), g AS (
  SELECT nb.doc_id, nb.pos FROM nb JOIN c ON nb.doc_id = c.doc_id AND nb.i = c.i
), a AS (
  SELECT l.doc_id, string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos) AS text, count(g.pos) AS n
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT d.doc_id,
       CASE WHEN a.n > 0 THEN coalesce(a.text, '') ELSE d.text END AS text,
       CASE WHEN a.n > 0 THEN length(coalesce(a.text, '')) ELSE d.n_chars END AS n_chars,
       coalesce(a.n, 0) AS lines_removed
FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id
"""
