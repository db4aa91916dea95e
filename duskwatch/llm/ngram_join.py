"""N-gram Jaccard join with adaptive multi-match prefixes.

Finds which documents have sets of word n-grams with a Jaccard similarity of at least `threshold`.  N-grams are ordered from
rare to frequent by their document frequency in the whole corpus.  If two documents overlap by enough, then the first
``|d| - ceil(threshold * |d|) + l`` n-grams of each, its l-prefix, share at least l.  A longer prefix costs more postings but asks for more matches, so fewer
candidates have to be verified; each document takes the l from 1 to `most_matches` with the least estimated cost, by the document frequencies
of its own n-grams.  A pair is verified once it shares as many prefix n-grams as the smaller l of the two.

The result has one row for each document: the class it belongs to (documents connected by similarity, named by their lowest id) and its number of links (all
other documents that are similar to it, copies included).  Every link between different texts is found and counted; none is listed, so groups of copies cost no rows.

Plan
----
1. A first pass over the texts gives each row a 128-bit hash of its set of n-grams.  Rows with equal sets are one class from here on, compared once.  The same pass
   counts n-grams that are frequent in a run of texts; those that make up more than a 2**20th of all n-grams are the hot ones, at most 2**20 by that definition, and are broadcast.
2. Texts become n-gram hashes in Arrow batches and are shuffled once, packed in binary columns by hash bucket (about 7 bytes an n-gram).  A bucket
   knows all documents of its n-grams: those found in one document only go no further than a count.  Hot n-grams need no count; they travel with their
   documents, spread evenly.  An n-gram that is not hot occurs less often than 4 times in a million n-grams, somewhere at least, so no bucket holds a large share of the corpus.
3. The rest returns to its documents, which choose their prefixes.  Prefix postings are packed by n-gram bucket; an n-gram of more than `LIST_DOCS` documents is
   cut into blocks of documents, and each pair of blocks is a list of its own.  A posting carries the few
   prefix n-grams before it; if two postings share l of those, their pair has been emitted often enough and is passed over.  So what a pair costs in the shuffle does not grow with the length
   of its texts, and no list of documents is ever cut short.
4. Candidate pairs are gathered in tiles around their lowest neighbour.  A tile of many pairs or long texts is cut into a grid of x by y blocks, so that a part has a bounded number of
   pairs and of n-grams; a set travels once to each part it is in, so copies of sets grow as the pairs at most.  The exact overlap of all pairs of a part is counted by array operations, and what leaves
   it is a count and a root for each document, not the pairs.
Nothing else is broadcast but ids (of collapsed copies, and of what a tile needs) while they are few (`BROADCAST_ROWS`, counted first); beyond that the same joins are shuffled.

Equality of n-grams is equality of 48 bits, so the chance that a pair gains one shared n-gram it does not have is below |x||y| / 2**48 (for two texts of 200,000 words, 0.00014),
and that a pair of postings is passed over by mistake 25 / 2**48.

Defined results
---------------
* Every row of the table gives one row.  Null and empty texts have no links and are a class of their own, named by their id.
* A text with words but fewer than n has one n-gram, all its words; one without any word is linked with its exact copies only.
* Rows are documents, also those that repeat an id or a whole row, and those with null ids: they are linked like any others.  The name of a class is the
  lowest id in it that is not null, or null.  Ties at the threshold are links.  Only id and text are read, so other columns cannot clash.
* An empty table gives no rows.  `deduplicate` keeps rows with null or empty texts, and of each class the row with the lowest id (null ids last, then the lowest text hash), once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import discard, slices, written

N = 3
THRESHOLD = 0.5
MOST_MATCHES = 4
BACK = 5
BUCKET_GRAMS = 1_000_000
FLUSH_GRAMS = 1_000_000
CHUNK_PAIRS = 1_000_000
TILE_PAIRS = 2_000_000
TILE_GRAMS = 8_000_000
LIST_DOCS = 8192
BROADCAST_ROWS = 1_000_000
HOT_SHARE = 1 << 20
HOT_LEAST = 50_000
LOCALLY = 4
_HEAD = np.dtype([("doc", "<i8"), ("n", "<u4"), ("m", "<u4"), ("need", "u1"), ("count", "<u4")])
_TOK = np.uint64((1 << 48) - 1)
_48 = np.uint64(48)
_32 = np.uint64(32)


def grams(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, ascending, and where each text's begin."""
    h, at = textops.words(texts)
    g, gd = textops.ngrams(h, at, n)
    return textops.unique_per_doc(g, gd, len(texts))


def set_hashes(g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set of n-grams; 0 where it is empty."""
    k1, k2 = (np.zeros(len(at) - 1, dtype=np.uint64) for _ in range(2))
    has = np.flatnonzero(np.diff(at))
    if len(has):
        size = np.diff(at)[has].astype(np.uint64)
        k1[has] = textops.mix64(np.add.reduceat(textops.mix64(g), at[has]) + size)
        k2[has] = textops.mix64(np.add.reduceat(textops.mix64(g ^ np.uint64(0x5851F42D4C957F2D)), at[has]) ^ size)
    return k1, k2


def frequency_code(df: np.ndarray) -> np.ndarray:
    """A document frequency in one byte that keeps the order: exact to 127, then in quarters of a doubling."""
    return np.where(df < 128, df, np.minimum(255, 128 + np.floor(4 * np.log2(np.maximum(df, 128) / 128.0)))).astype("u1")


def frequency(code: np.ndarray) -> np.ndarray:
    c = code.astype(np.int64)
    return np.where(c < 128, c, np.floor(128 * 2.0 ** ((c - 128) / 4.0))).astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    """48 bits of each number."""
    return np.ascontiguousarray(x.astype("<u8").view("u1").reshape(-1, 8)[:, :6]).tobytes()


def _unpack(x: bytes | pa.Buffer) -> np.ndarray:
    raw = np.frombuffer(x, "u1").reshape(-1, 6)
    out = np.zeros((len(raw), 8), dtype="u1")
    out[:, :6] = raw
    return out.view("<u8").ravel()


def _delta(x: np.ndarray) -> bytes:
    return np.diff(x, prepend=0).astype("<i8").tobytes()


def _undelta(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(x, "<i8"))


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1 and so on, `count` of them, one range after another."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _runs(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin, and the length of x."""
    return np.append(np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])), len(x)) if len(x) else np.zeros(1, dtype=np.int64)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def spark_hash(keys: np.ndarray) -> np.ndarray:
    """The hash by which Spark partitions ints (Murmur3 with seed 42)."""
    with np.errstate(over="ignore"):
        k = keys.astype(np.uint32) * np.uint32(0xCC9E2D51)
        k = ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
        h = np.uint32(42) ^ k
        h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return (h ^ (h >> np.uint32(16))).astype(np.int32)


def even_keys(parts: int) -> np.ndarray:
    """For each of `parts` buckets a number that Spark hashes to a partition of its own."""
    out = np.full(parts, -1, dtype=np.int64)
    at, step = 0, max(1024, 4 * parts)
    while (out < 0).any():
        k = np.arange(at, at + step)[::-1]
        where = spark_hash(k).astype(np.int64) % parts
        new = np.full(parts, -1, dtype=np.int64)
        new[where] = k  # the lowest, being last
        out = np.where(out < 0, new, out)
        at += step
    return out


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows with the same first column, which come together; the rest of each as a tuple, binary values as buffers that are not copied."""
    key, held = None, []
    for b in batches:
        cols = [[v.as_buffer() if v.is_valid else None for v in c] if pa.types.is_binary(c.type) else c.to_pylist() for c in b.columns]
        for row in zip(*cols, strict=True):
            if held and row[0] != key:
                yield key, held
                held = []
            key = row[0]
            held.append(row[1:])
    if held:
        yield key, held


def _grouped(df: DataFrame, parts: int, run: Callable, schema: str, key: str = "bucket") -> DataFrame:
    """Rows by bucket, one bucket (numbered by `even_keys`) to a partition."""
    return df.repartition(parts, key).sortWithinPartitions(key).mapInArrow(run, schema)


def _md5(text: str) -> tuple[Column, Column]:
    part = lambda at: F.conv(F.substring(F.md5(F.col(text)), at, 15), 16, 10).cast("long")
    return part(1), part(16)


def identities(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """A row (id, h1, h2, k1, k2, grams) for each of `docs`: hashes of the text and of its set of n-grams, null where there is no text; and rows with the
    n-grams that are frequent in a run of texts (toks, counts)."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.when(F.octet_length(text_col) > 0, F.col(text_col)).alias("t"))
    h1, h2 = _md5("t")
    names, schema = ["id", "h1", "h2", "k1", "k2", "grams", "toks", "counts"], "id long, h1 long, h2 long, k1 long, k2 long, grams long, toks binary, counts binary"
    kinds = [*[pa.int64()] * 6, pa.binary(), pa.binary()]

    def frequent(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, sizes, g = (np.concatenate([h[i] for h in held]) for i in range(3))
        first = np.unique(key, return_index=True)[1]  # equal sets count once
        if len(first) < len(key):
            g = g[_ranges((np.cumsum(sizes) - sizes)[first], sizes[first])]
        tok = np.sort(g & _TOK)
        r = _runs(tok)
        many = np.flatnonzero(np.diff(r) >= LOCALLY)
        return pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds[:6]), pa.array([_pack(tok[r[many]])], pa.binary()), pa.array([np.diff(r)[many].astype("<u4").tobytes()], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for b in batches:
            for begin, texts in slices(b, 1):
                g, at = grams(texts, n)
                k1, k2 = set_hashes(g, at)
                sizes = np.diff(at)
                ids, t, a, c = (b.column(i).slice(begin, len(texts)) for i in range(4))
                bare = sizes == 0  # a text without words is known by its bytes
                h = [x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, c)]
                k1 = np.where(bare, textops.mix64(h[0].view(np.uint64) + np.uint64(1)), k1)
                k2 = np.where(bare, textops.mix64(h[1].view(np.uint64) + np.uint64(2)), k2)
                gone = ~np.asarray(t.is_valid())
                keys = [pa.array(k.view(np.int64), mask=gone) for k in (k1, k2)]
                yield pa.RecordBatch.from_arrays([ids, a, c, *keys, pa.array(sizes), pa.nulls(len(texts), pa.binary()), pa.nulls(len(texts), pa.binary())], names=names)
                held.append((k1[~bare], sizes[~bare], g))
                total += len(g)
                if total >= FLUSH_GRAMS:
                    yield frequent(held)
                    held, total = [], 0
        if total:
            yield frequent(held)

    return base.select("id", "t", F.when(F.col("t").isNotNull(), h1).alias("h1"), F.when(F.col("t").isNotNull(), h2).alias("h2")).mapInArrow(run, schema)


def hot_grams(rows: DataFrame, total: int, least: int = HOT_LEAST) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that are counted at least `least` times, and by at least a `HOT_SHARE`-th of all, with their frequency codes; so there are at most `HOT_SHARE`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for toks, counts in zip(b.column(0), b.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(_unpack(toks.as_buffer()).view(np.int64)), pa.array(np.frombuffer(counts.as_buffer(), "<u4").astype(np.int64))], names=["tok", "c"])

    got = rows.where("toks IS NOT NULL").select("toks", "counts").mapInArrow(run, "tok long, c long").groupBy("tok").agg(F.sum("c").alias("c")).where(F.col("c") >= max(least, total // HOT_SHARE)).toArrow()
    tok, c = got["tok"].to_numpy().astype(np.uint64), got["c"].to_numpy()
    order = np.argsort(tok)
    return tok[order], frequency_code(c[order])


def _gram_rows(docs: DataFrame, n: int, buckets: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Packed n-grams of (id, t) by bucket; rows without `toks` have the sizes of documents, those with `codes` hot n-grams, both by document."""
    names, kinds = ["bucket", "ids", "counts", "toks", "codes"], [pa.int32(), *[pa.binary()] * 4]
    keys = even_keys(buckets)
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def flush(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, sizes, g = (np.concatenate([h[i] for h in held]) for i in range(3))
        first = np.unique(ids, return_index=True)[1]
        if len(first) < len(ids):  # repeated rows
            g = g[_ranges((np.cumsum(sizes) - sizes)[first], sizes[first])]
            ids, sizes = ids[first], sizes[first]
        doc = np.repeat(np.arange(len(ids)), sizes)
        rows: list[tuple] = []
        home = (textops.mix64(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        edges = _runs(home[order])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = order[a:b]
            rows.append((int(keys[home[own[0]]]), _delta(ids[own]), sizes[own].astype("<u4").tobytes(), None, None))
        toks, codes = shared.value
        if len(toks):
            t = g & _TOK
            k = np.minimum(np.searchsorted(toks, t), len(toks) - 1)
            hit = toks[k] == t
            if hit.any():
                t, code, d = t[hit], codes[k[hit]], doc[hit]
                order = np.argsort(home[d], kind="stable")
                t, code, d = t[order], code[order], d[order]
                edges = _runs(home[d])
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    r = _runs(d[a:b])
                    rows.append((int(keys[home[d[a]]]), _delta(ids[d[a:b][r[:-1]]]), np.diff(r).astype("<u4").tobytes(), _pack(t[a:b]), code[a:b].tobytes()))
                g, doc = g[~hit], doc[~hit]
        bucket = ((g >> _32) * np.uint64(buckets)) >> _32
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
        bucket, doc, tok = bucket[order], doc[order], g[order]
        edges = _runs(bucket)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            r = _runs(doc[a:b])
            rows.append((int(keys[int(bucket[a])]), _delta(ids[doc[a:b][r[:-1]]]), np.diff(r).astype("<u4").tobytes(), _pack(tok[a:b]), None))
        return _batch(rows, names, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for b in batches:
            ids = b.column(0).to_numpy()
            for begin, texts in slices(b, 1):
                g, at = grams(texts, n)
                sizes = np.diff(at)
                has = sizes > 0
                held.append((ids[begin : begin + len(texts)][has], sizes[has], g))
                total += len(g)
                if total >= FLUSH_GRAMS:
                    yield flush(held)
                    held, total = [], 0
        if total:
            yield flush(held)

    return docs.mapInArrow(run, "bucket int, ids binary, counts binary, toks binary, codes binary")


def _frequencies(rows: DataFrame, buckets: int, back: int) -> DataFrame:
    """From n-gram buckets to document buckets: the n-grams of more than one document with their document frequencies, the hot ones, and the sizes."""
    keys = even_keys(back)
    names, kinds = ["bucket", "ids", "counts", "toks", "dfs"], [pa.int32(), *[pa.binary()] * 4]

    def posted(doc: np.ndarray, tok: np.ndarray, code: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(doc, kind="stable")
        doc, tok, code = doc[order], tok[order], code[order]
        r = _runs(doc)
        count = np.diff(r)
        for k, own in _split(doc[r[:-1]], keys):
            pick = _ranges(r[own], count[own])
            yield k, _delta(doc[r[own]]), count[own].astype("<u4").tobytes(), _pack(tok[pick]), code[pick].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in by_key(batches):
            out: list[tuple] = []
            sized = [(_undelta(i), np.frombuffer(c, "<u4")) for i, c, t, _ in got if t is None]
            if sized:
                ids, sizes = (np.concatenate(x) for x in zip(*sized, strict=True))
                for k, own in _split(ids, keys):
                    out.append((k, _delta(ids[own]), sizes[own].tobytes(), None, None))
            hot = [(np.repeat(_undelta(i), np.frombuffer(c, "<u4")), _unpack(t), np.frombuffer(f, "u1")) for i, c, t, f in got if f is not None]
            if hot:
                doc, tok, code = (np.concatenate(x) for x in zip(*hot, strict=True))
                order = np.lexsort((tok, doc))
                doc, tok, code = doc[order], tok[order], code[order]
                keep = np.ones(len(tok), dtype=bool)
                keep[1:] = (tok[1:] != tok[:-1]) | (doc[1:] != doc[:-1])
                out.extend(posted(doc[keep], tok[keep], code[keep]))
            some = [(np.repeat(_undelta(i), np.frombuffer(c, "<u4")), _unpack(t)) for i, c, t, f in got if t is not None and f is None]
            del got
            if some:
                doc, tok = (np.concatenate(x) for x in zip(*some, strict=True))
                del some
                order = np.argsort(tok)
                s = tok[order]
                again = np.zeros(len(s), dtype=bool)
                again[1:] = s[1:] == s[:-1]
                again[:-1] |= again[1:]
                doc, tok = doc[order[again]], s[again]
                order = np.lexsort((doc, tok))
                doc, tok = doc[order], tok[order]
                keep = np.ones(len(tok), dtype=bool)
                keep[1:] = (tok[1:] != tok[:-1]) | (doc[1:] != doc[:-1])  # repeated rows
                doc, tok = doc[keep], tok[keep]
                df = np.diff(_runs(tok))
                df = np.repeat(df, df)
                out.extend(posted(doc[df > 1], tok[df > 1], frequency_code(df[df > 1])))
            if out:
                yield _batch(out, names, kinds)

    return _grouped(rows, buckets, run, "bucket int, ids binary, counts binary, toks binary, dfs binary")


def _split(ids: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Indices of ids by bucket."""
    k = keys[(textops.mix64(ids.astype(np.uint64) + np.uint64(1)) % np.uint64(len(keys))).astype(np.int64)]
    order = np.argsort(k, kind="stable")
    edges = _runs(k[order])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(k[order[a]]), order[a:b]


def prefixes(doc: np.ndarray, tok: np.ndarray, df: np.ndarray, size: np.ndarray, threshold: float, most: int) -> tuple[np.ndarray, ...]:
    """For postings in order of (document, frequency code, n-gram): where each document's begin, which documents can have a partner, their l and their prefix length.

    `size` is the size of each document's set; n-grams of one document only are not among the postings, and come first in the order.
    """
    at = _runs(doc)
    m = np.diff(at)
    least = np.ceil(threshold * size - 1e-9).astype(np.int64)
    able = m >= least
    cum = np.concatenate([[0], np.cumsum(frequency(df) - 1)])
    best = np.full(len(m), np.inf)
    need = np.ones(len(m), dtype=np.int64)
    top = np.maximum.reduceat(frequency(df), at[:-1]) if len(m) else np.zeros(0)
    for ell in range(1, most + 1):
        k = np.clip(m - least + ell, 0, m)
        shared = cum[at[:-1] + k] - cum[at[:-1]]
        # In microseconds: to compare postings; to count the rows that a partner sends, l at least; to verify candidates.  These are at most
        # shared / l, if each n-gram has other partners, and about as many as the longest list, if all have the same: in between, their geometric mean.
        cost = 0.15 * shared + 1.5 * ell * np.minimum(top, shared) + (1 + size / 1000) * np.sqrt(np.minimum(top, shared) * (shared / ell))
        better = (cost < best) & (ell <= least)
        best[better], need[better] = cost[better], ell
    return at, able, need, np.clip(m - least + need, 0, m)




def _choose(rows: DataFrame, back: int, buckets: int, threshold: float, most: int, list_docs: int = LIST_DOCS) -> DataFrame:
    """Sets (kind 0: doc, n, a) and prefix postings (kind 1: bucket, a, b, c)."""
    keys = even_keys(buckets)
    names = ["kind", "bucket", "doc", "n", "a", "b", "c"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in by_key(batches):
            some = [r for r in got if r[2] is not None]
            if not some:
                continue
            sized = [(_undelta(r[0]), np.frombuffer(r[1], "<u4")) for r in got if r[2] is None]
            ids, sizes = (np.concatenate(x) for x in zip(*sized, strict=True))
            ids, first = np.unique(ids, return_index=True)
            sizes = sizes[first].astype(np.int64)
            doc = np.concatenate([np.repeat(_undelta(r[0]), np.frombuffer(r[1], "<u4")) for r in some])
            tok = np.concatenate([_unpack(r[2]) for r in some])
            df = np.concatenate([np.frombuffer(r[3], "u1") for r in some])
            del got, some
            order = np.lexsort((tok, df, doc))
            doc, tok, df = doc[order], tok[order], df[order]
            n = sizes[np.searchsorted(ids, doc[_runs(doc)[:-1]])]
            at, able, need, length = prefixes(doc, tok, df, n, threshold, most)
            out: list[tuple] = []
            for i in np.flatnonzero(able).tolist():
                out.append((0, 0, int(doc[at[i]]), int(n[i]), _pack(np.sort(tok[at[i] : at[i + 1]])), None, None))
            own = np.flatnonzero(able & (length > 0))
            if len(own):
                count = length[own]
                who = np.repeat(np.arange(len(own)), count)
                step = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
                place = at[own][who] + step
                t = tok[place]
                before = np.zeros((len(t), BACK), dtype=np.uint64)
                for j in range(1, BACK + 1):
                    ok = step >= j
                    before[ok, j - 1] = t[np.flatnonzero(ok) - j]
                blocks = -(-frequency(df[place]) // list_docs)
                pick, t = _in_blocks(t, doc[at[own]][who], blocks)
                who, before = who[pick], before[pick]
                for k, pick in _split(t & _TOK, keys):
                    r = _runs(who[pick])
                    d = own[who[pick[r[:-1]]]]
                    head = np.zeros(len(d), dtype=_HEAD)
                    head["doc"], head["n"], head["m"], head["need"], head["count"] = doc[at[d]], n[d], at[d + 1] - at[d], need[d], np.diff(r)
                    out.append((1, k, None, None, head.tobytes(), t[pick].astype("<u8").tobytes(), _pack(before[pick].ravel())))
            for a in range(0, len(out), 4096):
                yield _batch(out[a : a + 4096], names, kinds)

    return _grouped(rows, back, run, "kind int, bucket int, doc long, n long, a binary, b binary, c binary")


def _in_blocks(tok: np.ndarray, doc: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Postings of n-grams whose documents are dealt into several blocks: which posting each is a copy of, and its list: 48 bits, and above them the side (1 or 2) in a list of two different blocks, else 0."""
    if not len(tok) or blocks.max() == 1:
        return np.arange(len(tok)), tok
    pick = np.repeat(np.arange(len(tok)), blocks)
    b = blocks[pick]
    other = _ranges(np.zeros(len(tok), dtype=np.int64), blocks)
    mine = (textops.mix64(doc.astype(np.uint64) ^ np.uint64(0xA24BAED4963EE407))[pick] % b.astype(np.uint64)).astype(np.int64)
    lo, hi = np.minimum(mine, other), np.maximum(mine, other)
    split = b > 1
    pair = (lo.astype(np.uint64) << _32) | hi.astype(np.uint64)
    t = np.where(split, textops.mix64(tok[pick] ^ textops.mix64(pair + np.uint64(1))) & _TOK, tok[pick])
    side = np.where(split & (lo != hi), np.where(mine == lo, 1, 2), 0).astype(np.uint64)
    return pick, t | (side << _48)


def candidate_pairs(head: np.ndarray, tok: np.ndarray, before: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(x, y, matches, code) of postings of one bucket that share an n-gram; no pair whose sizes rule it out, and none that has been emitted often enough.

    The code holds how many matches the pair needs, and below that, in six bits, the logarithm of its larger set, rounded up.
    """
    who = np.repeat(np.arange(len(head)), head["count"])
    order = np.argsort(tok & _TOK, kind="stable")
    tok, who, before = tok[order], who[order], before[order]
    side, tok = tok >> _48, tok & _TOK
    edges = _runs(tok)
    later = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(tok)) - 1
    cum = np.concatenate([[0], np.cumsum(later)])
    n, m, need, doc = head["n"].astype(np.int64), head["m"].astype(np.int64), head["need"].astype(np.int64), head["doc"]
    bits = np.ceil(np.log2(np.maximum(m, 1))).astype(np.int64)
    a = 0
    while a < len(tok):
        b = max(a + 1, int(np.searchsorted(cum, cum[a] + CHUNK_PAIRS, side="right")) - 1)
        for lo in range(0, int(cum[b] - cum[a]), CHUNK_PAIRS):  # one posting alone can have more
            k = np.arange(lo, min(lo + CHUNK_PAIRS, int(cum[b] - cum[a]))) + cum[a]
            i = np.searchsorted(cum, k, side="right") - 1
            j = i + 1 + (k - cum[i])
            x, y = who[i], who[j]
            least = np.ceil(threshold / (1 + threshold) * (n[x] + n[y]) - 1e-9)
            ok = (np.minimum(m[x], m[y]) >= least) & (doc[x] != doc[y]) & ((side[i] == 0) | (side[i] != side[j]))
            i, j, x, y = i[ok], j[ok], x[ok], y[ok]
            want = np.minimum(need[x], need[y])
            seen = np.zeros(len(x), dtype=np.int64)
            theirs = [before[j, q] for q in range(before.shape[1])]
            for p in range(before.shape[1]):
                u = before[i, p]
                hit = np.zeros(len(x), dtype=bool)
                for v in theirs:
                    hit |= u == v
                seen += hit & (u != 0)
            ok = seen < want
            x, y, want = x[ok], y[ok], want[ok]
            if len(x):
                code = want * 64 + np.maximum(bits[x], bits[y])
                lo_, hi_ = np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y])
                o = np.lexsort((hi_, lo_))
                lo_, hi_, code = lo_[o], hi_[o], code[o]
                new = np.append(np.flatnonzero(np.concatenate([[True], (lo_[1:] != lo_[:-1]) | (hi_[1:] != hi_[:-1])])), len(lo_))
                yield lo_[new[:-1]], hi_[new[:-1]], np.diff(new), code[new[:-1]]
        a = b


def _candidates(rows: DataFrame, buckets: int, threshold: float) -> DataFrame:
    """(x, y, bits) of the pairs to verify; neither set has more than 2**bits n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in by_key(batches):
            head = np.concatenate([np.frombuffer(r[0], _HEAD) for r in got])
            tok = np.concatenate([np.frombuffer(r[1], np.uint64) for r in got])
            before = np.concatenate([_unpack(r[2]).reshape(-1, BACK) for r in got])
            del got
            for x, y, c, code in candidate_pairs(head, tok, before, threshold):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(c, pa.int32()), pa.array(code, pa.int32())], names=["x", "y", "c", "code"])

    found = _grouped(rows.where("kind = 1").select("bucket", "a", "b", "c"), buckets, run, "x long, y long, c int, code int")
    return found.groupBy("x", "y").agg(F.sum("c").alias("c"), F.max("code").alias("code")).where("c >= shiftright(code, 6)").select("x", "y", F.expr("code & 63").alias("bits"))


def overlaps(x: np.ndarray, y: np.ndarray, at: np.ndarray, tok: np.ndarray, width: int) -> np.ndarray:
    """How many n-grams the sets x and y share, pair by pair; set i is ``tok[at[i]:at[i + 1]]``, of numbers below `width`."""
    lens = np.diff(at)
    ux, ix = np.unique(x, return_inverse=True)
    uy, iy = np.unique(y, return_inverse=True)
    if width <= 1 << 16 and len(ux) * len(uy) <= 1 << 24 and len(ux) * len(uy) * width <= 40 * int(lens[y].sum()):
        # nearly all pairs of a few sets that are much alike: a product of matrices
        dense = np.zeros((len(ux), len(uy)), dtype=np.float32)
        for b in range(0, len(uy), 256):
            right = _ones(uy[b : b + 256], at, tok, width)
            for a in range(0, len(ux), 256):
                dense[a : a + 256, b : b + 256] = _ones(ux[a : a + 256], at, tok, width) @ right.T
        return dense[ix, iy].astype(np.int64)
    out = np.zeros(len(x), dtype=np.int64)
    here = np.zeros(width, dtype=bool)
    order = np.argsort(x, kind="stable")
    edges = _runs(x[order])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        mine = tok[at[x[order[a]]] : at[x[order[a]] + 1]]
        here[mine] = True
        for lo in range(a, b, 256):
            pick = order[lo : min(b, lo + 256)]
            ys = y[pick]
            count = lens[ys]
            out[pick] = np.add.reduceat(here[tok[_ranges(at[ys], count)]].astype(np.int64), np.cumsum(count) - count)
        here[mine] = False
    return out


def _ones(sets: np.ndarray, at: np.ndarray, tok: np.ndarray, width: int) -> np.ndarray:
    count = (at[1:] - at[:-1])[sets]
    out = np.zeros((len(sets), width), dtype=np.float32)
    out[np.repeat(np.arange(len(sets)), count), tok[_ranges(at[sets], count)]] = 1
    return out


class _Parts:
    """Sets and pairs of consecutive parts, verified many at a time."""

    def __init__(self, threshold: float, listed: bool) -> None:
        self.threshold, self.listed, self.part, self.sets, self.pairs = threshold, listed, 0, [], []
        self.grams = self.asked = 0

    def add_sets(self, b: pa.RecordBatch, lo: int, hi: int) -> None:
        col = b.column(5)
        ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset + lo : col.offset + hi + 1]
        data = np.frombuffer(col.buffers()[2], "u1")[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, "u1")
        doc, n, w = (b.column(i).slice(lo, hi - lo).to_numpy().copy() for i in (3, 4, 6))
        self.sets.append((np.full(hi - lo, self.part), doc, n, w, np.diff(ends) // 6, _unpack(data)))
        self.grams += len(data) // 6

    def add_pairs(self, x: np.ndarray, y: np.ndarray) -> None:
        self.pairs.append((np.full(len(x), self.part), x.copy(), y.copy()))
        self.asked += len(x)

    def verify(self, last: bool) -> Iterator[pa.RecordBatch]:
        """What the pairs so far give: of each document its links and the least that it is connected with; or the pairs that are similar enough.  Unless `last`, the sets of the part at hand stay."""
        if self.pairs:
            part, doc, n, w, lens, tok = (np.concatenate(c) for c in zip(*self.sets, strict=True))
            p, x, y = (np.concatenate(c) for c in zip(*self.pairs, strict=True))
            names, who = np.unique(doc, return_inverse=True)
            key = part * len(names) + who
            x, y = (np.searchsorted(key, p * len(names) + np.searchsorted(names, v)) for v in (x, y))
            at = np.concatenate([[0], np.cumsum(lens)])
            c = np.zeros(len(x), dtype=np.int64)
            edges = _runs(p)
            big = np.flatnonzero(np.diff(edges) >= 4096).tolist()
            rest = np.ones(len(p), dtype=bool)
            jobs = []
            for e in big:
                rest[edges[e] : edges[e + 1]] = False
                jobs.append(np.arange(edges[e], edges[e + 1]))
            jobs.append(np.flatnonzero(rest))
            for own in jobs:
                if not len(own):
                    continue
                used = np.unique(np.concatenate([x[own], y[own]]))
                own_tok, own_lens = tok[_ranges(at[used], lens[used])], lens[used]
                values, local, times = np.unique(own_tok, return_inverse=True, return_counts=True)
                keep = times[local] > 1  # an n-gram of one set only is no overlap
                number = np.cumsum(times > 1) - 1
                own_at = np.concatenate([[0], np.cumsum(np.add.reduceat(keep.astype(np.int64), np.cumsum(own_lens) - own_lens))])
                c[own] = _overlaps_of(np.searchsorted(used, x[own]), np.searchsorted(used, y[own]), own_at, number[local[keep]], int((times > 1).sum()))
            j = c / (n[x] + n[y] - c)
            ok = j >= self.threshold - 1e-12
            x, y = x[ok], y[ok]
            if self.listed:
                yield pa.RecordBatch.from_arrays([pa.array(doc[x]), pa.array(doc[y]), pa.array(j[ok])], names=["x", "y", "jaccard"])
            else:
                links = np.zeros(len(names), dtype=np.int64)
                np.add.at(links, who[x], w[y])
                np.add.at(links, who[y], w[x])
                root = labels(len(names), who[x], who[y])
                has = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(names[has]), pa.array(links[has]), pa.array(names[root[has]])], names=["doc", "links", "root"])
        self.pairs, self.asked = [], 0
        if last:
            self.sets, self.grams = [], 0
        else:
            self.sets = [s for s in self.sets if s[0][0] == self.part]
            self.grams = sum(len(s[5]) for s in self.sets)


def _overlaps_of(x: np.ndarray, y: np.ndarray, at: np.ndarray, tok: np.ndarray, width: int) -> np.ndarray:
    """As `overlaps`, where some sets may be empty."""
    some = (np.diff(at)[x] > 0) & (np.diff(at)[y] > 0)
    out = np.zeros(len(x), dtype=np.int64)
    if some.any():
        out[some] = overlaps(x[some], y[some], at, tok, width)
    return out


def labels(size: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of `size` numbers the least that the pairs connect it with."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[x], label[y])
        if (label[x] == low).all() and (label[y] == low).all():
            return label
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label != label[label]).any():
            label = label[label]


def _verified(sets: DataFrame, pairs: DataFrame, weights: DataFrame, parts: int, threshold: float, broadcast_rows: int, tile_pairs: int, tile_grams: int, listed: bool) -> DataFrame:
    """(doc, links, root) for each part that a document has links in; or, if they are to be listed, (x, y, jaccard) of the pairs that are similar enough."""
    small = lambda df: df.hint("broadcast" if df.count() <= broadcast_rows else "merge")
    both = pairs.select("x", "y").unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    lowest = written(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("tile")), "lowest")
    at = tiles = written(pairs.join(small(lowest), "x").select("tile", "x", "y", "bits"), "tiles")
    ends = lambda df, *also: df.select("tile", *also, F.col("x").alias("doc"), "bits").unionByName(df.select("tile", *also, F.col("y").alias("doc"), "bits"))
    weighted = lambda df: df.join(small(weights), df.doc == weights.key, "left").withColumn("w", F.coalesce("m", F.lit(1)).cast("long")).drop("key", "m")
    members = need = written(weighted(ends(at).groupBy("tile", "doc").agg(F.max("bits").alias("bits"))), "members")
    # Large tiles are fewer than the pairs and n-grams by the factors of the bounds.
    held = members.groupBy("tile").agg(F.count("*").alias("k"), F.max("bits").alias("bits"))
    grid = F.least(F.greatest(F.ceil(F.sqrt(F.col("c") / tile_pairs)), F.ceil(2 * F.col("k") * F.pow(F.lit(2.0), F.col("bits")) / tile_grams)), F.col("k"))
    large = written(at.groupBy("tile").agg(F.count("*").alias("c")).join(held, "tile").select("tile", grid.cast("long").alias("grid")).where("grid > 1"), "large-tiles")
    if large.isEmpty():
        at, need = (df.withColumn("part", F.lit(0).cast("long")) for df in (at, members))
    else:
        block = lambda v: F.pmod(F.xxhash64(v), F.col("grid"))
        at = at.join(small(large), "tile", "left").withColumn("part", F.coalesce(block("x") * F.col("grid") + block("y"), F.lit(0)))
        whole = members.join(small(large), "tile", "left_anti").select("tile", F.lit(0).cast("long").alias("part"), "doc", "w")
        need = written(whole.unionByName(weighted(ends(at.where("grid IS NOT NULL"), "part").select("tile", "part", "doc").distinct()).select("tile", "part", "doc", "w")), "needed")
    few = need.count() <= broadcast_rows
    own = sets.join(need.hint("broadcast" if few else "shuffle_hash"), "doc").select("tile", "part", F.lit(0).alias("k"), "doc", "n", "a", "w")
    none = F.lit(None)
    rows = own.unionByName(at.select("tile", "part", F.lit(1).alias("k"), F.col("x").alias("doc"), F.col("y").alias("n"), none.cast("binary").alias("a"), none.cast("long").alias("w")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, _Parts(threshold, listed)
        for b in batches:
            if not b.num_rows:
                continue
            tile, part, k = (b.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((tile[1:] != tile[:-1]) | (part[1:] != part[:-1]) | (k[1:] != k[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if (tile[lo], part[lo]) != now:
                    if held.asked >= CHUNK_PAIRS // 50 or held.grams >= tile_grams // 2:
                        yield from held.verify(True)
                    now = tile[lo], part[lo]
                    held.part += 1
                if k[lo] == 0:
                    held.add_sets(b, lo, hi)
                else:
                    held.add_pairs(b.column(3).to_numpy()[lo:hi], b.column(4).to_numpy()[lo:hi])
                    if held.asked >= CHUNK_PAIRS:
                        yield from held.verify(False)
        yield from held.verify(True)

    schema = "x long, y long, jaccard double" if listed else "doc long, links long, root long"
    out = written(rows.repartition(max(parts, -(-pairs.count() // tile_pairs)), "tile", "part").sortWithinPartitions("tile", "part", "k", "doc", "n").mapInArrow(run, schema), "verified")
    discard(lowest, tiles, members, large)
    if need is not members and hasattr(need, "_written_to"):
        discard(need)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in `edges` (x, y): root is the lowest id it is connected with.  Large-star and small-star rounds until nothing changes; a hub costs one row a task."""
    now = written(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct(), "edges")
    count = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = count(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = written(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        then = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        discard(now, large)
        now = then
        state = count(now)
        if state == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        before = state


@dataclass
class Classes:
    """The rows of a table and the classes of rows with equal sets of n-grams."""

    rows: DataFrame  # id, h1, h2, k1, k2, grams
    sets: DataFrame  # k1, k2, m rows, grams; the row that stands for them (id, h1, h2) and its key: its id, or a number that is no id where an id does not tell
    apart: DataFrame  # id, h1, h2, key: rows that are not to be compared (key null), and those whose key is not their id
    hot: tuple[np.ndarray, np.ndarray]
    grams: int
    repeated: bool  # whether any id is null or that of several rows


def classes(docs: DataFrame, id_col: str, text_col: str, n: int, broadcast_rows: int, hot_least: int) -> Classes:
    small = lambda df: df.hint("broadcast" if df.count() <= broadcast_rows else "merge")
    all_rows = written(identities(docs, id_col, text_col, n), "identities")
    rows = all_rows.where("toks IS NULL").drop("toks", "counts")
    total, low, top = rows.agg(F.sum("grams"), F.min("id"), F.max("id")).first()
    hot = hot_grams(all_rows, total or 0, hot_least)
    own = rows.where("k1 IS NOT NULL")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h1", "h2")).alias("r")
    sets = own.groupBy("k1", "k2").agg(F.count("*").alias("m"), F.max("grams").alias("grams"), first).select("k1", "k2", "m", "grams", "r.id", "r.h1", "r.h2")
    sets = written(sets, "sets")
    repeated = written(own.groupBy("id").count().where("count > 1 OR id IS NULL").select(F.col("id").alias("i")), "repeated-ids")
    if repeated.isEmpty():
        sets, named = sets.withColumn("key", F.col("id")), None
    else:
        free = (top or 0) < 1 << 62 or (low or 0) > -(1 << 62)
        # numbers above or below all ids; where ids are at both ends, all classes are numbered anew
        doubtful = sets.join(small(repeated), F.col("id").eqNullSafe(F.col("i")), "left_semi") if free else sets
        number = F.monotonically_increasing_id()
        key = number + ((top or 0) + 1) if (top or 0) < 1 << 62 else -number + ((low or 0) - 1) if free else number
        named = written(doubtful.select("k1", "k2", "id", "h1", "h2", key.alias("key")), "named")
        sets = sets.join(small(named.select("k1", "k2", "key")), ["k1", "k2"], "left").withColumn("key", F.coalesce("key", "id"))
    several = sets.where("m > 1").select("k1", "k2", F.struct("id", "h1", "h2").alias("r"))
    other = own.join(small(several), ["k1", "k2"]).where(~(F.col("id").eqNullSafe(F.col("r.id")) & (F.col("h1") == F.col("r.h1")) & (F.col("h2") == F.col("r.h2")))).select("id", "h1", "h2", F.lit(None).cast("long").alias("key")).distinct()
    apart = written(other if named is None else other.unionByName(named.select("id", "h1", "h2", "key")), "apart")
    return Classes(rows, sets, apart, hot, sets.agg(F.sum("grams")).first()[0] or 0, named is not None)


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["__id__"].eqNullSafe(b["id"]) & (a["__h1__"] == b["h1"]) & (a["__h2__"] == b["h2"])


def _similar(docs: DataFrame, id_col: str, text_col: str, c: Classes, n: int, threshold: float, most_matches: int, bucket_grams: int, broadcast_rows: int, tile_pairs: int, tile_grams: int, list_docs: int, listed: bool) -> DataFrame:
    base = docs.select(F.col(id_col).cast("long").alias("__id__"), F.col(text_col).alias("t")).where("t <> ''")
    h1, h2 = _md5("t")
    apart = c.apart.withColumn("__apart__", F.lit(True))
    few = apart.count() <= broadcast_rows
    base = base.withColumns({"__h1__": h1, "__h2__": h2})
    rest = base.join(apart.hint("broadcast" if few else "shuffle_hash"), _same(base, apart), "left").where("__apart__ IS NULL OR key IS NOT NULL").select(F.coalesce("key", "__id__").alias("id"), "t")
    buckets = max(1, -(-c.grams // bucket_grams))
    back, third, parts = max(1, -(-buckets // 3)), max(1, -(-buckets // 8)), max(1, -(-buckets // 8))
    chosen = written(_choose(_frequencies(_gram_rows(rest, n, buckets, c.hot), buckets, back), back, third, threshold, most_matches, list_docs), "prefixes")
    pairs = written(_candidates(chosen, third, threshold), "candidates")
    weights = c.sets.where("m > 1").select("key", "m")
    out = _verified(chosen.where("kind = 0").select("doc", "n", "a"), pairs, weights, parts, threshold, broadcast_rows, tile_pairs, tile_grams, listed)
    discard(chosen, pairs)
    return out


def _checked(threshold: float, n: int, most_matches: int) -> None:
    if not 0 < threshold <= 1 or n < 1 or most_matches < 1:
        raise ValueError("threshold must be in (0, 1], n and most_matches at least 1")


def pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, most_matches: int = MOST_MATCHES, bucket_grams: int = BUCKET_GRAMS, broadcast_rows: int = BROADCAST_ROWS, tile_pairs: int = TILE_PAIRS, tile_grams: int = TILE_GRAMS, list_docs: int = LIST_DOCS, hot_least: int = HOT_LEAST) -> tuple[DataFrame, DataFrame]:
    """(x, y, jaccard) of the similar pairs of classes of rows with equal sets, and (key, id) of every row with words or marks: its class, and its id.

    Where no id is null or repeated, the key of a class is its lowest id.
    """
    _checked(threshold, n, most_matches)
    c = classes(docs, id_col, text_col, n, broadcast_rows, hot_least)
    found = _similar(docs, id_col, text_col, c, n, threshold, most_matches, bucket_grams, broadcast_rows, tile_pairs, tile_grams, list_docs, True)
    return found, c.rows.join(c.sets.select("k1", "k2", "key"), ["k1", "k2"]).select("key", "id")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, most_matches: int = MOST_MATCHES, bucket_grams: int = BUCKET_GRAMS, broadcast_rows: int = BROADCAST_ROWS, tile_pairs: int = TILE_PAIRS, tile_grams: int = TILE_GRAMS, list_docs: int = LIST_DOCS, hot_least: int = HOT_LEAST) -> tuple[Classes, DataFrame, bool]:
    """The rows of `docs`; (k1, k2, links, class_id, first) of the sets that have links: their number, the name of the class, and its first row (none, id, h1, h2); and whether those are few."""
    _checked(threshold, n, most_matches)
    c = classes(docs, id_col, text_col, n, broadcast_rows, hot_least)
    found = _similar(docs, id_col, text_col, c, n, threshold, most_matches, bucket_grams, broadcast_rows, tile_pairs, tile_grams, list_docs, False)
    roots = components(found.where("doc <> root").select(F.col("doc").alias("x"), F.col("root").alias("y")))
    linked = found.groupBy("doc").agg(F.sum("links").alias("links")).join(roots, F.col("doc") == F.col("id"), "left").select(F.col("doc").alias("key"), "links", "root")
    some = c.sets.join(linked.hint("broadcast" if found.count() <= broadcast_rows else "merge"), "key", "left").where("m > 1 OR links IS NOT NULL")
    some = written(some.select("k1", "k2", "id", "h1", "h2", F.coalesce("root", "key").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links")), "some")
    names = some.groupBy("root").agg(F.min("id").alias("class_id"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h1", "h2")).alias("first"))
    discard(found)
    return c, some.join(names, "root").select("k1", "k2", "links", "class_id", "first"), some.count() <= broadcast_rows


def join(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """(doc_id, class_id, links) of every row: the lowest id that similarity connects it with, and how many other rows are similar to it."""
    c, found, few = groups(docs, broadcast_rows=broadcast_rows, **options)
    alone = F.col("id").alias("class_id"), F.lit(0).cast("long").alias("links")
    own = c.rows.where("k1 IS NOT NULL").join(found.hint("broadcast" if few else "merge"), ["k1", "k2"], "left")
    own = own.select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return own.unionByName(c.rows.where("k1 IS NULL").select(F.col("id").alias("doc_id"), *alone))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """`docs` with one document of each class, all columns kept."""
    c, found, few = groups(docs, id_col=id_col, text_col=text_col, broadcast_rows=broadcast_rows, **options)
    small = lambda df: df.hint("broadcast" if df.count() <= broadcast_rows else "shuffle_hash")
    own = c.rows.join(found.hint("broadcast" if few else "merge"), ["k1", "k2"])
    first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h1") == F.col("first.h1")) & (F.col("h2") == F.col("first.h2"))
    gone = written(own.where(~first).select("id", "h1", "h2").distinct(), "superseded")
    h1, h2 = _md5(text_col)
    keyed = docs.withColumns({"__id__": F.col(id_col).cast("long"), "__h1__": h1, "__h2__": h2})
    kept = keyed.join(small(gone), _same(keyed, gone), "left_anti")
    again = written(own.where(first).groupBy("id", "h1", "h2").count().where("count > 1").drop("count"), "again") if c.repeated else None
    if again is not None and not again.isEmpty():  # rows that repeat the one that stays
        one = kept.join(small(again), _same(kept, again), "left_semi").dropDuplicates(["__id__", "__h1__", "__h2__"])
        kept = kept.join(small(again), _same(kept, again), "left_anti").unionByName(one)
    return kept.drop("__id__", "__h1__", "__h2__")


#: Words as the hashes see them, n-grams of a text with fewer than three words as its words, every pair of different texts counted by brute force, and classes by reachability.
SQL = r"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS x, text, m, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w
  FROM (SELECT text, count(*) AS m FROM documents WHERE text <> '' GROUP BY text)
), g AS (
  SELECT DISTINCT x, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS g FROM t
), n AS (
  SELECT x, count(*) AS n FROM g GROUP BY x
), c AS (
  SELECT a.x, b.x AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.x <> b.x GROUP BY 1, 2
), s AS (
  SELECT c.x, c.y FROM c JOIN n a ON a.x = c.x JOIN n b ON b.x = c.y WHERE c.c * 1.0 / (a.n + b.n - c.c) >= 0.5
), r(x, y) AS (
  SELECT x, x FROM t UNION SELECT r.x, s.y FROM r JOIN s ON r.y = s.x
), lowest AS (
  SELECT r.x, min(d.doc_id) AS class_id FROM r JOIN t ON t.x = r.y JOIN documents d ON d.text = t.text GROUP BY r.x
), l AS (
  SELECT s.x, sum(t.m) AS links FROM s JOIN t ON t.x = s.y GROUP BY s.x
)
SELECT d.doc_id, coalesce(lowest.class_id, d.doc_id) AS class_id, (coalesce(l.links, 0) + coalesce(t.m - 1, 0))::BIGINT AS links
FROM documents d LEFT JOIN t ON t.text = d.text LEFT JOIN lowest ON lowest.x = t.x LEFT JOIN l ON l.x = t.x
"""
