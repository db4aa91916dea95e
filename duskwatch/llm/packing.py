"""Hierarchical multi-length packing.

Documents are routed to the smallest context tier that holds them; one longer than the largest
tier is cut into whole windows of that tier and a rest.  Tiers are packed from the largest down:
its own pieces first, longest first, each into the open window that it leaves least room in; then
the gaps of those windows are filled from the shorter tiers, each time with the longest piece that
fits.  What is left of a shorter tier is packed the same way.  The windows of a tier are dealt into
step groups of equal tokens, dearest attention (sum of squared lengths) first, back and forth, so that
every step of a training run costs about the same.

Plan: only (id, length) rows move.  Rows that are equal in both are counted before they are shuffled, and dealt out again in runs of at most `RUN`; runs are hashed into shards of about
`shard_docs` rows, which are packed independently.  So the work is linear in the corpus and a shard's state is bounded, also where ids are null or repeated.

Defined results
---------------
* Length is the UTF-8 bytes of the text plus one for the separator (the exact count for a byte-level
  vocabulary), or `length`, any column of token counts.
* Null and empty texts, and null or non-positive lengths, hold no tokens and are left out.
* Every other row is packed whole, once: repeated rows and ids each have their own piece; a null id sorts after all ids (any long may be one)
  and stays null.  Ties go by id, then by position within the document.
* An empty table gives no rows.  Only the columns below are returned, so other columns cannot clash.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIERS = (2048, 8192, 32768, 131072)
STEP_TOKENS = 524288
SHARD_DOCS = 50_000
SCHEMA = "shard int, tier int, window int, step_group int, window_offset int, doc_id long, piece_start long, piece_len int"
RUN = 64
Key = tuple[bool, int]


def cut(rows: list[tuple[int | None, int]], largest: int) -> list[tuple[int, Key, int]]:
    """(length, id, start) of each piece, where an id is (whether it is null, itself)."""
    out = []
    for i, n in rows:
        key = (i is None, i or 0)
        for start in range(0, n, largest):
            out.append((min(largest, n - start), key, start))
    return out


class _Pool:
    """Unpacked pieces by length; gives the longest that is no longer than a gap."""

    def __init__(self) -> None:
        self.by: dict[int, list[tuple[Key, int]]] = {}
        self.lengths: list[int] = []

    def add(self, pieces: list[tuple[int, Key, int]]) -> None:
        for n, i, s in sorted(pieces, key=lambda p: (p[1], p[2]), reverse=True):  # popped from the end
            self.by.setdefault(n, []).append((i, s))
        self.lengths = sorted(self.by)

    def take(self, most: int) -> tuple[int, Key, int] | None:
        k = bisect_left(self.lengths, most + 1) - 1
        if k < 0:
            return None
        n = self.lengths[k]
        i, s = self.by[n].pop()
        if not self.by[n]:
            del self.by[n]
            del self.lengths[k]
        return n, i, s

    def rest(self) -> list[tuple[int, Key, int]]:
        return [(n, i, s) for n, own in self.by.items() for i, s in own]


def pack(rows: list[tuple[int | None, int]], tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> list[tuple]:
    """(tier, window, step_group, offset, id, start, length) of each piece of one shard."""
    tiers = tuple(sorted(tiers))
    by: dict[int, list[tuple[int, Key, int]]] = {t: [] for t in tiers}
    for p in cut(rows, tiers[-1]):
        by[tiers[bisect_left(tiers, p[0])]].append(p)
    out = []
    for level in range(len(tiers) - 1, -1, -1):
        cap = tiers[level]
        windows: list[list[tuple[int, Key, int]]] = []
        open_: list[tuple[int, int]] = []  # (room, window)
        for p in sorted(by[cap], key=lambda p: (-p[0], p[1], p[2])):
            k = bisect_left(open_, (p[0], -1))
            if k < len(open_):
                room, w = open_.pop(k)
                windows[w].append(p)
            else:
                room, w = cap, len(windows)
                windows.append([p])
            insort(open_, (room - p[0], w))
        pools = []
        for t in tiers[:level][::-1]:
            pool = _Pool()
            pool.add(by[t])
            pools.append(pool)
        for room, w in sorted(open_, key=lambda x: x[1]):
            for pool in pools:
                while room and (p := pool.take(room)):
                    windows[w].append(p)
                    room -= p[0]
        for t, pool in zip(tiers[:level][::-1], pools, strict=True):
            by[t] = pool.rest()
        per = max(1, step_tokens // cap)
        groups = -(-len(windows) // per)
        order = sorted(range(len(windows)), key=lambda w: (-sum(n * n for n, _, _ in windows[w]), w))
        for rank, w in enumerate(order):
            turn, g = divmod(rank, groups)
            g = g if turn % 2 == 0 else groups - 1 - g
            offset = 0
            for n, i, s in windows[w]:
                out.append((cap, w, g, offset, None if i[0] else i[1], s, n))
                offset += n
    return out


def pack_documents(docs: DataFrame, length: Column | None = None, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The packing manifest of `docs`: one row for each piece, saying where in which window it lies."""
    if not tiers or min(tiers) < 1:
        raise ValueError("tiers must be positive lengths")
    size = length if length is not None else F.when(F.octet_length(text_col) > 0, F.octet_length(text_col) + 1)
    # Equal rows count once in the shuffle and come back in runs, so that many of them fill many shards.
    equal = docs.select(F.col(id_col).cast("long").alias("id"), size.cast("long").alias("n")).where("n > 0").groupBy("id", "n").agg(F.count("*").alias("c"))
    shards = max(1, -(-docs.count() // shard_docs))
    runs = equal.select("id", "n", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(c - 1) div {RUN}"))).alias("r")).select("id", "n", "r", F.least(F.lit(RUN), F.col("c") - F.col("r") * RUN).cast("int").alias("c"))
    rows = runs.select(F.pmod(F.xxhash64("id", "n", "r"), F.lit(shards)).cast("int").alias("shard"), "id", "n", "c")

    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        got = pack([(i, n) for i, n, c in zip(*(table[x].to_pylist() for x in ("id", "n", "c")), strict=True) for _ in range(c)], tiers, step_tokens)
        cols = list(zip(*got, strict=True))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        arrays = [pa.array([shard] * len(got), pa.int32()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
        return pa.Table.from_arrays(arrays, names=["shard", "tier", "window", "step_group", "window_offset", "doc_id", "piece_start", "piece_len"])

    return rows.groupBy("shard").applyInArrow(run, SCHEMA)
