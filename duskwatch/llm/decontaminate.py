"""Benchmark decontamination by template canonicalisation.

Texts are cut into words and numbers and put into two forms.  In the plain form a token stands for itself.  In the template form
numbers (digits, or number words), names (capitalised words within a sentence, runs of them as one, and the same words at
the start of a sentence) and units (after a number) become typed placeholders.  Windows of `window` tokens are hashed and joined with the
windows of the benchmark.  Windows of one item that lie close together in a document are taken together: an item is found when its windows cover
`min_cover` of its tokens, in the plain form (``verbatim``) or in the template form (``reparameterised``).  In the latter the slots must
be consistent: each value of a slot in the item corresponds to one value in the document and the other way round, and units keep their dimension, for
`min_consistency` of the aligned slots; so a question with other numbers and names is caught and a chance likeness is not.

Plan: a broadcast hash join, probed in Arrow batches, in one pass over the documents and without a shuffle.  The benchmark side is collected
in parts of about `part_items` items and `part_bytes` of text, each broadcast by itself, so what is broadcast is bounded; a benchmark beyond that costs a
pass over the documents for each part.  The windows of a slice of documents are hashed once for each window size, however many items are found in it.

Defined results
---------------
* Null and empty texts contain nothing and are contained in nothing.  An item of fewer than `window` tokens is one window of all its tokens;
  one of one or two tokens is found only where it is the whole document (verbatim), since such words stand in clean texts too; one without any token nowhere.
* Slots are aligned by votes: of the values that a slot's value meets, the most frequent one is its counterpart, ties by (kind, value in the item, value in the document) in order of bytes.
* Template windows of more than half placeholders, or of none, are not used.
* Repeated documents give their rows each, equal items (id and text) count once, the texts of one id are items of their own, and a null item id is reported as null; a null doc id is carried along.
* An empty benchmark finds nothing.  Only ids and texts are read, so other columns cannot clash; `clean` passes the rest through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import slices

WINDOW = 8
MIN_COVER = 0.5
MIN_CONSISTENCY = 0.8
PART_ITEMS = 100_000
PART_BYTES = 16 << 20
WORD, NUM, UNIT, NAME = range(4)
SCHEMA = "doc_id long, item_id long, kind string, coverage double, slots int, consistency double"
UNITS = {
    "length": "mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters",
    "mass": "mg g kg gram grams kilogram kilograms pound pounds lb lbs oz ounce ounces ton tons tonne tonnes",
    "time": "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years",
    "volume": "ml l liter liters litre litres gallon gallons pint pints cup cups",
    "money": "dollar dollars cent cents euro euros usd eur gbp yen rupee rupees",
    "share": "percent percentage pct",
    "speed": "mph kph kmh knots",
    "power": "w kw mw watt watts kilowatt kilowatts hp",
    "heat": "celsius fahrenheit kelvin degrees degree",
    "data": "b kb mb gb tb byte bytes bits",
}
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice thrice"
NO_NAMES = "i a the an and or but if in on at of to for with"
DIMENSION = {u: d for d, us in UNITS.items() for u in us.split()}
_U = np.uint64


def _hashes(words: str) -> np.ndarray:
    return np.sort(textops.words([words])[0])


_UNIT_H, _NUMBER_H, _NO_NAME_H = _hashes(" ".join(DIMENSION)), _hashes(NUMBER_WORDS), _hashes(NO_NAMES)
_CLASS = np.zeros(256, dtype=np.int8)
_CLASS[48:58] = 1
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 2
_ENDS = np.zeros(256, dtype=np.int8)
_ENDS[list(b".!?:;\n\"(")] = 1
_HOLDER = textops.mix64(np.arange(1, 5, dtype=_U) * _U(0x9E3779B97F4A7C15))


@dataclass
class Forms:
    """Both forms of a list of texts."""

    low: np.ndarray  # bytes, lower case
    plain: np.ndarray  # token hashes
    plain_doc: np.ndarray
    plain_begin: np.ndarray
    template: np.ndarray
    template_doc: np.ndarray
    kind: np.ndarray  # of template tokens
    begin: np.ndarray
    end: np.ndarray

    def value(self, i: int) -> bytes:
        """The text of a template token."""
        return self.low[self.begin[i] : self.end[i]].tobytes()


def forms(texts: list[str | None]) -> Forms:
    buf, at = textops.join(textops.encode(texts, lower=False))
    cls = _CLASS[buf]
    mark = np.flatnonzero((buf == 46) | (buf == 44))
    mark = mark[(mark > 0) & (mark < len(buf) - 1)]
    cls[mark[(cls[mark - 1] == 1) & (cls[mark + 1] == 1)]] = 1  # a point or comma within a number
    low = buf.copy()
    up = (buf >= 65) & (buf <= 90)
    latin = np.zeros(len(buf), dtype=bool)
    latin[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    low[up | latin] += 32
    cap = up.copy()
    cap[:-1] |= latin[1:]
    edge = np.concatenate([[0], cls]), np.concatenate([cls, [0]])
    turn = np.flatnonzero(edge[0] != edge[1])
    s = turn[edge[1][turn] > 0]
    e = turn[edge[0][turn] > 0]
    if not len(s):
        none = np.zeros(0, dtype=np.int64)
        return Forms(low, none.astype(_U), none, none, none.astype(_U), none, none, none, none)
    h = textops.span_hashes(low, s, e)
    doc = np.searchsorted(at, s, side="right") - 1
    kind = np.zeros(len(s), dtype=np.int8)
    kind[(cls[s] == 1) | np.isin(h, _NUMBER_H)] = NUM
    unit = np.isin(h, _UNIT_H)
    unit[0] = False
    unit[1:] &= (kind[:-1] == NUM) & (doc[:-1] == doc[1:])
    kind[unit & (kind == WORD)] = UNIT
    first = np.where(buf[s] >= 0xC0, 2, 1)
    rest = np.minimum(s + first, len(buf) - 1)
    lone = s + first >= e
    capital = cap[s] & (kind == WORD) & (lone | ~cap[rest]) & ~np.isin(h, _NO_NAME_H)
    ends = np.concatenate([[0], np.cumsum(_ENDS[buf] & (cls == 0))])
    opens = np.ones(len(s), dtype=bool)
    opens[1:] = (ends[s[1:]] > ends[e[:-1]]) | (doc[1:] != doc[:-1])
    key = textops.mix64(h ^ (doc.astype(_U) * _U(0xC2B2AE3D27D4EB4F)))
    name = capital & ~opens
    name |= capital & opens & np.isin(key, np.unique(key[name]))
    kind[name] = NAME
    # a run of names is one slot
    more = np.zeros(len(s), dtype=bool)
    more[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME) & ~opens[1:]
    keep = np.flatnonzero(~more)
    last = np.concatenate([keep[1:], [len(s)]]) - 1
    k = kind[keep]
    return Forms(low, h, doc, s, np.where(k == WORD, h[keep], _HOLDER[k]), doc[keep], k, s[keep], e[last])


def windows(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of n tokens within one text, and where they begin."""
    m = max(0, len(h) - n + 1)
    acc = np.full(m, n, dtype=_U)
    for k in range(n):
        acc = (acc ^ h[k : k + m]) * _U(0x9E3779B97F4A7C15)
        acc ^= acc >> _U(29)
    at = np.flatnonzero(doc[:m] == doc[n - 1 : n - 1 + m]) if m else np.zeros(0, dtype=np.int64)
    return textops.mix64(acc[at]), at


def template_windows(f: Forms, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As `windows`, of the template form: only those with placeholders, but not more than half."""
    h, at = windows(f.template, f.template_doc, n)
    held = np.concatenate([[0], np.cumsum(f.kind != WORD)])
    c = held[at + n] - held[at]
    ok = (c > 0) & (2 * c <= n)
    return h[ok], at[ok]


@dataclass
class Table:
    """Windows of one form: hash -> (item, position)."""

    hashes: np.ndarray
    start: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    sieve: np.ndarray

    @classmethod
    def build(cls, h: np.ndarray, item: np.ndarray, pos: np.ndarray) -> Table:
        o = np.argsort(h, kind="stable")
        u, start = np.unique(h[o], return_index=True)
        sieve = np.zeros(1 << 20, dtype=bool)
        sieve[(u >> _U(44)).astype(np.int64)] = True
        return cls(u, np.append(start, len(h)), item[o], pos[o], sieve)

    def probe(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place in the text, item, place in the item) of each window found."""
        if not len(self.hashes):
            return
        near = np.flatnonzero(self.sieve[(h >> _U(44)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.hashes, h[near]), len(self.hashes) - 1)
        hit = self.hashes[k] == h[near]
        for p, j in zip(at[near[hit]].tolist(), k[hit].tolist(), strict=True):
            for x in range(self.start[j], self.start[j + 1]):
                yield p, int(self.item[x]), int(self.pos[x])


@dataclass
class Benchmark:
    """Items in both forms, with their windows by size."""

    ids: list[int | None]
    texts: list[str]
    window: int = WINDOW
    forms: Forms = field(init=False)
    plain: dict[int, Table] = field(init=False)
    template: dict[int, Table] = field(init=False)

    def __post_init__(self) -> None:
        self.forms = f = forms(self.texts)
        bounds = np.arange(len(self.texts) + 1)
        self.plain_at = np.searchsorted(f.plain_doc, bounds)
        self.template_at = np.searchsorted(f.template_doc, bounds)
        self.plain, self.template = {}, {}
        self.whole: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(np.isin(np.diff(self.plain_at), (1, 2))).tolist():
            self.whole.setdefault(f.plain[self.plain_at[i] : self.plain_at[i + 1]].tobytes(), []).append(i)
        for tables, at, doc, made in ((self.plain, self.plain_at, f.plain_doc, lambda n: windows(f.plain, f.plain_doc, n)), (self.template, self.template_at, f.template_doc, lambda n: template_windows(f, n))):
            lens = np.diff(at)
            for n in sorted({min(self.window, int(x)) for x in lens if x >= 3}):
                h, p = made(n)
                own = doc[p]
                ok = (lens[own] >= n) if n == self.window else lens[own] == n
                if ok.any():
                    tables[n] = Table.build(h[ok], own[ok], p[ok] - at[own[ok]])


def _clusters(hits: list[tuple[int, int, int]], reach: int) -> Iterator[list[tuple[int, int, int]]]:
    hits.sort()
    held: list[tuple[int, int, int]] = []
    for x in hits:
        if held and x[0] - held[-1][0] > reach:
            yield held
            held = []
        held.append(x)
    yield held


def _cover(hits: list[tuple[int, int, int]], size: int) -> float:
    return len({q + j for _, q, n in hits for j in range(n)}) / size


def _slots(f: Forms, g: Forms, base: int, hits: list[tuple[int, int, int]]) -> tuple[int, float]:
    """Aligned slots of a document (`f`) and an item (`g`, from `base`), and the share that is consistent."""
    pairs = sorted({(p + j, base + q + j) for p, q, n in hits for j in range(n) if g.kind[base + q + j] != WORD})
    if not pairs:
        return 0, 1.0
    votes: dict[tuple[int, bytes, bytes], int] = {}
    seen = []
    for p, q in pairs:
        k = int(g.kind[q])
        a, b = g.value(q), f.value(p)
        if k == UNIT:
            seen.append((k, a, b, DIMENSION.get(a.decode(), "") == DIMENSION.get(b.decode(), "")))
        else:
            seen.append((k, a, b, True))
            votes[k, a, b] = votes.get((k, a, b), 0) + 1
    there: dict[tuple[int, bytes], bytes] = {}
    back: dict[tuple[int, bytes], bytes] = {}
    for k, a, b in sorted(votes, key=lambda v: (-votes[v], v)):
        if (k, a) not in there and (k, b) not in back:
            there[k, a], back[k, b] = b, a
    good = sum(ok if k == UNIT else there.get((k, a)) == b for k, a, b, ok in seen)
    return len(seen), good / len(seen)


def find(texts: list[str | None], bench: Benchmark, min_cover: float = MIN_COVER, min_consistency: float = MIN_CONSISTENCY) -> list[tuple[int, int, str, float, int, float]]:
    """(text, item id, kind, coverage, slots, consistency) of each item found."""
    f = forms(texts)
    hits: tuple[dict, dict] = ({}, {})
    for n, t in bench.plain.items():
        for p, i, q in t.probe(*windows(f.plain, f.plain_doc, n)):
            hits[0].setdefault((int(f.plain_doc[p]), i), []).append((p, q, n))
    for n, t in bench.template.items():
        for p, i, q in t.probe(*template_windows(f, n)):
            hits[1].setdefault((int(f.template_doc[p]), i), []).append((p, q, n))
    out = []
    # windows without a slot are the same in both forms
    held = np.concatenate([[0], np.cumsum(f.kind != WORD)])
    bare: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for n in bench.plain if hits[1] else ():
        h, at = windows(f.template, f.template_doc, n)
        ok = held[at + n] == held[at]
        bare[n] = h[ok], at[ok], np.searchsorted(f.template_doc[at[ok]], np.arange(len(texts) + 1))
    probed: dict[int, dict[int, list[tuple[int, int, int]]]] = {}

    def also(d: int) -> dict[int, list[tuple[int, int, int]]]:
        """For each item the windows of a text that have no slot."""
        if d not in probed:
            probed.clear()  # texts come in order
            found: dict[int, list[tuple[int, int, int]]] = {}
            for n, (h, at, bounds) in bare.items():
                own = slice(bounds[d], bounds[d + 1])
                for p, i, q in bench.plain[n].probe(h[own], at[own]):
                    found.setdefault(i, []).append((p, q, n))
            probed[d] = found
        return probed[d]

    for d, i in sorted({*hits[0], *hits[1]}):
        size = int(bench.plain_at[i + 1] - bench.plain_at[i])
        cover = max((_cover(c, size) for c in _clusters(hits[0].get((d, i), []), size) if c), default=0.0)
        if cover >= min_cover:
            out.append((d, bench.ids[i], "verbatim", round(cover, 6), 0, 1.0))
            continue
        size, base = int(bench.template_at[i + 1] - bench.template_at[i]), int(bench.template_at[i])
        best = (0.0, 0.0, 0)
        wordy = hits[1].get((d, i), [])
        if wordy:
            wordy = wordy + [(p, k, n) for p, q, n in also(d).get(i, []) if (k := _at_template(bench, i, q)) >= 0]
        for c in _clusters(wordy, size):
            if c and (cover := _cover(c, size)) >= min_cover:
                n, share = _slots(f, bench.forms, base, c)
                best = max(best, (share, cover, n))
        if best[1] and best[0] >= min_consistency:
            out.append((d, bench.ids[i], "reparameterised", round(best[1], 6), best[2], round(best[0], 6)))
    if bench.whole:
        at = np.searchsorted(f.plain_doc, np.arange(len(texts) + 1))
        for d in np.flatnonzero(np.isin(np.diff(at), (1, 2))).tolist():
            out += [(d, bench.ids[i], "verbatim", 1.0, 0, 1.0) for i in bench.whole.get(f.plain[at[d] : at[d + 1]].tobytes(), [])]
        out.sort(key=lambda r: r[0])
    return out


def _at_template(bench: Benchmark, item: int, plain_pos: int) -> int:
    """Where a plain token of an item stands in its template; -1 if it is inside a run of names."""
    g = bench.forms
    lo, hi = bench.template_at[item], bench.template_at[item + 1]
    s = g.plain_begin[bench.plain_at[item] + plain_pos]
    k = int(np.searchsorted(g.begin[lo:hi], s))
    return k if lo + k < hi and g.begin[lo + k] == s else -1


def parts(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, part_items: int = PART_ITEMS, part_bytes: int = PART_BYTES) -> Iterator[Benchmark]:
    """The benchmark in parts of about `part_items` items and `part_bytes` of text."""
    one = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t <> ''").distinct()
    items, size = one.agg(F.count("*"), F.sum(F.octet_length("t"))).first()
    n = max(1, -(-items // part_items), -(-(size or 0) // part_bytes))
    for k in range(n):
        got = one.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").toArrow()
        if got.num_rows:
            yield Benchmark(got["i"].to_pylist(), got["t"].to_pylist(), window)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, min_cover: float = MIN_COVER, min_consistency: float = MIN_CONSISTENCY, part_items: int = PART_ITEMS) -> DataFrame:
    """(doc_id, item_id, kind, coverage, slots, consistency) of every item found in a row of `docs`."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    out = spark.createDataFrame([], SCHEMA)
    for part in parts(benchmark, item_col, item_text_col, window, part_items):
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for begin, texts in slices(b, 1):
                    rows = find(texts, shared.value, min_cover, min_consistency)
                    if rows:
                        c = list(zip(*rows, strict=True))
                        ids = b.column(0).take(pa.array([begin + d for d in c[0]]))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(c[1], pa.int64()), pa.array(c[2]), pa.array(c[3], pa.float64()), pa.array(c[4], pa.int32()), pa.array(c[5], pa.float64())], names=["doc_id", "item_id", "kind", "coverage", "slots", "consistency"])

        out = out.unionByName(narrow.mapInArrow(run, SCHEMA))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, min_cover: float = MIN_COVER, min_consistency: float = MIN_CONSISTENCY, part_items: int = PART_ITEMS) -> DataFrame:
    """The rows of `docs` in which no item is found, with all their columns."""
    at = docs.columns.index(text_col)
    for part in parts(benchmark, item_col, item_text_col, window, part_items):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                mask = np.ones(b.num_rows, dtype=bool)
                for begin, texts in slices(b, at):
                    mask[[begin + r[0] for r in find(texts, shared.value, min_cover, min_consistency)]] = False
                yield b.filter(pa.array(mask))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
