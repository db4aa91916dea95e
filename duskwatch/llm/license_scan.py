"""License scans: matching statistics against a generalised suffix automaton of licence tokens.

All licence templates go into one suffix automaton over token ids.  A document is streamed through it: after each token, the
automaton's state says how long a suffix of what has been read occurs in some template (the matching statistics).  Maximal matches of at least
`min_match` tokens (or a whole shorter template) are looked up in the templates they occur in, and those that
keep the template's order, near each other, are chained into one covered span.

A match of n tokens holds n - 1 pairs that follow each other in a template, so array operations first mark the runs of
such pairs, and only runs long enough are streamed; the rest of a text cannot hold a match.  This changes no result.

Plan: one pass, no shuffle, no model beyond the automaton, whose size is that of the templates and not of the corpus.

Defined results
---------------
* A null or empty text, and one without a span that covers `min_cover` of its template, gives no row.
* Case, punctuation and white space are ignored.  Spans are counted in tokens from 0, the end excluded.
* Of spans of several templates over the same tokens, the one that covers most tokens stays; ties go to the shorter template, then to the one named first.
* Repeated rows give their rows each; a null id is carried along.  Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import slices
from .license_texts import TEMPLATES

MIN_MATCH = 5
MIN_COVER = 0.6
MAX_GAP = 32
SCHEMA = "doc_id long, license string, span_start long, span_end long, tokens_covered long, coverage double, matches int"
_WORD = re.compile(r"[a-z0-9\u0080-\U0010FFFF]+")


def tokenize(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Automaton:
    """A suffix automaton of several token sequences; of each state, where its longest string ends in each template."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        own: list[tuple[int, int, int]] = []  # state, template, end
        for t, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c)
                own.append((last, t, i + 1))
        self.ends: list[set[tuple[int, int]]] = [set() for _ in self.next]
        for s, t, e in own:
            while s > 0 and (t, e) not in self.ends[s]:
                self.ends[s].add((t, e))
                s = self.link[s]

    def _new(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        cur = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return cur

    def matches(self, ids: list[int]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of each maximal match: the next token does not lengthen it."""
        s = n = 0
        for i, c in enumerate(ids):
            if c in self.next[s]:
                s, n = self.next[s][c], n + 1
                continue
            if n:
                yield i, n, s
            while s and c not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if c in self.next[s]:
                s, n = self.next[s][c], n + 1
            else:
                s = n = 0
        if n:
            yield len(ids), n, s


class Scanner:
    """The automaton of `templates` (name -> texts) with the hashes of its tokens."""

    def __init__(self, templates: dict[str, list[str]], min_match: int = MIN_MATCH, min_cover: float = MIN_COVER, max_gap: int = MAX_GAP) -> None:
        self.names = [name for name, texts in templates.items() for _ in texts]
        words = [tokenize(t) for texts in templates.values() for t in texts]
        self.sizes = [len(w) for w in words]
        vocab = {w: i for i, w in enumerate(sorted({x for w in words for x in w}))}
        ids = [[vocab[x] for x in w] for w in words]
        h, _ = textops.words([" ".join(vocab)])
        order = np.argsort(h)
        self.hashes, self.id_of = h[order], order
        n = len(vocab)
        self.pairs = np.unique(np.array([a * n + b for s in ids for a, b in zip(s, s[1:])] or [-1], dtype=np.int64))
        self.automaton = Automaton(ids)
        self.min_match, self.min_cover, self.max_gap = min_match, min_cover, max_gap
        self.least = min([min_match, *self.sizes])
        self.ones = np.array(sorted({q[0] for q in ids if len(q) == 1}), dtype=np.int64)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Token ids of word hashes; -1 for a word of no template."""
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[k] == h, self.id_of[k], -1) if len(self.hashes) else np.full(len(h), -1)

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, str, int, int, int, float, int]]:
        """(text, licence, start, end, tokens covered, coverage, matches) of each span."""
        if not self.sizes:
            return
        h, at = textops.words(texts)
        ids = self.ids(h)
        doc = np.repeat(np.arange(len(texts)), np.diff(at))
        pair = np.isin(ids[:-1] * len(self.hashes) + ids[1:], self.pairs) & (ids[:-1] >= 0) & (ids[1:] >= 0) & (doc[:-1] == doc[1:])
        edge = np.diff(np.concatenate([[0], pair.astype(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1  # of tokens
        long = end - begin >= max(2, self.least)
        runs = list(zip(begin[long].tolist(), end[long].tolist(), strict=True))
        if len(self.ones):  # a template of one token needs no pair
            alone = np.isin(ids, self.ones)
            alone[1:] &= ~pair
            alone[:-1] &= ~pair
            runs = sorted(runs + [(i, i + 1) for i in np.flatnonzero(alone).tolist()])
        hits: dict[int, list[tuple[int, int, int]]] = {}
        for b, e in runs:
            d = int(doc[b])
            for stop, n, s in self.automaton.matches(ids[b:e].tolist()):
                hits.setdefault(d, []).append((b + stop - int(at[d]), n, s))
        for d in sorted(hits):
            for row in self.spans(hits[d]):
                yield d, *row

    def spans(self, found: list[tuple[int, int, int]]) -> list[tuple[str, int, int, int, float, int]]:
        """Chains of one text's matches, the best of those that overlap."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for end, n, s in found:
            for t, e in self.automaton.ends[s]:
                if n >= min(self.min_match, self.sizes[t]):
                    by.setdefault(t, []).append((end - n, e - n, n))
        chains = []
        for t, ms in by.items():
            ms.sort()
            best: list[tuple[int, int, int]] = []  # covered, previous, links
            for j, (d, p, n) in enumerate(ms):
                top = (n, -1, 1)
                for i in range(j - 1, -1, -1):
                    di, pi, ni = ms[i]
                    if d - di > self.max_gap + self.sizes[t]:
                        break
                    lap = max(0, di + ni - d, pi + ni - p)
                    if di < d and pi < p and lap < n and d - di - ni <= self.max_gap and p - pi - ni <= self.max_gap and best[i][0] + n - lap > top[0]:
                        top = (best[i][0] + n - lap, i, best[i][2] + 1)
                best.append(top)
            for j in sorted(range(len(ms)), key=lambda j: (-best[j][0], j)):
                covered, i, links = best[j][0], j, best[j][2]
                if covered < self.min_cover * self.sizes[t]:
                    break
                while best[i][1] >= 0:
                    i = best[i][1]
                chains.append((-covered, self.sizes[t], t, ms[i][0], ms[j][0] + ms[j][2], links))
        out: list[tuple[int, ...]] = []
        for c in sorted(chains):
            if all(c[4] <= o[3] or c[3] >= o[4] for o in out):
                out.append(c)
        return [(self.names[t], start, end, -neg, round(min(1.0, -neg / self.sizes[t]), 6), links) for neg, _, t, start, end, links in sorted(out, key=lambda o: (o[3], o[2]))]


def scan_documents(docs: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text", min_match: int = MIN_MATCH, min_cover: float = MIN_COVER, max_gap: int = MAX_GAP) -> DataFrame:
    """(doc_id, license, span_start, span_end, tokens_covered, coverage, matches) of every licence span."""
    own = TEMPLATES if templates is None else templates
    made: list[Scanner] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Scanner(own, min_match, min_cover, max_gap))
        for b in batches:
            for begin, texts in slices(b, 1):
                rows = list(made[0].scan(texts))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    ids = b.column(0).take(pa.array([begin + d for d in cols[0]]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(cols[1]), *(pa.array(c, pa.int64()) for c in cols[2:5]), pa.array(cols[5], pa.float64()), pa.array(cols[6], pa.int32())], names=["doc_id", "license", "span_start", "span_end", "tokens_covered", "coverage", "matches"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, SCHEMA)
