"""Vectorised text primitives shared by the corpus operators.

Everything here works on a *batch* of texts at a time with numpy, so that one Arrow
batch costs a handful of array passes instead of a Python loop per character.  All
hashes are pure functions of the content: they do not depend on batch boundaries,
worker, platform or Python's hash seed, so a lost task can be run again anywhere.

A *word* is a maximal run of ASCII letters and digits or non-ASCII characters in the
lower-cased text; in SQL ``regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+')``.
"""

from __future__ import annotations

import hashlib

import numpy as np

U64 = np.uint64
_K1 = U64(0x9E3779B97F4A7C15)
_K2 = U64(0xC2B2AE3D27D4EB4F)
_K3 = U64(0x165667B19E3779F9)
LONG_WORD = 64

WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[128:] = True
WORD_BYTE[[*range(48, 58), *range(97, 123)]] = True


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalising bit mixer (splitmix64)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def encode(texts: list[str | None], lower: bool = True) -> list[bytes]:
    """UTF-8 bytes of each text; a null is an empty text."""
    if lower:
        return [t.lower().encode("utf-8", "replace") if t else b"" for t in texts]
    return [t.encode("utf-8", "replace") if t else b"" for t in texts]


def join(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One byte array with a newline after each text, and the start of each text (one more at the end)."""
    buf = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)), out=starts[1:])
    return buf, starts


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of `buf`, column by column over the spans sorted by length."""
    n = len(starts)
    lens = ends - starts
    out = np.empty(n, dtype=U64)
    long = lens > LONG_WORD
    order = np.argsort(-np.where(long, 0, lens).astype(np.int16), kind="stable")
    s, ln = starts[order], np.where(long, 0, lens)[order]
    h = np.full(n, 0x51ED270B, dtype=U64)
    top = int(ln[0]) if n else 0
    # the spans longer than k are a leading slice
    counts = n - np.searchsorted(ln[::-1], np.arange(top), side="right")
    for k in range(top):
        m = counts[k]
        x = buf[s[:m] + k].astype(U64)
        h[:m] = (h[:m] ^ (x + U64(k << 8))) * _K1
        h[:m] ^= h[:m] >> U64(29)
    out[order] = mix64(h)
    for i in np.flatnonzero(long):
        d = hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(d, "little")
    return out


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a joined, lower-cased buffer."""
    w = np.zeros(len(buf) + 2, dtype=np.int8)
    w[1:-1] = WORD_BYTE[buf]
    d = np.diff(w)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and for each text where its words begin (one more at the end)."""
    buf, at = join(encode(texts))
    s, e = word_spans(buf)
    return span_hashes(buf, s, e), np.searchsorted(s, at)


def ngrams(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word n-grams, with the text of each.

    A text with some words but fewer than n has one gram, all of its words.
    """
    lens = np.diff(at)
    doc = np.repeat(np.arange(len(lens)), lens)
    total = len(h)
    g = h.copy()
    m = max(0, total - n + 1)
    acc = np.zeros(m, dtype=U64)
    for k in range(n):
        acc = (acc ^ h[k : k + m]) * _K2
        acc ^= acc >> U64(31)
    ok = doc[:m] == doc[n - 1 : n - 1 + m] if m else np.zeros(0, dtype=bool)
    g, gd = mix64(acc[ok]), doc[:m][ok]
    short = np.flatnonzero((lens > 0) & (lens < n))
    if len(short):
        extra = []
        for i in short:
            a = U64(lens[i])
            for x in h[at[i] : at[i + 1]]:
                with np.errstate(over="ignore"):
                    a = (a ^ x) * _K3
                    a ^= a >> U64(31)
            extra.append(a)
        g = np.concatenate([g, mix64(np.array(extra, dtype=U64))])
        gd = np.concatenate([gd, short])
        o = np.argsort(gd, kind="stable")
        g, gd = g[o], gd[o]
    return g, gd


def unique_per_doc(g: np.ndarray, gd: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of each text, ascending, and where each text's begin (one more at the end)."""
    o = np.argsort(g)
    o = o[np.argsort(gd[o], kind="stable")]
    g, gd = g[o], gd[o]
    keep = np.ones(len(g), dtype=bool)
    keep[1:] = (g[1:] != g[:-1]) | (gd[1:] != gd[:-1])
    g, gd = g[keep], gd[keep]
    return g, np.searchsorted(gd, np.arange(docs + 1))
