"""Token counts without tokens: batch encoding in Arrow functions that hand back lengths only.

A text longer than `piece_chars` is cut at safe boundaries, where a space or a line end follows something
other than white space: every pre-tokenizer pattern of this kind starts a new piece there, so the count of the whole is exactly the sum of the counts
of the parts.  The pieces of an Arrow batch are put into encoding batches of about equal bytes, longest first into the lightest batch, so that
one long text neither holds up nor swells a batch.

Plan: one pass, no shuffle; the vocabulary is read once a worker process from `vocab`, a path that every
executor must have, and never travels with the rows.

Defined results
---------------
* A null text has null counts; an empty one has 0 tokens.
* A text without any safe boundary is encoded whole.
* Strings that look like special tokens are ordinary text.
* Every row, repeated or not, gives one row; a null id is carried along.  Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE_CHARS = 1 << 16
BATCH_BYTES = 1 << 20
SCHEMA = "doc_id long, n_tokens long, n_bytes long"
_SAFE = re.compile(r"(?<=\S)[ \n]")
_encoders: dict[str, tiktoken.Encoding] = {}


def encoder(vocab: str = VOCAB) -> tiktoken.Encoding:
    """The byte-level BPE of a rank file; kept for the life of the worker."""
    if vocab not in _encoders:
        with open(vocab, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[vocab] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocab]


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """Parts of about `most` characters that meet at safe boundaries."""
    begin = 0
    while len(text) - begin > most:
        m = _SAFE.search(text, begin + most)
        if not m:
            break
        yield text[begin : m.start()]
        begin = m.start()
    yield text[begin:]


def balanced(sizes: list[int], most: int = BATCH_BYTES) -> list[list[int]]:
    """Indices in batches of about equal size, no more batches than `most` a batch calls for."""
    n = max(1, -(-sum(sizes) // most))
    heap = [(0, k) for k in range(n)]
    out: list[list[int]] = [[] for _ in range(n)]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        held, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (held + sizes[i], k))
    return out


def count(texts: list[str | None], enc: tiktoken.Encoding, piece_chars: int = PIECE_CHARS, batch_bytes: int = BATCH_BYTES) -> tuple[list[int | None], list[int | None]]:
    """Tokens and UTF-8 bytes of each text."""
    parts: list[str] = []
    owner: list[int] = []
    for i, t in enumerate(texts):
        if t:
            for p in pieces(t, piece_chars):
                parts.append(p)
                owner.append(i)
    sizes = [len(p.encode("utf-8", "replace")) for p in parts]
    tokens: list[int | None] = [None if t is None else 0 for t in texts]
    held = list(tokens)
    for batch in balanced(sizes, batch_bytes):
        for i, got in zip(batch, enc.encode_ordinary_batch([parts[i] for i in batch], num_threads=1), strict=True):
            tokens[owner[i]] += len(got)
            held[owner[i]] += sizes[i]
    return tokens, held


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB, piece_chars: int = PIECE_CHARS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, n_tokens, n_bytes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for b in batches:
            step = max(1, round(b.num_rows * 16 * batch_bytes / max(1, b.nbytes)))
            for begin in range(0, b.num_rows, step):
                part = b.slice(begin, step)
                tokens, held = count(part.column(1).to_pylist(), enc, piece_chars, batch_bytes)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens, pa.int64()), pa.array(held, pa.int64())], names=["doc_id", "n_tokens", "n_bytes"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, SCHEMA)
