"""Length-delimited binary records of token ids, with an offset index for shuffled reads.

A record is an 8-byte little-endian length, the masked CRC-32C of those eight bytes, the payload, and the masked CRC-32C of the
payload: the framing that TFRecord readers know.  The payload is an 8-byte document id, a byte that is 0 for a null id, a byte for the width of
an id (2 or 4), and the token ids, little-endian.  Each task writes one file of records; the index (a Parquet table
beside them) has file, offset, length and checksum of each record, so that a reader can take records in any order.

Plan: one pass, no shuffle.  A task writes under a name of its own and renames at the end, and only the rows of the task that Spark
counts reach the index, so a lost executor or a second attempt leaves no half or double record.  A file's content depends only on its
input partition.

Defined results
---------------
* A null or empty text has a record with no ids.  Null ids come back null.  Repeated rows have a record each.
* An empty table gives an empty index.  A record with a bad length, checksum or offset is reported with ``ok`` false and no ids.
* Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, slices
from .token_counts import VOCAB, encoder, pieces

INDEX_SCHEMA = "file string, record long, doc_id long, offset long, length long, n_tokens long, crc long"
READ_SCHEMA = "doc_id long, n_tokens long, length long, ok boolean, ids array<int>"
_HEAD = struct.Struct("<qBB")
_POLY = 0x82F63B78
_BLOCK = 256


def _tables() -> np.ndarray:
    """[d, b]: what byte b does to the checksum when d more bytes follow it."""
    t = np.zeros((_BLOCK + 1, 256), dtype=np.uint32)
    for b in range(256):
        c = b
        for _ in range(8):
            c = (c >> 1) ^ (_POLY if c & 1 else 0)
        t[0, b] = c
    for d in range(1, _BLOCK + 1):
        t[d] = (t[d - 1] >> np.uint32(8)) ^ t[0][t[d - 1] & np.uint32(255)]
    return t


_T = _tables()
_REV = np.ascontiguousarray(_T[:_BLOCK][::-1])  # by position within a block
_COL = np.arange(_BLOCK) * 256
# a state moves on by one block as if its four bytes stood at the block's front
_ADV = _T[_BLOCK - 4 : _BLOCK][::-1]


def crc32c(data: bytes | np.ndarray) -> int:
    """CRC-32C, a block of bytes to each array operation."""
    raw = np.frombuffer(data, dtype=np.uint8)
    state, n = 0xFFFFFFFF, len(raw)
    head = n % _BLOCK
    for x in raw[:head].tolist() if head < 16 else ():
        state = (state >> 8) ^ int(_T[0, (state ^ x) & 255])
    if head >= 16:
        first = raw[:head].copy()
        first[:4] ^= np.uint8(255)
        state = int(np.bitwise_xor.reduce(_T[np.arange(head - 1, -1, -1), first]))
    if n > head:
        blocks = raw[head:].reshape(-1, _BLOCK)
        part = np.bitwise_xor.reduce(_REV.ravel()[blocks.astype(np.int64) + _COL], axis=1).tolist()
        for p in part:
            state = p ^ int(_ADV[0, state & 255]) ^ int(_ADV[1, (state >> 8) & 255]) ^ int(_ADV[2, (state >> 16) & 255]) ^ int(_ADV[3, state >> 24])
    return state ^ 0xFFFFFFFF


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def payload(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return _HEAD.pack(doc_id or 0, doc_id is not None, width) + ids.astype(f"<u{width}").tobytes()


def parse(data: bytes) -> tuple[int | None, np.ndarray]:
    i, known, width = _HEAD.unpack_from(data)
    return (i if known else None), np.frombuffer(data, dtype=f"<u{width}", offset=_HEAD.size).astype(np.int32)


def frame(data: bytes) -> tuple[bytes, int]:
    """The framed record and the masked checksum of its payload."""
    length = struct.pack("<Q", len(data))
    crc = masked(crc32c(data))
    return b"".join((length, struct.pack("<I", masked(crc32c(length))), data, struct.pack("<I", crc))), crc


def unframe(raw: bytes) -> bytes | None:
    """The payload of one framed record; None if anything about it is wrong."""
    if len(raw) < 16:
        return None
    length, crc = struct.unpack_from("<QI", raw)
    if crc != masked(crc32c(raw[:8])) or length != len(raw) - 16:
        return None
    data = raw[12:-4]
    return data if struct.unpack_from("<I", raw, len(raw) - 4)[0] == masked(crc32c(data)) else None


def encode(text: str | None, vocab: str = VOCAB) -> np.ndarray:
    """Token ids of a whole text."""
    enc = encoder(vocab)
    return np.array([i for p in pieces(text or "") for i in enc.encode_ordinary(p)], dtype=np.int64)


def write_records(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB) -> DataFrame:
    """Write record files and their index under `path`; the index, read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, root = filesystem(path)
        name = f"part-{part:06d}.records"
        width = 2 if encoder(vocab).n_vocab <= 1 << 16 else 4
        out, temp = None, f"{root}/_{name}-{uuid.uuid4().hex}"
        offset = record = 0
        done = []
        for b in batches:
            ids = b.column(0).to_pylist()
            for begin, texts in slices(b, 1):
                rows = []
                for doc_id, text in zip(ids[begin : begin + len(texts)], texts, strict=True):
                    if out is None:
                        out = fs.open_output_stream(temp)
                    tokens = encode(text, vocab)
                    raw, crc = frame(payload(doc_id, tokens, width))
                    out.write(raw)
                    rows.append((name, record, doc_id, offset, len(raw), len(tokens), crc))
                    offset += len(raw)
                    record += 1
                done.append(rows)
        if out is not None:
            out.close()
            fs.move(temp, f"{root}/{name}")
        for rows in done:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["file", "record", "doc_id", "offset", "length", "n_tokens", "crc"])

    fs, root = filesystem(path)
    fs.create_dir(root, recursive=True)
    docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, INDEX_SCHEMA).write.parquet(f"{path}/index")
    return docs.sparkSession.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")


def read_records(spark: SparkSession, path: str, index: DataFrame | None = None, seed: int = 0, ids: bool = True) -> DataFrame:
    """Records in an order that `seed` fixes within each task, found by the index and held against their checksums."""
    index = index if index is not None else spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")
    turn = F.xxhash64(F.lit(seed), "file", "record")
    order = index.select("file", "offset", "length", "crc", turn.alias("turn")).repartition(F.col("file")).sortWithinPartitions("turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        files: dict[str, pa.NativeFile] = {}
        for b in batches:
            for begin in range(0, b.num_rows, 512):
                got = []
                for file, offset, length, crc in zip(*(b.slice(begin, 512).column(i).to_pylist() for i in range(4)), strict=True):
                    if file not in files:
                        files[file] = fs.open_input_file(f"{root}/{file}")
                    try:
                        data = unframe(files[file].read_at(length, offset))
                    except OSError:
                        data = None
                    if data is None or masked(crc32c(data)) != crc:
                        got.append((None, None, length, False, None))
                    else:
                        doc_id, tokens = parse(data)
                        got.append((doc_id, len(tokens), length, True, tokens if ids else None))
                cols = list(zip(*got, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_tokens", "length", "ok", "ids"])
        for f in files.values():
            f.close()

    return order.mapInArrow(run, READ_SCHEMA)
