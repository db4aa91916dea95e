import os
import random
import struct

import pytest

from duskwatch.llm import records as R
from duskwatch.llm import token_counts as C

pytestmark = pytest.mark.skipif(not os.path.exists(C.VOCAB), reason="no vocabulary here")
WORDS = ["the", "café", "don't", "  ", "\n", "\t", "x1y2", "!!", "北京", "<|endoftext|>", "a" * 70, " "]


def texts(seed, n=40):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 200))) for _ in range(n)]


def test_counts_do_not_depend_on_cuts():
    enc = C.encoder()
    own = [*texts(1), None, "", " ", "z" * 5000, "   x \x1c y " * 300]
    want = [None if t is None else len(enc.encode_ordinary(t)) for t in own]
    for piece, batch in ((1 << 16, 1 << 20), (40, 100), (1, 1)):
        got, sizes = C.count(own, enc, piece, batch)
        assert got == want
        assert sizes == [None if t is None else len(t.encode()) for t in own]


def test_pieces_join_again():
    for t in texts(2):
        assert "".join(C.pieces(t, 10)) == t


def test_batches_are_even():
    got = C.balanced([5, 1, 1, 1, 9, 3], 10)
    assert sorted(i for b in got for i in b) == list(range(6)) and len(got) == 2
    assert C.balanced([], 10) == [[]]


def test_count_documents(spark, documents):
    rows = [(1, "hello world"), (1, "hello world"), (2, None), (3, ""), (None, "x"), (4, "word " * 40000)]
    got = C.count_tokens(documents(rows, extra="n_tokens,n_bytes")).collect()
    assert sorted(((r.doc_id or -1), r.n_tokens, r.n_bytes) for r in got if r.n_tokens is not None) == [(-1, 1, 1), (1, 2, 11), (1, 2, 11), (3, 0, 0), (4, 40001, 200000)]
    assert [r.doc_id for r in got if r.n_tokens is None] == [2]
    assert C.count_tokens(documents([])).count() == 0


def slow_crc(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksum():
    assert R.crc32c(b"123456789") == 0xE3069283
    rng = random.Random(5)
    for n in (0, 1, 7, 15, 16, 17, 255, 256, 257, 271, 272, 1000):
        d = rng.randbytes(n)
        assert R.crc32c(d) == slow_crc(d)


def test_any_flipped_bit_is_found():
    import numpy as np

    raw, _ = R.frame(R.payload(3, np.array([1, 50000]), 2))
    assert struct.unpack_from("<Q", raw)[0] == len(raw) - 16
    for k in range(len(raw) * 8):
        bad = bytearray(raw)
        bad[k // 8] ^= 1 << k % 8
        assert R.unframe(bytes(bad)) is None
    assert R.unframe(raw[:-1]) is None and R.unframe(b"") is None


def test_round_trip(spark, documents, tmp_path):
    rows = [*enumerate(texts(3)), (7, "again"), (7, "again"), (None, "no id"), (90, None), (91, ""), (92, "long " * 30000)]
    path = f"file://{tmp_path}/r"
    index = R.write_records(documents(rows, extra="file,offset,crc").repartition(3), path)
    got = R.read_records(spark, path, index, seed=4).collect()
    assert all(r.ok for r in got)
    want = sorted(((i if i is not None else -1), C.encoder().encode_ordinary(t or "")) for i, t in rows)
    assert sorted(((r.doc_id if r.doc_id is not None else -1), list(r.ids)) for r in got) == want
    again = R.read_records(spark, path, seed=5).select("doc_id").collect()
    assert [r.doc_id for r in again] != [r.doc_id for r in got]


def test_damage_is_reported(spark, documents, tmp_path):
    path = f"file://{tmp_path}/r"
    R.write_records(documents([(i, f"text {i}") for i in range(20)]).coalesce(1), path)
    file = next(p for p in (tmp_path / "r").iterdir() if p.name.endswith(".records"))
    raw = bytearray(file.read_bytes())
    raw[20] ^= 1
    file.write_bytes(bytes(raw)[:-3])
    got = R.read_records(spark, path).collect()
    assert sorted(r.doc_id for r in got if r.ok) == list(range(1, 19)) and sum(not r.ok for r in got) == 2


def test_empty(spark, documents, tmp_path):
    assert R.read_records(spark, f"file://{tmp_path}/r", R.write_records(documents([]), f"file://{tmp_path}/r")).count() == 0
