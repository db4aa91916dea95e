import gzip
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from duskwatch.llm import common as C
from duskwatch.llm import warc as W


class Memory:
    """A file in memory, as `Source` reads it."""

    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, offset):
        return self.data[offset : offset + n]


def raw(i, body=b"hello"):
    return W.record({"WARC-Type": "resource", "X-N": str(i)}, body)


def whole(data, step=None, held=W.HELD):
    """(n, ...) of the records and (offset, length) of the gaps, over splits of `step` bytes."""
    step = step or max(1, len(data))
    recs, gaps = [], []
    for a in range(0, len(data), step):
        for kind, offset, length, inner, headers, *_ in W.salvage(W.Source(Memory(data)), a, min(len(data), a + step), held):
            if kind == "record":
                recs.append(int(headers["X-N"]))
            else:
                gaps.append((offset, length))
    return recs, gaps


def brute(parts):
    """What is in a file of good records (n, bytes) and noise (None, bytes)."""
    recs, gaps, at = [], [], 0
    for n, b, *gap in parts:
        if n is not None:
            recs.append(n)
        if (n is None or gap) and b:
            if gaps and sum(gaps[-1]) == at:
                gaps[-1] = (gaps[-1][0], gaps[-1][1] + len(b))
            else:
                gaps.append((at, len(b)))
        at += len(b)
    return recs, gaps


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 10**6), st.integers(1, 400))
def test_members_and_noise_in_any_splits(seed, step):
    rng = random.Random(seed)
    parts = []
    for i in range(rng.randrange(0, 8)):
        kind = rng.randrange(4)
        m = W.member(raw(i, bytes(rng.choice(b"ab ") for _ in range(rng.randrange(0, 200)))))
        if kind == 0:
            parts.append((None, rng.choice([b"\x1f\x8b\x08junk", b"WARC/1.0 no", b"\x00" * 9, m[: len(m) // 2], b"\x1f"])))
        elif kind == 1:
            k = rng.randrange(len(m) - 8, len(m) - 4)  # the checksum; the record has a digest of its own
            parts.append((i, m[:k] + bytes([m[k] ^ 255]) + m[k + 1 :], "gap"))
        else:
            parts.append((i, m))
    data = b"".join(p[1] for p in parts)
    assert whole(data, step) == brute(parts) == whole(data) == whole(data, held=50)


def test_plain_records_and_failed_checks():
    good = [raw(i, b"body %d" % i) for i in range(6)]
    bad_digest = good[1].replace(b"body 1", b"bodY 1")
    bad_length = good[3].replace(b"Content-Length: 6", b"Content-Length: 9")
    parts = [(0, good[0]), (None, bad_digest), (2, good[2]), (None, bad_length), (4, good[4]), (None, good[5][:-6])]
    data = b"".join(b for _, b in parts)
    assert whole(data) == brute(parts)


def test_several_records_in_a_member():
    data = W.member(raw(0) + b"noise" + raw(1) + raw(2)[:20])
    got = list(W.salvage(W.Source(Memory(data)), 0, len(data)))
    assert [(g[0], g[3]) for g in got] == [("record", 0), ("gap", len(raw(0))), ("record", len(raw(0)) + 5), ("gap", len(raw(0)) + 5 + len(raw(1)))]


def test_empty_noise_and_long():
    assert whole(b"") == ([], [])
    assert whole(b"\x00" * 100) == ([], [(0, 100)])
    data = W.member(raw(1, b"x" * 5000)) + W.member(raw(2))
    got = [(g[0], g[1]) for g in W.salvage(W.Source(Memory(data)), 0, len(data), held=1000)]
    assert got == [("record", 0), ("record", data.index(W.member(raw(2))))]


def blocks(data, held):
    """(n, block) of the records, blocks put together."""
    out = []
    for kind, _, _, _, headers, body, _ in W.salvage(W.Source(Memory(data)), 0, len(data), held):
        if kind == "record":
            out.append((int(headers["X-N"]), body if isinstance(body, bytes) else b"".join(body)))
    return out


def test_long_blocks_and_members_come_in_parts():
    rng = random.Random(4)
    sizes = [0, 10, 5000, 3_000_000, 70, 1_500_000]
    rows = [(i, bytes(rng.choice(b"abc \n") for _ in range(1000)) * (n // 1000 + 1)) for i, n in enumerate(sizes)]
    rows = [(i, b[:n]) for (i, b), n in zip(rows, sizes, strict=True)]
    one = W.member(b"".join(raw(i, b) for i, b in rows))
    each = b"".join(W.member(raw(i, b)) for i, b in rows)
    plain = b"".join(raw(i, b) for i, b in rows)
    for held in (100, 40_000, W.HELD):
        for data in (one, each, plain):
            assert blocks(data, held) == rows


def test_records_before_the_damage_are_read():
    rows = [(i, b"block %d " % i * 4000) for i in range(8)]
    no_digest = raw(99, b"unsure").replace(b"WARC-Block-Digest", b"X-Nothing")
    whole_member = W.member(raw(*rows[0]) + no_digest + b"".join(raw(i, b) for i, b in rows[1:]))
    for cut in (len(whole_member) * 2 // 3, len(whole_member) - 5):
        for tail in (b"", W.member(raw(50))):
            for held in (100, W.HELD):
                got = blocks(whole_member[:cut] + tail, held)
                n = len(got) - bool(tail)
                assert 1 <= n <= 8 and got[:n] == rows[:n] and got[n:] == ([(50, b"hello")] if tail else [])
                gaps = [(g[1], g[2]) for g in W.salvage(W.Source(Memory(whole_member[:cut] + tail)), 0, cut + len(tail), held) if g[0] == "gap"]
                assert gaps == [(0, cut)]
    assert len(blocks(whole_member[:-5], W.HELD)) == 8
    bit = bytearray(whole_member)
    bit[-6] ^= 1  # the checksum
    assert blocks(bytes(bit), W.HELD) == rows


def test_addresses_as_hadoop_writes_them():
    assert C.arrow_uri("s3a://b/k") == "s3://b/k" and C.arrow_uri("dbfs:/x/y") == "file:///dbfs/x/y" and C.arrow_uri("file:/tmp/x") == "file:///tmp/x" == C.arrow_uri("file:///tmp/x")
    assert C.arrow_uri("/tmp/x") == "/tmp/x" and C.arrow_uri("hdfs://n:1/x") == "hdfs://n:1/x"
    assert C.filesystem("file:/tmp/x")[1] == "/tmp/x"


def test_folded_and_odd_headers():
    ok = b"WARC/1.0\r\nA: b\r\n c\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert W.parse(ok, 0)[1] == {"A": "b c", "Content-Length": "2"}
    for bad in (b"WARC/1.0\r\nno colon\r\n\r\n", b"WARC/1.0\r\nContent-Length: -1\r\n\r\n\r\n\r\n", b"WARC/1.0\r\n\r\n", b"WARC/x\r\n"):
        assert isinstance(W.parse(bad, 0), str)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, body int, kind int")


def test_round_trip(spark):
    rows = [(i, f"http://h/{i}", "<p>é" * i, 0, 0) for i in range(50)] + [(7, "http://h/7", "x", 0, 0), (7, "http://h/7", "x", 0, 0), (None, None, None, 0, 0), (100, "u", "", 0, 0), (101, "v", None, 0, 0), (102, "w", "y" * 3_000_000, 0, 0), (103, "z", "WARC/1.1\r\n\x1f", 0, 0)]
    got = W.rehearse(pages(spark, rows).repartition(3)).collect()
    key = lambda r: str(r)
    assert sorted([(r.page_id, r.url, r.html) for r in got if r.kind == "record"], key=key) == sorted([r[:3] for r in rows], key=key)
    assert sum(r.kind == "gap" for r in got) == sum(bool(W.noise(r[0])) for r in rows)
    assert W.rehearse(pages(spark, [])).count() == 0


def test_files_of_both_kinds_in_splits(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"".join(raw(i) for i in range(5)))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.warc.gz").write_bytes(b"".join(gzip.compress(raw(i)) for i in range(5, 40)))
    (tmp_path / "c.warc.gz").write_bytes(b"")
    (tmp_path / "d.txt").write_bytes(raw(99))
    got = W.read_warc(spark, f"file://{tmp_path}", split_bytes=500)
    assert sorted(int(r.headers["X-N"]) for r in got.collect()) == list(range(40))
    assert W.read_warc(spark, f"file://{tmp_path}/a.warc").count() == 5


def test_continuations(spark, tmp_path):
    body = bytes(range(256)) * 40
    (tmp_path / "a.warc.gz").write_bytes(W.member(raw(1, body)) + W.member(raw(2)))
    got = sorted(W.read_warc(spark, f"file:{tmp_path}", held_bytes=3000).collect(), key=lambda r: (r.offset, r.part))
    assert [(r.kind, r.part) for r in got] == [("record", 0), *(("continuation", k) for k in (1, 2, 3)), ("record", 0)]
    assert b"".join(bytes(r.body) for r in got[:4]) == body and got[1].headers is None and bytes(got[4].body) == b"hello"
