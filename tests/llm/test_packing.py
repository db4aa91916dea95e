import random

from hypothesis import given
from hypothesis import strategies as st

from duskwatch.llm.packing import pack, pack_documents

TIERS = (8, 32, 128)


def brute(rows, tiers=TIERS, step_tokens=256):
    """The same rules by plain search."""
    pieces = [(min(tiers[-1], n - s), (i is None, i or 0), s) for i, n in rows for s in range(0, n, tiers[-1])]
    tier = {p_: next(t for t in tiers if t >= p_[0]) for p_ in pieces}
    left = sorted(pieces, key=lambda p: (-p[0], p[1], p[2]))
    out = []
    for level in range(len(tiers) - 1, -1, -1):
        cap, windows = tiers[level], []
        for p in [p for p in left if tier[p] == cap]:
            fits = sorted((cap - sum(q[0] for q in w), k) for k, w in enumerate(windows) if cap - sum(q[0] for q in w) >= p[0])
            if fits:
                windows[fits[0][1]].append(p)
            else:
                windows.append([p])
        left = [p for p in left if tier[p] != cap]
        for w in windows:
            for lower in tiers[:level][::-1]:
                while True:
                    room = cap - sum(q[0] for q in w)
                    can = [p for p in left if tier[p] == lower and p[0] <= room]
                    if not can:
                        break
                    w.append(can[0])
                    left.remove(can[0])
        per = max(1, step_tokens // cap)
        n = -(-len(windows) // per)
        for rank, k in enumerate(sorted(range(len(windows)), key=lambda k: (-sum(q[0] ** 2 for q in windows[k]), k))):
            turn, g = divmod(rank, n)
            at = 0
            for q in windows[k]:
                out.append((cap, k, g if turn % 2 == 0 else n - 1 - g, at, None if q[1][0] else q[1][1], q[2], q[0]))
                at += q[0]
    return sorted(out, key=str)


@given(st.lists(st.integers(1, 400), max_size=40))
def test_against_plain_search(lengths):
    rows = list(enumerate(lengths))
    assert sorted(pack(rows, TIERS, 256), key=str) == brute(rows)


@given(st.lists(st.integers(1, 5000), max_size=60))
def test_everything_is_packed_once_and_fits(lengths):
    got = pack(list(enumerate(lengths)), (64, 512, 2048), 4096)
    held, steps = {}, {}
    for tier, w, g, at, i, start, n in got:
        assert at + n <= tier
        held.setdefault(i, []).append((start, n))
        steps.setdefault((tier, g), set()).add(w)
    for i, n in enumerate(lengths):
        at = 0
        for start, k in sorted(held[i]):
            assert start == at
            at += k
        assert at == n
    assert all(len(ws) <= 4096 // t for (t, _), ws in steps.items())


def test_documents(spark, documents):
    rows = [(1, None), (2, ""), (3, "abc"), (3, "abc"), (None, "x"), (4, "é" * 300), (5, "y" * 1000)]
    got = pack_documents(documents(rows, extra="shard,tier,n,window"), tiers=TIERS, step_tokens=256).collect()
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.piece_len
    assert total == {3: 8, None: 2, 4: 601, 5: 1001}
    assert pack_documents(documents([])).count() == 0


def test_shards_match_packing_each_alone(spark, documents):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randrange(1, 300)) for i in range(200)]
    got = pack_documents(documents(rows), tiers=TIERS, step_tokens=256, shard_docs=50).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert len(by) == 4
    for own in by.values():
        ids = {r.doc_id for r in own}
        want = brute([(i, len(t) + 1) for i, t in rows if i in ids])
        assert sorted(((r.tier, r.window, r.step_group, r.window_offset, r.doc_id, r.piece_start, r.piece_len) for r in own), key=str) == want


def test_any_long_is_an_id_and_null_is_none():
    got = pack([(2**63 - 1, 5), (7, 4), (None, 5), (-(2**63), 3)], TIERS, 256)
    assert sorted((r[4] is None, r[4] or 0, r[6]) for r in got) == [(False, -(2**63), 3), (False, 7, 4), (False, 2**63 - 1, 5), (True, 0, 5)]


def test_rows_of_null_ids_only_fill_all_shards(spark, documents):
    rng = random.Random(2)
    lengths = [rng.randrange(1, 300) for _ in range(1000)] + [40] * 1000
    got = pack_documents(documents([(None, "x" * n) for n in lengths]), tiers=TIERS, step_tokens=256, shard_docs=250).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
        assert r.doc_id is None
    assert len(by) == 8 and max(len(v) for v in by.values()) < 3 * len(got) / 8
    assert sum(r.piece_len for r in got) == sum(n + 1 for n in lengths)
    assert sorted(r.piece_len for r in got if r.piece_start == 0) == sorted(min(128, n + 1) for n in lengths)
