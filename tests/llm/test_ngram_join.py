import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskwatch.llm import ngram_join as J

VOCAB = [f"w{i}" for i in range(400)]


def corpus(seed, groups=12, size=8, solo=40):
    """Groups of copies with some words exchanged, and documents of their own."""
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [rng.choice(VOCAB) for _ in range(rng.randrange(3, 80))]
        for _ in range(rng.randrange(1, size)):
            out.append(" ".join(w if rng.random() > rng.choice([0, 0.02, 0.1]) else rng.choice(VOCAB) for w in base))
    out += [" ".join(rng.choice(VOCAB) for _ in range(rng.randrange(1, 60))) for _ in range(solo)]
    return list(enumerate(out))


def gram_set(text, n):
    import re

    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, t):
    """Similar pairs of places in `rows`."""
    rows = {k: x for k, (_, x) in enumerate(rows) if x}
    sets = {k: gram_set(x, n) for k, x in rows.items()}
    out = {}
    for a, b in itertools.combinations(sorted(rows), 2):
        if rows[a] == rows[b]:
            out[a, b] = 1.0
        elif sets[a] and sets[b]:
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j >= t - 1e-12:
                out[a, b] = round(j, 6)
    return out


def brute_classes(rows, n=3, t=0.5):
    """For each row its id, the lowest id that it is connected with, and the number of rows similar to it."""
    root, links = list(range(len(rows))), [0] * len(rows)
    for a, b in brute(rows, n, t):
        links[a] += 1
        links[b] += 1
        old = {root[a], root[b]}
        root = [min(old) if r in old else r for r in root]
    low = {r: min((i for (i, _), q in zip(rows, root, strict=True) if q == r and i is not None), default=None) for r in set(root)}
    return sorted(((i, low[r], k) for (i, _), r, k in zip(rows, root, links, strict=True)), key=str)


def run(df, **options):
    return sorted(((r[0], r[1], r[2]) for r in J.join(df, **options).collect()), key=str)


def listed(df, **options):
    """Similar pairs of ids, from pairs of classes and their members."""
    found, members = J.pairs(df, **options)
    of = {}
    for k, i in members.collect():
        of.setdefault(k, []).append(i)
    out = {(a, b): 1.0 for own in of.values() for a, b in itertools.combinations(sorted(own), 2)}
    for x, y, j in found.collect():
        new = {(min(a, b), max(a, b)): round(j, 6) for a in of[x] for b in of[y]}
        assert not new.keys() & out.keys()
        out |= new
    return out


@pytest.mark.parametrize("n,t,most,size", [(3, 0.5, 4, 200), (2, 0.7, 1, 100_000), (1, 0.8, 3, 300)])
def test_against_brute_force(spark, documents, n, t, most, size):
    rows = corpus(n)
    df = documents(rows).repartition(3)
    options = {"n": n, "threshold": t, "most_matches": most, "bucket_grams": size}
    assert listed(df, **options) == pytest.approx(brute(rows, n, t))
    assert run(df, **options) == brute_classes(rows, n, t)


def test_shuffled_instead_of_broadcast(spark, documents):
    rows = corpus(9, groups=5, solo=5) + [(900, corpus(9, groups=5, solo=5)[0][1]), (None, "a b c"), (7, "a b c")]
    assert run(documents(rows), broadcast_rows=0) == brute_classes(rows)


@pytest.mark.parametrize("pairs,held", [(5, 4_000_000), (2_000_000, 300)])
def test_large_tiles_are_cut(spark, documents, pairs, held):
    rows = corpus(10, groups=4, size=20, solo=3)
    assert run(documents(rows), tile_pairs=pairs, tile_grams=held) == brute_classes(rows)


def test_long_lists_are_cut_and_hot_ngrams_travel_with_documents(spark, documents):
    rng = random.Random(11)
    base = [rng.choice(VOCAB) for _ in range(40)]
    rows = [(i, " ".join(w if rng.random() > 0.04 else rng.choice(VOCAB) for w in base)) for i in range(90)]
    want = brute_classes(rows)
    assert run(documents(rows).repartition(2), list_docs=7) == want
    assert run(documents(rows).repartition(2), hot_least=20) == want
    assert run(documents(rows).repartition(2), hot_least=20, list_docs=7, bucket_grams=50) == want


def test_hot_ngrams_are_counted_over_all_runs(spark, documents):
    rows = [(i, f"a b c d{i} e{i} f{i}") for i in range(40)]
    c = J.classes(documents(rows).repartition(4), "doc_id", "text", 3, 1000, 30)
    g, _ = J.grams(["a b c"], 3)
    assert c.hot[0].tolist() == (g & J._TOK).tolist() and c.hot[1].tolist() == [40]


def test_edge_cases(spark, documents):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A, b!"), (5, "..."), (6, "..."), (None, "a b"), (7, "one"), (8, "x y z x y z"), (9, "x y z x y z x"), (10, "!?"), (None, None), (None, "q"), (None, "q"), (11, "one two three four"), (12, "two three four one")]
    assert run(documents(rows)) == brute_classes(rows)
    got = {(i, c): k for i, c, k in run(documents(rows))}
    assert got[3, 3] == 2 and got[None, 3] == 2 and got[6, 5] == 1 and got[10, 10] == 0 and got[1, 1] == 0 and got[None, None] in (0, 1)


def test_repeated_rows_ids_and_extra_columns(spark, documents):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (3, "q r s t u"), (3, "a b c d e"), (3, "v w x y z"), (None, "q r s t u")]
    df = documents(rows, extra="id,h1,h2,x,y,key,tile,rep,first")
    assert run(df) == brute_classes(rows)
    kept = J.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a b c d e"), (3, "q r s t u"), (3, "v w x y z")]


@pytest.mark.parametrize("ends", [(0, 2**63 - 1), (-(2**63), 5), (-(2**63), 2**63 - 1)])
def test_ids_at_the_ends(spark, documents, ends):
    a, b = ends
    rows = [(a, "a b c d e"), (b, "a b c d e"), (b, "p q r s t"), (None, "p q r s t"), (b, "k l m n o"), (3, "k l m n o z")]
    assert run(documents(rows)) == brute_classes(rows)


def test_null_ids_only(spark, documents):
    rows = [(None, t) for _, t in corpus(3, groups=4, solo=5)] * 2
    df = documents(rows).repartition(3)
    assert run(df) == brute_classes(rows)
    distinct = list(enumerate(sorted({t for _, t in rows})))
    assert J.deduplicate(df).count() == len({c for _, c, _ in brute_classes(distinct)})


def test_empty_table(spark, documents):
    assert run(documents([])) == []
    assert J.deduplicate(documents([])).count() == 0


def test_hot_group_and_long_text(spark, documents):
    base = " ".join(f"h{i}" for i in range(60))
    rows = [(i, base + f" extra{i} tail{i}") for i in range(120)] + [(500, " ".join(f"z{i}" for i in range(60000))), (501, " ".join(f"z{i}" for i in range(1, 60000)))]
    got = run(documents(rows))
    assert got == sorted([(i, 0, 119) for i in range(120)] + [(500, 500, 1), (501, 500, 1)], key=str)


def test_two_texts_of_200_000_words_exactly(spark, documents):
    rng = random.Random(5)
    a = [f"{rng.randrange(1 << 40):x}" for _ in range(200_000)]
    b = a[:150_000] + [f"{rng.randrange(1 << 40):x}" for _ in range(50_000)]
    sets = [gram_set(" ".join(w), 3) for w in (a, b)]
    (got,) = listed(documents([(1, " ".join(a)), (2, " ".join(b))])).values()
    assert got == round(len(sets[0] & sets[1]) / len(sets[0] | sets[1]), 6)


def test_a_group_of_copies_costs_sets_in_proportion_to_pairs(spark, documents):
    """A tile of k documents is cut into a grid of g by g parts, each of about 2 k / g sets; so k doubled, copies of sets are four times as many at most."""
    rng = random.Random(13)
    base = [rng.choice(VOCAB) for _ in range(30)]
    held = []
    for k in (60, 120):
        rows = [(i, " ".join([*base, f"own{i}", f"own{i}x"])) for i in range(k)]
        assert run(documents(rows), tile_pairs=100) == [(i, 0, k - 1) for i in sorted(range(k), key=lambda i: str((i, 0, k - 1)))]
        g = math.ceil(math.sqrt(k * (k - 1) / 2 / 100))
        held.append(2 * k * g)
    assert held[1] <= 4.5 * held[0]


@pytest.mark.parametrize("dense", [True, False])
def test_overlaps(dense):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 50 if dense else 5000, 30)) for _ in range(40)]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    x, y = np.array([(a, b) for a in range(40) for b in range(a + 1, 40)] if dense else [(a, a + 1) for a in range(39)]).T
    got = J.overlaps(x, y, at, np.concatenate(sets), 5000 if not dense else 50)
    assert got.tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(x, y, strict=True)]


def test_deduplicate_keeps_lowest_of_each_class(spark, documents):
    rows = corpus(4) + [(None, "k"), (None, "k"), (900, None), (901, "")]
    want = sorted({c for i, c, _ in brute_classes(rows) if i is not None})
    got = [r.doc_id for r in J.deduplicate(documents(rows)).collect()]
    assert sorted(i for i in got if i is not None) == want and got.count(None) == 1


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "x long, y long")
    got = {r.id: r.root for r in J.components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_bucket_numbers_have_partitions_of_their_own(spark):
    k = J.even_keys(37)
    df = spark.createDataFrame([(int(v),) for v in k], "k int").repartition(37, "k")
    assert sorted(r[0] for r in df.select(F.spark_partition_id()).collect()) == list(range(37))


def test_frequency_code_keeps_the_order():
    x = np.unique(np.concatenate([np.arange(1, 400), 2 ** np.arange(9, 40)]))
    c = J.frequency_code(x).astype(int)
    assert (np.diff(c) >= 0).all() and (np.diff(c[:127]) > 0).all()


def test_bad_parameters(documents):
    with pytest.raises(ValueError):
        J.join(documents([]), threshold=0)
