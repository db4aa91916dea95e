import random

import numpy as np

from duskwatch.llm import language_id as L
from duskwatch.llm import quality_rules as Q

LANGS = {"en": "the and ing tion wh th ed er ly ous".split(), "de": "der die ung sch ein keit ver zu lich ß".split(), "es": "el la ción que ar os ñ ado mente y".split()}


def speak(rng, lang, n=60):
    return " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randrange(1, 3))) for _ in range(n))


def labelled(seed, n=240):
    rng = random.Random(seed)
    return [(i, speak(rng, lang), lang) for i in range(n) for lang in [rng.choice(sorted(LANGS))]]


def frame(spark, rows, extra=False):
    cols = "doc_id long, text string, lang string" + (", predicted int, probability int, t int, y int, id int, k int" if extra else "")
    return spark.createDataFrame([(*r, 0, 0, 0, 0, 0, 0) if extra else r for r in rows], cols)


def test_language_held_out(spark):
    m = L.train(frame(spark, labelled(1)), max_rows=200)
    test = labelled(2, 100)
    got = {r.doc_id: r for r in L.identify(frame(spark, test), m).collect()}
    assert np.mean([got[i].predicted == lang for i, _, lang in test]) > 0.97
    assert all(0 <= r.probability <= 1 for r in got.values())
    assert (m.weights == 0).mean() > 0.3 and 0.05 <= m.temperature <= 20


def test_language_frequencies_against_counting(spark):
    rows = labelled(3, 30)
    df, n = L.document_frequencies(frame(spark, rows).repartition(4))
    want = np.zeros(L.BUCKETS, dtype=int)
    for _, t, _ in rows:
        s = " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " "
        s = " ".join(s.split())
        own = set()
        for nz, _ in L.counts([" ".join(t.split())]):
            own |= set(nz.tolist())
        want[sorted(own)] += 1
        assert s
    assert n == 30 and (df == want).all()


def test_language_counts_of_a_text():
    (nz, c), (none, _), (space, _) = L.counts(["Ab, 12 ab!", None, " 7! "])
    assert c.sum() == 4 + len(" ab ab ") - 1 + len(" ab ab ") - 2 and not len(none) and not len(space)


def test_language_edge_cases(spark):
    rows = [*labelled(4, 60), (900, None, "en"), (901, "", "en"), (902, "123 !?", "de"), (None, "the thing", None), (903, "ß" * 50000, "de"), (5, "twice the same", "en"), (5, "twice the same", "en")]
    df = frame(spark, rows, extra=True)
    got = L.identify(df, L.train(df, max_rows=50)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [(by[i].predicted, by[i].probability) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert by[None].declared is None and by[903].predicted == "de"
    one = frame(spark, [(1, "only english", "en"), (2, None, "en")])
    assert sorted((r.predicted, r.probability) for r in L.identify(one, L.train(one)).collect()) == [("en", None), ("und", 0.0)]
    assert [r.predicted for r in L.identify(frame(spark, [(1, "text", None)]), None).collect()] == ["und"]
    assert L.train(frame(spark, [])) is None and L.identify(frame(spark, []), None).count() == 0


def quality(seed, n=300):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = speak(rng, "en")
        good = rng.random() < 0.7
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", "### "), " ".join(w for w in text.split()[:8] for _ in range(9))])
        out.append((i, text, int(good)))
    return out


def split(spark, rows):
    return frame(spark, [(i, t, "en") for i, t, _ in rows], extra=True), spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")


def test_quality_held_out_and_calibrated(spark):
    m = Q.train(*split(spark, quality(1, 900)), max_rows=800)
    test = quality(2)
    docs, _ = split(spark, test)
    got = {r.doc_id: r for r in Q.score(docs, m).collect()}
    assert np.mean([(got[i].decision == "keep") == bool(y) for i, _, y in test]) > 0.97
    p = np.array([got[i].p_quality for i, *_ in test])
    assert abs(p.mean() - np.mean([y for *_, y in test])) < 0.05
    kept = Q.keep(docs, m)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.decision == "keep"}


def test_quality_batch_score_is_the_sparse_score():
    texts = [t for _, t, _ in quality(3, 40)] + ["", "a", "aa b", "x  y\n\nz z z"]
    rng = np.random.default_rng(0)
    m = Q.Model(rng.normal(size=Q.GROUPS << Q.BITS).astype(np.float32), 0.3, 1.5, -0.2)
    want = [1 / (1 + np.exp(-(1.5 * (m.weights[i] @ v + 0.3) - 0.2))) for i, v in Q.rows(texts)]
    np.testing.assert_allclose(m.probability(texts), want, atol=1e-6)


def test_quality_edge_cases(spark):
    rows = quality(4, 120)
    docs, labels = split(spark, [*rows, (900, None, 1), (901, "  \n", 1), (902, "word " * 60000, 1)])
    labels = labels.union(spark.createDataFrame([(0, 0, 0), (0, 1, 0), (None, 1, 0), (3, None, 0), (5, rows[5][2], 1)], "doc_id long, quality int, toxic int"))
    m = Q.train(docs, labels)
    got = {r.doc_id: r for r in Q.score(docs, m).collect()}
    assert len(got) == 123 and [(got[i].p_quality, got[i].decision) for i in (900, 901)] == [(0.0, "reject")] * 2
    few = labels.limit(3)
    assert Q.train(docs, few) is None
    told = {r.doc_id: (r.p_quality, r.decision) for r in Q.score(docs, None).collect()}
    assert told[1] == (None, "keep") and told[900] == (0.0, "reject")
    none, nolabels = split(spark, [])
    assert Q.train(none, nolabels) is None and Q.score(none, m).count() == 0 and Q.keep(none, m).count() == 0


def test_ftrl_against_plain_python(spark):
    """Features by strings, frequencies by a dictionary, FTRL coordinate by coordinate, temperature by a grid: the same probabilities."""
    import math

    rng = random.Random(21)
    words = {"x": ["ab", "ba", "aab"], "y": ["cb", "bc", "ccb"], "z": ["ac", "ca", "abc"]}
    data = [(i, " ".join(rng.choice(words[y]) for _ in range(rng.randrange(2, 9))) + rng.choice(["", " 12", "!"]), y) for i in range(60) for y in [rng.choice("xyz")]]

    def counted(t):
        s = "".join(c if "a" <= c <= "z" else " " for c in " " + t.lower() + " ")
        while "  " in s:
            s = s.replace("  ", " ")
        out = {}
        for k in (1, 2, 3):
            for i in range(len(s) - k + 1):
                if s[i : i + k] != " ":
                    out[s[i : i + k]] = out.get(s[i : i + k], 0) + 1
        return out

    own = [counted(t) for _, t, _ in data]
    df = {}
    for c in own:
        for g in c:
            df[g] = df.get(g, 0) + 1
    got_df, n = L.document_frequencies(frame(spark, data).repartition(3))
    assert n == 60 and sorted(got_df[got_df > 0].tolist()) == sorted(df.values())  # no two of these n-grams share a bucket
    idf = {g: math.log((1 + n) / (1 + d)) + 1 for g, d in df.items()}

    def vec(c):
        v = {g: (1 + math.log(k)) * idf[g] for g, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {**{g: x / norm for g, x in v.items()}, None: 1.0}

    labels, alpha, beta, l1, l2 = ["x", "y", "z"], 1.0, 1.0, 0.02, 0.02
    z, q = {}, {}

    def weight(g, k):
        zi = z.get((g, k), 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(q.get((g, k), 0.0))) / alpha + l2)

    def logits(v):
        return [sum(x * weight(g, k) for g, x in v.items()) for k in labels]

    def soft(s):
        e = [math.exp(x - max(s)) for x in s]
        return [x / sum(e) for x in e]

    vs = [vec(c) for c in own]
    fitted, out = [i for i in range(60) if i % 5 != 4], [i for i in range(60) if i % 5 == 4]
    order = np.random.default_rng(11)
    for _ in range(3):
        for i in order.permutation(fitted).tolist():
            p = soft(logits(vs[i]))
            for g, x in vs[i].items():
                for k, pk in zip(labels, p, strict=True):
                    grad = x * (pk - (data[i][2] == k))
                    before = q.get((g, k), 0.0)
                    sigma = (math.sqrt(before + grad * grad) - math.sqrt(before)) / alpha
                    w = weight(g, k)
                    z[g, k] = z.get((g, k), 0.0) + grad - sigma * w
                    q[g, k] = before + grad * grad
    scores = [logits(vs[i]) for i in out]
    loss = lambda t: -sum(math.log(soft([x / t for x in s])[labels.index(data[i][2])]) for s, i in zip(scores, out, strict=True))
    best = min((0.05 * 400 ** (k / 3000) for k in range(3001)), key=loss)
    m = L.fit([t for _, t, _ in data], [y for *_, y in data], np.log((1 + n) / (1 + got_df)) + 1)
    for (label, p), v in zip(L.predict(m, [t for _, t, _ in data]), vs, strict=True):
        want = soft([x / best for x in logits(v)])
        assert label == labels[want.index(max(want))] and abs(p - max(want)) < 5e-3


def test_ada_grad_and_platt_against_plain_python():
    """Features by strings and shares of each group, AdaGrad weight by weight, Platt scaling by plain descent: the same probabilities."""
    import math

    rng = random.Random(22)
    good, bad = ["ab", "ba", "cab"], ["dd", "ed", "dead"]

    def text(y):
        out = []
        while len(out) < 8:
            w = rng.choice(good + good + bad if y else bad + bad + good)
            if not out or out[-1] != w:
                out.append(w)
        return " ".join(out)

    ys = [rng.randrange(2) for _ in range(80)]
    texts = [text(y) for y in ys]

    def features(t):
        out, w = {}, t.split()
        for name, own in (("2", [t[i : i + 2] for i in range(len(t) - 1)]), ("3", [t[i : i + 3] for i in range(len(t) - 2)]), ("w", w), ("p", list(zip(w, w[1:], strict=False)))):
            for g in own:
                out[name, g] = out.get((name, g), 0) + 1 / len(own)
        return out

    xs = [features(t) for t in texts]
    w, g2, bias, b2 = {}, {}, 0.0, 1e-8
    order = np.random.default_rng(7)
    fitted = np.array([i for i in range(80) if i % 5 != 4])
    for epoch in range(8):
        rate = 0.5 / (1 + epoch)
        for i in order.permutation(fitted).tolist():
            e = 1 / (1 + math.exp(-(sum(w.get(f, 0.0) * v for f, v in xs[i].items()) + bias))) - ys[i]
            for f, v in xs[i].items():
                g = e * v + 1e-6 * w.get(f, 0.0)
                g2[f] = g2.get(f, 1e-8) + g * g
                w[f] = w.get(f, 0.0) - rate * g / math.sqrt(g2[f])
            b2 += e * e
            bias -= rate * e / math.sqrt(b2)
    raw = [sum(w.get(f, 0.0) * v for f, v in x.items()) + bias for x in xs]
    held = [i for i in range(80) if i % 5 == 4]
    n1 = sum(ys[i] for i in held)
    goal = [(n1 + 1) / (n1 + 2) if ys[i] else 1 / (len(held) - n1 + 2) for i in held]
    a, b = 1.0, 0.0
    for _ in range(200_000):
        p = [1 / (1 + math.exp(-(a * raw[i] + b))) for i in held]
        da, db = sum((x - t) * raw[i] for x, t, i in zip(p, goal, held, strict=True)), sum(x - t for x, t in zip(p, goal, strict=True))
        a, b = a - 0.05 * da, b - 0.05 * db
        if abs(da) + abs(db) < 1e-7:
            break
    m = Q.fit(texts, np.array(ys, dtype=float))
    got = m.probability(texts)
    want = [1 / (1 + math.exp(-(a * s + b))) for s in raw]
    assert max(abs(x - y) for x, y in zip(got, want, strict=True)) < 2e-3
    assert 0.1 < float(np.std(got))


def test_ties(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    m = Q.Model(np.zeros(Q.GROUPS << Q.BITS, dtype=np.float32), 0.0)  # the probability of every text is 0.5
    assert [(r.grade, r.decision) for r in Q.score(docs, m, keep_at=0.5, high_at=0.5).collect()] == [("high", "keep")] * 2
    assert Q.keep(docs, m, keep_at=0.5).count() == 2 and Q.keep(docs, m, keep_at=0.500001).count() == 0
    even = L.Model(["aa", "bb"], np.ones(L.BUCKETS), np.zeros((L.BUCKETS, 2)), np.zeros(2))
    assert L.predict(even, ["abc"]) == [("aa", 0.5)]  # the first in order of the alphabet


def test_an_id_of_many_rows_gives_one_text_and_bytes_are_bounded(spark):
    from duskwatch.llm.common import training_texts

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "x" * 50), (3, "y" * 500), (4, "z")], "id long, t string")
    picked = spark.createDataFrame([(1, 10, 1), (2, 20, 0), (3, 30, 1), (4, 40, 0)], "id long, k long, y int")
    got = training_texts(docs, picked, 10**6).to_pylist()
    assert [r["id"] for r in got] == [1, 2, 3, 4] and got[0]["t"].startswith("text ") and [r["y"] for r in got] == [1, 0, 1, 0]
    assert [r["id"] for r in training_texts(docs, picked, 100).to_pylist()] == [1, 2]
