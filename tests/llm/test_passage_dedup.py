import random
import re

import corpus_pipeline as P

from duskwatch.llm.line_dedup import dedup_lines
from duskwatch.llm.passage_dedup import dedup_passages


def covered(rows, n=50):
    """For each id the words that later occurrences of n-word windows cover; rows in order of id."""
    seen: dict = {}
    out = {}
    for i, text in sorted(rows):
        w = re.findall(r"[^ \t\n\r\v\f]+", text)
        own, gone = set(), set()
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if seen.get(key, i) < i or key in own:
                gone |= set(range(k, k + n))
            own.add(key)
            seen.setdefault(key, i)
        out[i] = [x for k, x in enumerate(w) if k not in gone], len(gone)
    return out


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_against_brute_force(spark, documents):
    rng = random.Random(5)
    passages = [words(rng, n) for n in (49, 50, 51, 60, 75, 120)]
    rows = []
    for i in range(80):
        w = words(rng, rng.randrange(0, 200))
        for _ in range(rng.randrange(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k:k] = rng.choice(passages)
        rows.append((i, "".join(x + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for x in w)))
    got = {r.doc_id: (r.text.split(), r.cut) for r in dedup_passages(documents(rows).repartition(5), removed_col="cut").collect()}
    assert got == covered(rows)
    assert sum(c for _, c in got.values()) > 1000


def test_passage_within_one_line(spark, documents):
    rng = random.Random(6)
    text = " ".join(words(rng, 55))
    rows = [(1, f"one line with {text} within"), (2, f"another line\nthat has {text} too\nand an end"), (3, text), (4, None), (5, "")]
    lines = dedup_lines(documents(rows))
    assert sum(text in (r.text or "") for r in lines.collect()) == 3  # whole lines find none of it
    want = {1: rows[0][1], 2: "another line\nthat has too\nand an end", 3: "", 4: None, 5: ""}
    got = dedup_passages(lines).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert {r.doc_id: r.text for r in P.lines(spark, documents(rows), "").collect()} == {1: want[1], 2: want[2]}


def test_hot_windows_are_spread_and_the_first_stays(spark, documents):
    rng = random.Random(8)
    text = [words(rng, 70), words(rng, 55)]
    rows = [(i, " ".join(words(rng, 5) + text[i % 2] + words(rng, 5))) for i in range(120)]
    got = {r.doc_id: (r.text.split(), r.cut) for r in dedup_passages(documents(rows).repartition(5), removed_col="cut", hot=10).collect()}
    assert got == covered(rows)
    assert sum(c > 0 for _, c in got.values()) == 118


def test_rows_without_ids_lose_passages_to_each_other(spark, documents):
    rng = random.Random(9)
    text = " ".join(words(rng, 60))
    got = [r.text for r in dedup_passages(documents([(None, f"own{k} {text}") for k in range(10)])).collect()]
    assert sum(text in t for t in got) == 1 and sum(len(t.split()) == 1 for t in got) == 9


def test_ids_repeats_and_columns(spark, documents):
    rng = random.Random(7)
    text = " ".join(words(rng, 50))
    df = documents([(7, text), (7, text), (None, text), (8, f"{text}\nx\n{text}"), (9, "é " + text)], extra="h,id,m,lo,hi,w")
    got = dedup_passages(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or -1, r.text) for r in got.collect()) == [(-1, ""), (7, text), (7, text), (8, "x"), (9, "é")]
    assert dedup_passages(documents([])).count() == 0
