from duskwatch.llm.line_dedup import dedup_lines


def brute(rows, n=3):
    """Rows in order of id; windows over non-blank lines; later occurrences cover their lines."""
    seen: dict = {}
    out = {}
    for i, text in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        lines = text.split("\n")
        at = [(p, x.strip(" \t\r")) for p, x in enumerate(lines) if x.strip(" \t\r")]
        gone = set()
        for k in range(len(at) - n + 1):
            w = tuple(x for _, x in at[k : k + n])
            if w in seen:
                gone |= {p for p, _ in at[k : k + n]}
            seen.setdefault(w, i)
        out[i] = ("\n".join(x for p, x in enumerate(lines) if p not in gone) if gone else text, len(gone))
    return out


def run(df):
    return {r.doc_id: (r.text, r.cut) for r in dedup_lines(df, removed_col="cut").collect()}


def test_against_brute_force(spark, documents):
    import random

    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["a", "b", " a ", "", "c", "d\r"]) for _ in range(rng.randrange(0, 30)))) for i in range(60)]
    got = run(documents(rows).repartition(5))
    assert got == brute(rows)


def test_edge_cases(spark, documents):
    rows = [(1, None), (2, ""), (3, "a\nb"), (4, "a\nb\nc"), (5, "x\na\n\nb\nc\ny"), (6, "a\nb\nc")]
    got = run(documents(rows))
    assert got[1] == (None, 0) and got[2] == ("", 0) and got[3] == ("a\nb", 0)
    assert got[4] == ("a\nb\nc", 0)
    assert got[5] == ("x\n\ny", 3)  # the blank line stays
    assert got[6] == ("", 3)
    df = dedup_lines(documents(rows)).where("doc_id = 5").first()
    assert df.n_chars == len(df.text)


def test_repeated_rows_and_null_ids(spark, documents):
    rows = [(7, "a\nb\nc\nd"), (7, "a\nb\nc\nd"), (None, "a\nb\nc\nq"), (None, "r\ns\nt"), (None, "r\ns\nt")]
    got = sorted((r.doc_id or -1, r.text) for r in dedup_lines(documents(rows)).collect())
    assert got == [(-1, "q"), (-1, "r\ns\nt"), (-1, "r\ns\nt"), (7, "a\nb\nc\nd"), (7, "a\nb\nc\nd")]


def test_rows_without_ids_and_of_one_id_lose_lines_to_each_other(spark, documents):
    for i in (None, 5):
        rows = [(i, f"own {k}\na\nb\nc\nend {k}") for k in range(20)] + [(2**63 - 1 if i is None else 6, "a\nb\nc")]
        got = [(r.doc_id, r.text) for r in dedup_lines(documents(rows)).collect()]
        whole = [(d, t) for d, t in got if "a\nb\nc" in t]
        assert whole == ([(2**63 - 1, "a\nb\nc")] if i is None else whole) and len(whole) == 1
        assert sorted(t for d, t in got if d == i and "a" not in t.split("\n")) == sorted(f"own {k}\nend {k}" for k in range(20) if f"own {k}\n" not in whole[0][1])


def test_empty_table_and_clashing_columns(spark, documents):
    assert dedup_lines(documents([])).count() == 0
    df = documents([(1, "a\nb\nc"), (2, "a\nb\nc\nd")], extra="h,id,hashes,lo,hi,pos,bucket")
    got = dedup_lines(df)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "a\nb\nc", 2: "d"}


def test_long_text(spark, documents):
    text = "\n".join(f"line {i % 50000}" for i in range(60000))
    got = run(documents([(1, text)]))
    assert got[1][1] == 10000
