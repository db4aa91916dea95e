import random

import corpus_pipeline as P
import pytest

from duskwatch.llm import decontaminate, quality_rules
from duskwatch.llm.common import written
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_ngram_join import brute as brute_pairs

ITEM = "which of these seven rivers flows through the oldest town of the northern province today"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("ba", "ko", "ri", "tu", "me") for b in ("n", "st", "lo", "ra", "", "xi")]
    sentence = lambda n=12: " ".join(rng.choice(words) for _ in range(n)) + "."
    shared = [sentence() for _ in range(4)]
    docs = []
    for i in range(150):
        lines = [sentence() for _ in range(rng.randrange(3, 9))]
        if i % 7 == 0:
            lines[1:1] = shared
        if i % 11 == 0:
            lines.append(ITEM)
        docs.append("\n".join(lines))
    for i in range(0, 150, 10):
        w = docs[i + 1].split(" ")
        w[3] = "edit"
        docs.append(" ".join(w))
    good = len(docs)
    docs += [sentence(40).upper().replace(" ", "!! ") for _ in range(50)]
    d = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(docs)] + [(9000, None, None, None, None), (9001, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < good), 0) for i in range(0, len(docs), 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), docs, good


def test_names_and_columns(spark, tables):
    sf, *_ = tables
    assert [n for n, _ in P.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]


def test_against_brute_force(spark, tables):
    sf, docs, good = tables
    model = quality_rules.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(i, t) for i, t in enumerate(docs) if model.probability([t])[0] >= quality_rules.KEEP_AT]
    assert {i for i, _ in rows} == set(range(good))
    rows = [(i, t) for i, (t, _) in brute_lines(rows).items() if t]
    root = {i: i for i, _ in rows}
    for a, b in sorted(brute_pairs(rows, 3, 0.5)):
        x, y = root[a], root[b]
        for k in root:
            if root[k] in (x, y):
                root[k] = min(x, y)
    rows = [(i, t) for i, t in rows if root[i] == i]
    bench = decontaminate.Benchmark([1], [ITEM])
    rows = [(i, t) for i, t in rows if not decontaminate.find([t], bench)]
    assert not any(ITEM in t for _, t in rows)
    got = {}
    for r in P.run(spark, sf).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.piece_len
    assert got == {i: len(t.encode()) + 1 for i, t in rows}
    assert 0 < len(got) < good


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_null_and_repeated_ids_long_texts_and_clashing_columns(spark, tables, tmp_path):
    """Without labels nothing is rejected for its quality, so every other stage meets the odd rows."""
    sf, docs, _ = tables
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(None, docs[1]), (None, docs[1]), (None, docs[2]), (5, docs[3]), (5, docs[4]), (5, docs[4]), (6, docs[3]), (7, long), (2**63 - 1, long + " end"), (8, None), (None, ""), (9, ITEM), (None, "x " + ITEM)]
    extra = "id long, h long, k long, n long, shard long, key long"
    df = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, 1, 2, 3, 4, 5, 6) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        nxt = stage(spark, out, str(tmp_path))
        assert nxt.columns == df.columns
        out = written(nxt, "stage")
    got = sorted(((r.doc_id, len(r.text)) for r in out.collect()), key=str)
    kept = {(i, t) for i, t in rows if t}
    assert all(any(i == j and n <= len(t) for j, t in kept) for i, n in got)
    assert (7, len(long)) in got and not any(i == 2**63 - 1 for i, _ in got)  # a near copy of a lower id
    assert sum(i == 6 for i, _ in got) == 0 and sum(i == 5 for i, _ in got) == 2  # two texts of one id, each once
    assert sum(i is None for i, _ in got) == 2 and not any(i == 9 for i, _ in got)
    total = {}
    for r in P.run(spark, str(tmp_path)).collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.piece_len
    want = {}
    for r in out.collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + len(r.text.encode()) + 1
    assert total == want
