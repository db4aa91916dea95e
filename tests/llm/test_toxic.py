import random

import corpus_pipeline as P

from duskwatch.llm import quality_rules as Q

SLURS = ["idjit", "numpty", "wazzock", "pillock"]


def rows(seed, n, first=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = [f"word{rng.randrange(400)}" for _ in range(rng.randrange(30, 200))]
        bad = rng.random() < 0.2
        for _ in range(2 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(SLURS))
        out.append((first + i, " ".join(w), int(bad)))
    return out


def test_toxic_rows_of_good_quality_are_rejected(spark, documents, tmp_path):
    train, test = rows(1, 600), rows(2, 300, first=1000)
    docs = documents([(i, t) for i, t, _ in train + test] + [(5000, None), (5001, " ")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in train], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    toxic = Q.train_toxic(docs, labels)
    got = {r.doc_id: r for r in Q.score(docs, None, toxic=toxic).collect()}
    bad, clean = [i for i, _, y in test if y], [i for i, _, y in test if not y]
    assert sum(got[i].decision == "reject" and got[i].p_toxic >= Q.TOXIC_AT for i in bad) > 0.95 * len(bad)
    assert sum(got[i].decision == "keep" for i in clean) > 0.98 * len(clean)
    assert [(got[i].p_toxic, got[i].decision) for i in (5000, 5001)] == [(0.0, "reject")] * 2
    kept = {r.doc_id for r in P.quality(spark, docs, str(tmp_path)).collect()}
    assert kept == {i for i, r in got.items() if r.decision == "keep"}
    none = Q.train_toxic(docs, labels.withColumn("toxic", labels.quality * 0))
    assert none is None and {r.p_toxic for r in Q.score(docs, None).where("doc_id < 5000").collect()} == {None}
    assert Q.MAX_ROWS == 6000
