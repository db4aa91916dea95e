"""Every detection query against its SQL on the smallest tables, and the entry points with and without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from duskwatch.plans import catalog

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def text(v):
    return "null" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = sorted(tuple(text(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name not in catalog.SQL:
        return
    cur = duck.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(df.columns) == sorted(names)
    assert got == sorted(tuple(text(r[i]) for i in order) for r in cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_corpus_operators(tmp_path):
    for p in ("duskwatch", "__spark_entry__.py"):
        src = ROOT / p
        shutil.copytree(src, tmp_path / p, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path / p)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(catalog.QUERIES)), "False"], out.stderr


def test_plans_push_down_and_prune(spark):
    plan = catalog.QUERIES["nrm_port_swap"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "event_type" not in plan.split("ReadSchema")[1]
    plan = catalog.QUERIES["mod_contains"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
