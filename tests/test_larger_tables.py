"""Queries on tables that go beyond the test tables: many users, many slices, odd addresses, against their SQL."""

import datetime
import ipaddress
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from duskwatch.functions import columns as C
from duskwatch.plans import catalog
from duskwatch.streaming import flows


def events(spark, path, rows):
    """An events table of (event_id, user_id, event_type, k)."""
    at = datetime.datetime(2024, 1, 1)
    own = [(i, at, u, t, 1.0, f'{{"k": {k}}}') for i, u, t, k in rows]
    spark.createDataFrame(own, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").repartition(3).write.parquet(f"{path}/events.parquet")
    return str(path)


def same_as_sql(spark, sf, name):
    got = catalog.QUERIES[name](spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf}/events.parquet/*.parquet')")
    cur = con.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted(map(str, cur.fetchall()))
    assert sorted(str(tuple(r[n] for n in names)) for r in got.collect()) == want
    return want


def test_source_ports_beyond_16_bits_are_as_the_sql_has_them(spark, tmp_path):
    """F1.  Users beyond 16,383 have source ports beyond 65,535; the operator by itself keeps to 16 bits."""
    sf = events(spark, tmp_path, [(i, u, "click", i) for i, u in enumerate((0, 16_383, 16_384, 90_000))])
    assert any("139152" in r for r in same_as_sql(spark, sf, "ecs_network"))
    every = catalog._every_event(spark, sf)
    assert sorted(r[0] or 0 for r in catalog.ecs.project(every).select("`source.port`").collect()) == [0, 0, 49_152, 65_535]


@pytest.mark.parametrize("name", ["stream_first_match", "stream_conn_first", "stream_process_state"])
def test_replays_hold_one_slice_at_a_time(spark, tmp_path, monkeypatch, name):
    """F2.  No task sorts or writes the whole table; connections and processes are met in order within slices and beyond them."""
    kinds = ("view", "click", "error", "signup", "purchase", "click")
    sf = events(spark, tmp_path, [(i, i * 7 % 90, kinds[i * 11 % 6], i * 13 % 100) for i in range(900)])
    monkeypatch.setattr(flows, "SLICE_ROWS", 50, raising=False)
    monkeypatch.setattr(flows, "shared_path", lambda spark, name: f"file://{tmp_path}/{name}")
    assert same_as_sql(spark, sf, name)
    files = list((tmp_path / "replay" / "in").glob("part-*"))
    assert len(files) > 2
    if name != "stream_first_match":
        spans = sorted(spark.read.parquet(str(f)).selectExpr("min(seq)", "max(seq)", "count(*)").first() for f in files)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and max(n for *_, n in spans) < 150


def test_an_explanation_tests_each_value_a_few_times(spark, tmp_path):
    """F4.  What a keyword matches is found once a row, not once for each part of the explanation that speaks of it."""
    sf = events(spark, tmp_path, [(i, i, "view", i) for i in range(40)])
    df = catalog.QUERIES["sig_keyword_explain"](spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") < 200, plan.count("translate(")
    assert same_as_sql(spark, sf, "sig_keyword_explain")


def spelled(rng):
    """An IPv6 address in one of its spellings, or nearly one."""
    groups = [rng.choice(["0", "0", "0", "00", "1", "0db8", "FFFF", "a0"]) for _ in range(rng.choice([8, 8, 8, 7, 9, 6]))]
    if rng.random() < 0.3:
        groups[-2:] = [rng.choice(["1.2.3.4", "0.0.0.0", "255.255.255.255", "1.2.3.04", "1.2.3.256"])]
    if rng.random() < 0.2:
        groups = ["0", "0", "0", "0", "0", "fFff", *groups[6:]]
    a, b = sorted((rng.randrange(len(groups) + 1), rng.randrange(len(groups) + 1)))
    t = ":".join(groups[:a]) + "::" + ":".join(groups[b:]) if rng.random() < 0.6 else ":".join(groups)
    i = rng.randrange(len(t) + 1)
    return t[:i] + rng.choice([":", "%e", "g", "\n", "0", "", " "]) + t[i:] if rng.random() < 0.3 else t


def test_addresses_are_read_without_python_workers(spark):
    """F3.  IPv6 text, digits, networks and addresses in texts, as Python's own module reads them."""
    rng = random.Random(3)

    def six(t):
        try:
            a = ipaddress.IPv6Address(t)
        except ValueError:
            return None
        return None if a.scope_id else a

    def canonical(a):
        return f"::ffff:{a.ipv4_mapped}" if a.ipv4_mapped is not None else str(a)

    def inside(t, net):
        try:
            return ipaddress.IPv6Address(t) in ipaddress.ip_network(net)
        except ValueError:
            return False

    odd = ["::", ":", ":::", "1::", "::1", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", "::1%", "::1%e", "::1%e%f", "::1%e/2", "12345::", "1.2.3.4", "::1.2.3.4", "::ffff:0:0", "::1.2.3.4:5", ":1.2.3.4", "٣::", ""]
    texts = odd + [spelled(rng) for _ in range(3000)]
    nets = ["2001:db8::/32", "::/0", "::1/128", "::/5", "::ffff:0:0/96"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").repartition(2)
    t = F.col("t")
    got = df.select("i", C.ipv6_text(t).alias("text"), C.ipv6_bits(t).alias("bits"), F.array(*(C.in_network(t, n) for n in nets)).alias("nets"), C.addresses(F.concat(F.lit("x "), t, F.lit(";y"))).alias("all"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    rows = {r.i: r for r in got.collect()}
    assert rows[len(texts)].text is None and rows[len(texts)].nets == [False] * len(nets)
    assert sum(six(x) is not None for x in texts) > 800
    for i, x in enumerate(texts):
        a, r = six(x), rows[i]
        assert r.text == (None if a is None else canonical(a)), x
        assert r.bits == (None if a is None else f"{int(a):0128b}"), x
        assert r.nets == [inside(x, n) for n in nets], x
        runs = re.findall(r"[0-9A-Fa-f.:]+", f"x {x};y")
        assert r.all == sorted({canonical(b) for y in runs if y.count(":") > 1 and (b := six(y))} | {y for y in runs if re.fullmatch(C.IPV4.replace(r"\A", "").replace(r"\z", ""), y)}), x
