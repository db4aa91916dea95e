import fnmatch
import re

import pytest
import yaml
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duskwatch.operators import sigma as S
from duskwatch.operators.explain import explain
from duskwatch.schema import TELEMETRY
from duskwatch.sources.rules import SUPPORTED, Catalogue, add, load, to_rule


def rule(detection, category="process_creation", **more):
    return S.compile_rule(to_rule({"title": "r", "logsource": {"category": category}, "detection": detection, **more}))


def events(spark, rows, category="Process"):
    base = {f.name: None for f in TELEMETRY.fields}
    return spark.createDataFrame([tuple({**base, "seq": i, "timestamp": "t", "category": category, "event_id": 1, "opcode": 1, "header_pid": 9, **r}.values()) for i, r in enumerate(rows)], TELEMETRY)


def hits(spark, detection, rows, category="process_creation"):
    return [r.seq for r in S.RuleSet([rule(detection, category)]).match(events(spark, rows, SUPPORTED[category][0])).orderBy("seq").collect()]


def values(spark, key, value, texts):
    return hits(spark, {"s": {key: value}}, [{"CommandLine": t} for t in texts])


@pytest.mark.parametrize(
    "key,value,texts,want",
    [
        ("CommandLine", "whoami.exe", ["WHOAMI.EXE", "whoami.exe ", None, "É"], [0]),
        ("CommandLine|cased", "whoami.exe", ["WHOAMI.EXE", "whoami.exe"], [1]),
        ("CommandLine", "É", ["é", "É"], [1]),  # only ASCII folds
        ("CommandLine|contains|all", ["foo", "bar"], ["foo baz", "FOO bar baz", None], [1]),
        ("CommandLine|contains", "a*c", ["xabcx", "abc", "aXXc"], [1, 2]),  # a wildcard takes the whole value
        ("CommandLine", r"a\*b", ["a*b", "axb"], [0]),
        ("CommandLine", r"a\\*", ["a\\", "a\\zz", "a"], [0, 1]),
        ("CommandLine", r"C:\\x", ["C:\\x", "C:\\\\x"], [1]),  # no unescaping without a wildcard
        ("CommandLine", "a?c", ["abc", "ac", "a\nc", "a\rc"], [0, 3]),
        ("CommandLine|re", "^ab$", ["ab", "ab\n", "AB"], [0]),
        ("CommandLine|re|i", "é+$", ["xÉÉ", "e"], [0]),
        ("CommandLine|re|m", "^b$", ["a\nb\nc", "ab"], [0]),
        ("CommandLine|re", "(?=a)a", ["a"], []),
        ("CommandLine|re", r"(a)\1", ["aa"], []),
        ("CommandLine|re", "a++", ["aa"], []),
        ("CommandLine|windash|contains", "x -f", ["x /f", "x –f", "a x -f"], [0, 1]),
        ("CommandLine|exists", True, ["", None, "x"], [0, 2]),
        ("CommandLine|exists", "false", ["", None], [1]),
        ("CommandLine", None, ["", None], [1]),
        ("CommandLine", "", ["", None, "x"], [0, 2]),
        ("CommandLine|gt", 5, ["6", "5", " 6 ", "6d", "NaN", "1e1", "inf", "x"], [0, 5, 6]),
        ("CommandLine|lte", "5.5", ["5.5", "6", "-1"], [0, 2]),
        ("CommandLine|contains", 44, ["44", "x44"], [0]),
        ("CommandLine", True, ["true"], []),
        ("CommandLine|all", True, ["true", None], [0]),
        ("CommandLine|base64", "foo", ["Zm9v", "zm9V", "foo"], [0, 1]),
        ("CommandLine|base64offset|contains", "foobar", ["xx" + x for x in ("Zm9vYmFy", "b29iYXI", "Zvb2Jhcg")], [0]),
        ("CommandLine|wide|base64|contains", "IEX", ["-enc SQBFAFgA"], [0]),
        ("CommandLine|utf16be", "a", ["\0a", "a\0"], [0]),
        ("CommandLine|cidr", ["10.0.0.0/8", "2001:db8::/32", "nonsense"], ["10.1.2.3", "010.1.2.3", "11.0.0.1", "2001:DB8::1", "::1"], [0, 3]),
        ("CommandLine|startswith", ["a", "B"], ["Ax", "bx", "c"], [0, 1]),
        ("CommandLine|endswith", "x", ["aX", "xa"], [0]),
    ],
)
def test_matchers(spark, key, value, texts, want):
    assert values(spark, key, value, texts) == want


def test_field_reference_scope_and_unknown_fields(spark):
    rows = [{"CommandLine": "A", "ParentCommandLine": "a"}, {"CommandLine": "A"}, {"CommandLine": None, "ParentCommandLine": None}]
    assert hits(spark, {"s": {"CommandLine|fieldref": "ParentCommandLine"}}, rows) == [0]
    assert hits(spark, {"s": {"CommandLine|fieldref": ["A"]}}, rows) == [0, 1]  # a list is literal
    assert hits(spark, {"s": {"QueryName": "x"}}, [{"QueryName": "x"}]) == []  # not a field of processes
    assert hits(spark, {"s": {"QueryName": None}}, [{"QueryName": "x"}]) == [0]
    assert hits(spark, {"s": {"EventID": 1, "timestamp": "T"}}, [{}]) == [0]


def test_missing_fields_and_negation(spark):
    d = {"a": {"CommandLine|contains": "x"}, "condition": "not a"}
    assert hits(spark, d, [{"CommandLine": None}, {"CommandLine": "x"}, {"CommandLine": "y"}]) == [0, 2]


def test_long_value_list_is_one_set(spark):
    vals = [f"V{i}" for i in range(40)]
    assert values(spark, "CommandLine", vals, ["v7", "V41", None]) == [0]


@pytest.mark.parametrize(
    "text,want",
    [
        ("(a or b) and not c", ("and", ("or", ("id", "a"), ("id", "b")), ("not", ("id", "c")))),
        ("a OR b AND NOT c", ("or", ("id", "a"), ("and", ("id", "b"), ("not", ("id", "c"))))),
        ("all of selection*", ("and", ("id", "selection1"), ("id", "selection2"))),
        ("1 of them", ("or", ("or", ("or", ("or", ("or", ("id", "a"), ("id", "b")), ("id", "c")), ("id", "selection1")), ("id", "selection2")), ("id", "_x"))),
    ],
)
def test_conditions(text, want):
    assert S.parse_condition(text, ["a", "b", "c", "selection1", "selection2", "_x"]) == want


@pytest.mark.parametrize("text", ["", "a and", "(a", "a b", "1 of nope*", "2 of them and a)", "a | b", "a And b", "1 of a"])
def test_bad_conditions(text):
    with pytest.raises(ValueError):
        S.parse_condition(text, ["a", "b"])


def test_catalogue_and_gates(tmp_path):
    files = {
        "a.yml": "title: a\nlevel: high\nlogsource: {category: ' Process_Creation ', product: Windows}\ndetection: {s: {Image: x}, condition: s}",
        "sub/b.yaml": "title: b\nlogsource: {category: process_creation, product: linux}\ndetection: {s: {Image: x}}",
        "c.yml": "title: c\nlogsource: {category: dns_query, service: cloudtrail}\ndetection: {s: {Image: x}}",
        "d.yml": "title: d\nlogsource: {category: process_tampering}\ndetection: {s: {Image: x}, condition: '('}",
        "e.yml": "title: e\nlogsource: {category: dns_query}\ndetection: {s: {Image: x}, condition: '('}",
        "f.yml": "title: f\ntitle: g\n",
        "g.yml": "action: global\ntitle: g\ndetection: {condition: s}\n---\nlogsource: {category: file_event}\ndetection: {s: {Image: x}}\n---\nlogsource: {category: dns_query}\ndetection: {t: {Image: x}, condition: (}\n---\nlogsource: {category: file_event}\ndetection: {s: {Image: x}}",
        "h.yml": "title: h\nlogsource: {category: image_load}\ndetection: {s: {Signed: yes}}\n---\ntitle: ignored",
        "i.yml": "title: i\nlogsource: {category: image_load}\ndetection: {s: {Signed: x}, condition: [s, s]}",
        "note.txt": "no rule",
    }
    for name, text in files.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    cat = load(str(tmp_path), S.compile_rule)
    assert [r.title for r in cat.rules] == ["a", "g", "h"]
    assert cat.rules[0].severity == "High" and cat.rules[1].severity == "Low"
    assert cat.skipped == {"category": 1, "product": 1, "service": 1}
    assert sorted(p.rsplit("/", 1)[1] for p, _ in cat.failed) == ["e.yml", "f.yml", "g.yml", "i.yml"]
    assert S.compile_rule(cat.rules[2]).selections["s"].groups[0][0].patterns[0].value == "yes"  # YAML 1.2 booleans
    assert dict(cat.stats())["total"] == 3


def test_first_match_order_and_all(spark):
    rules = []
    for i, (cat, level) in enumerate([("file_create", "high"), ("file_event", "medium"), ("file_event", "CRITICAL")]):
        r = rule({"s": {"TargetFilename|contains": "x"}}, cat, level=level)
        r.rule.title, r.rule.index = f"r{i}", i
        rules.append(r)
    rs = S.RuleSet(rules)
    ev = events(spark, [{"TargetFilename": "x", "opcode": 64}, {"TargetFilename": "x", "opcode": 70}, {"TargetFilename": "y", "opcode": 64}], "File")
    assert [(r.seq, r.rule_name, r.severity) for r in rs.alerts(ev).collect()] == [(0, "r1", "Medium"), (1, "r1", "Medium")]
    assert sorted((r.seq, r.rule_name) for r in rs.alerts(ev, every=True).collect()) == [(0, "r0"), (0, "r1"), (0, "r2"), (1, "r1"), (1, "r2")]
    assert S.RuleSet([]).alerts(ev).count() == 0


def test_explanations(spark):
    d = yaml.safe_load("{a: {Image|endswith: '\\cmd.exe', CommandLine|contains: [q, r]}, k: [high], condition: a or k}")
    rs = S.RuleSet([rule(d)])
    ev = events(spark, [{"Image": "C:\\CMD.exe", "CommandLine": "r" + "z" * 300}, {"IntegrityLevel": "High"}])
    full = {r.seq: r.match for r in explain(rs.alerts(ev), rs, "full").collect()}
    assert full[0].summary == "condition matched: a or k; a matched Image endswith '\\cmd.exe' with value 'C:\\CMD.exe' (truncated)"
    assert [m.pattern for m in full[0].matches] == ["\\cmd.exe", "r"] and len(full[0].matches[1].value) == 160
    assert full[0].selection_results == {"a": True, "k": False}
    assert full[1].summary == "condition matched: a or k; k keyword exact 'high' in IntegrityLevel with value 'High'"
    short = explain(rs.alerts(ev), rs, "summary").where("seq = 0").first().match
    assert short.matches[0].value is None and not short.summary.endswith("(truncated)")
    assert "match" not in explain(rs.alerts(ev), rs, "off").columns


def model(p, v):
    """A pattern on a present value, in plain Python."""
    fold = (lambda s: s) if p.cased else (lambda s: "".join(c.lower() if c.isascii() else c for c in s))
    a, b = fold(v), fold(p.value) if isinstance(p.value, str) else p.value
    return {"exact": lambda: a == b, "contains": lambda: b in a, "startswith": lambda: a.startswith(b), "endswith": lambda: a.endswith(b)}[p.kind]()


_text = st.text(alphabet="aAbB\\.-/ é*?", max_size=6)


@settings(deadline=None, max_examples=15)
@given(st.lists(st.tuples(st.sampled_from(["", "contains", "startswith", "endswith"]), st.booleans(), _text.filter(lambda s: s and "*" not in s and "?" not in s)), min_size=1, max_size=12), st.lists(_text, min_size=1, max_size=8))
def test_patterns_against_plain_python(spark, patterns, texts):
    mods = [[m for m in (k, "cased" if c else "") if m] for k, c, _ in patterns]
    ps = [S.patterns(v, m)[0] for m, (_, _, v) in zip(mods, patterns, strict=True)]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = df.select(*(p.test(F.col("v"), lambda _: None).alias(f"p{i}") for i, p in enumerate(ps))).collect()
    assert [list(r) for r in got] == [[model(p, t) for p in ps] for t in texts]


@settings(deadline=None, max_examples=15)
@given(st.lists(st.text(alphabet="ab*?.+(", min_size=1, max_size=6), min_size=1, max_size=6), st.lists(st.text(alphabet="abAB.+(", max_size=6), min_size=1, max_size=8))
def test_wildcards_against_fnmatch(spark, globs, texts):
    globs = [g for g in globs if "*" in g or "?" in g]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    if globs:
        got = df.select(*(S.text_pattern(g, []).test(F.col("v"), lambda _: None).alias(f"p{i}") for i, g in enumerate(globs))).collect()
        assert [list(r) for r in got] == [[bool(re.fullmatch(fnmatch.translate(g), t, re.I | re.A)) for g in globs] for t in texts]


def test_compile_is_two_valued_for_any_condition(spark):
    ev = events(spark, [{"CommandLine": None}, {"CommandLine": "a"}, {"CommandLine": "b"}])
    for cond in ("a", "not a", "a or not b", "not (a and b)", "1 of them", "not all of them"):
        r = rule({"a": {"CommandLine": "a"}, "b": {"CommandLine|re": "b"}, "condition": cond})
        assert ev.where(r.predicate().isNull()).count() == 0


def test_one_bad_file_keeps_the_rules_before_it():
    cat = Catalogue()
    add(cat, "action: global\ntitle: g\n---\nlogsource: {category: file_event}\ndetection: {s: {Image: x}}\n---\nlogsource: 7\ndetection: {s: {Image: x}}", "p", S.compile_rule)
    assert len(cat.rules) == 1 and len(cat.failed) == 1
