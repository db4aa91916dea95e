"""Why a rule matched: off, summary (what matched) or full (with the values)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import ALWAYS, FIELDS
from .sigma import Compiled, RuleSet, visible

MOST_FIELDS, MOST_KEYWORDS, MOST_TEXT = 16, 8, 160
FIELD = "struct<selection:string,field:string,matcher:string,pattern_type:string,pattern:string,case_sensitive:boolean,value:string>"
WORD = "struct<selection:string,pattern_type:string,keyword:string,field:string,value:string>"
DETAILS = f"struct<summary:string,condition:string,selection_results:map<string,boolean>,matches:array<{FIELD}>,keyword_matches:array<{WORD}>>"


def cut_text(s: str) -> tuple[str, bool]:
    """At most MOST_TEXT bytes of UTF-8, the last three of them dots if any are missing."""
    raw = s.encode()
    if len(raw) <= MOST_TEXT:
        return s, False
    return raw[: MOST_TEXT - 3].decode(errors="ignore") + "...", True


def cut(c: Column) -> Column:
    """As `cut_text`, counting characters: the same for ASCII."""
    return F.when(F.length(c) > MOST_TEXT, F.concat(F.substring(c, 1, MOST_TEXT - 3), F.lit("..."))).otherwise(c)


def details(r: Compiled, full: bool) -> Column:
    """The explanation of one rule, for events that it matches.  Results of selections and lists of matches are bound: each is evaluated once a row."""
    resolve, values = visible(r.bucket[0])
    names = [*ALWAYS, *FIELDS[r.bucket[0]]]
    found = r.results(resolve, values)
    keys = sorted(found)
    shown = lambda c: cut(c) if full and c is not None else F.lit(None).cast("string")

    def lists(got: Column) -> Column:
        """(f, w): fields and keywords that match; `cut` tells of each whether a text in it is."""
        fields, words = [], []
        for k, key in enumerate(keys):
            s = r.selections[key]
            for p in s.keywords:
                kind, told, _ = p.describe()
                told, long = cut_text(told)
                for name, v in zip(names, values, strict=True):
                    hit = got[k] & C.true(v.isNotNull()) & p.test(v, lambda _: None)
                    over = F.lit(long) | (C.true(F.length(v) > MOST_TEXT) if full else F.lit(False))
                    words.append(F.when(hit, F.struct(F.lit(key).alias("selection"), F.lit(kind).alias("pattern_type"), F.lit(told).alias("keyword"), F.lit(name).alias("field"), shown(v).alias("value"), over.alias("cut"))))
            for group in s.groups:
                whole = got[k] & C.all_of([c.test(resolve) for c in group])
                for c in group:
                    v = resolve(c.field)
                    for p in c.patterns:
                        here = F.lit(p.kind == "null") if v is None else F.when(v.isNull(), F.lit(p.kind == "null")).otherwise(p.test(v, resolve))
                        kind, told, cased = p.describe()
                        told, long = cut_text(told)
                        over = F.lit(long) | (C.true(F.length(v) > MOST_TEXT) if full and v is not None else F.lit(False))
                        fields.append(F.when(whole & here, F.struct(F.lit(key).alias("selection"), F.lit(c.field).alias("field"), F.lit("all" if c.every else "any").alias("matcher"), F.lit(kind).alias("pattern_type"), F.lit(told).alias("pattern"), F.lit(cased).cast("boolean").alias("case_sensitive"), shown(v).alias("value"), over.alias("cut"))))
        some = lambda xs, kind: F.array_compact(F.array(*xs)).cast(f"array<{kind[:-1]},cut:boolean>>") if xs else F.array().cast(f"array<{kind[:-1]},cut:boolean>>")
        return F.struct(some(fields, FIELD).alias("f"), some(words, WORD).alias("w"), got.alias("got"))

    def told(b: Column) -> Column:
        f, w, got = b["f"], b["w"], b["got"]
        condition, long = cut_text(r.rule.condition) if r.rule.condition is not None else (None, False)
        f0, w0 = F.get(f, F.lit(0)), F.get(w, F.lit(0))
        value = lambda x: F.when(x["value"].isNotNull(), F.concat(F.lit(" with value '"), x["value"], F.lit("'"))).otherwise(F.lit(""))
        one = F.when(F.size(f) > 0, F.concat(f0["selection"], F.lit(" matched "), f0["field"], F.lit(" "), f0["pattern_type"], F.lit(" '"), f0["pattern"], F.lit("'"), value(f0))).when(
            F.size(w) > 0, F.concat(w0["selection"], F.lit(" keyword "), w0["pattern_type"], F.lit(" '"), w0["keyword"], F.lit("' in "), w0["field"], value(w0))
        )
        said = F.concat_ws("; ", F.lit(f"condition matched: {condition}") if condition is not None else F.lit(None).cast("string"), one)
        more = F.lit(long) | F.exists(f, lambda x: x["cut"]) | F.exists(w, lambda x: x["cut"]) | (F.size(f) > MOST_FIELDS) | (F.size(w) > MOST_KEYWORDS)
        summary = F.concat(F.when(said == "", F.lit("rule matched")).otherwise(said), F.when(more, F.lit(" (truncated)")).otherwise(F.lit("")))
        results = F.create_map(*(x for k, key in enumerate(keys) for x in (F.lit(key), got[k]))) if keys else F.create_map().cast("map<string,boolean>")
        first = lambda xs, most: F.transform(F.slice(xs, 1, most), lambda x: x.dropFields("cut"))
        return F.struct(summary.alias("summary"), F.lit(r.rule.condition).cast("string").alias("condition"), results.alias("selection_results"), first(f, MOST_FIELDS).alias("matches"), first(w, MOST_KEYWORDS).alias("keyword_matches")).cast(DETAILS)

    return C.let(C.let(F.array(*(found[k] for k in keys)).cast("array<boolean>"), lists), told)


def explain(alerts: DataFrame, rules: RuleSet, level: str = "summary") -> DataFrame:
    """Sigma alerts (with `rule`) with `match`; unchanged if `level` is off."""
    if level == "off":
        return alerts
    out = F.lit(None).cast(DETAILS)
    for i, r in enumerate(rules.rules):
        out = F.when(F.col("rule") == i, details(r, level == "full")).otherwise(out)
    return alerts.withColumn("match", out)
