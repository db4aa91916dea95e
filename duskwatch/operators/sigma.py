"""Sigma rules as Column predicates.

A rule becomes patterns on the driver (literals transformed, wildcards and modifiers resolved), and patterns become one two-valued
predicate, so Catalyst sees nothing but comparisons, LIKE-shaped tests and RLIKE with literal patterns.
"""

from __future__ import annotations

import base64
import ipaddress
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import ALWAYS, FIELDS
from ..sources.rules import SUPPORTED, Catalogue, Rule

_OPS = ("lt", "gt", "le", "ge")
_DASHES = "[-/–—―]"
_SPECIAL = set("\\.+*?()|[]{}^$#&-~")


@dataclass(frozen=True)
class Pattern:
    kind: str  # exact contains startswith endswith regex fieldref cidr lt gt le ge null notnull
    value: Any = None
    cased: bool = False

    @property
    def folds(self) -> bool:
        return self.kind in ("exact", "contains", "startswith", "endswith") and not self.cased

    def test(self, c: Column, other: Callable[[str], Column | None], low: Column | None = None) -> Column:
        """For a present value; `low` is the value in lower case, if it is at hand."""
        k, v = self.kind, self.value
        if k in ("exact", "contains", "startswith", "endswith"):
            a, b = (c, F.lit(v)) if self.cased else (C.ascii_lower(c) if low is None else low, F.lit(C.ascii_lower_text(v)))
            return C.true(a == b if k == "exact" else getattr(F, k)(a, b))
        if k == "regex":
            return C.true(c.rlike(v))
        if k == "fieldref":
            o = other(v)
            return F.lit(False) if o is None else C.true(C.ascii_lower(c) == C.ascii_lower(o))
        if k == "cidr":
            return C.in_network(c, v)
        if k in _OPS:
            x = C.to_float(c)
            return C.true({"lt": x < v, "gt": x > v, "le": x <= v, "ge": x >= v}[k])
        return F.lit(k == "notnull")

    def describe(self) -> tuple[str, str, bool | None]:
        """(type, pattern, case sensitive) for explanations."""
        if self.kind in ("exact", "contains", "startswith", "endswith"):
            return self.kind, self.value, self.cased
        if self.kind in _OPS:
            return "numeric", f"{dict(lt='<', gt='>', le='<=', ge='>=')[self.kind]} {self.value:g}", None
        if self.kind in ("null", "notnull"):
            name = {"null": "null", "notnull": "not_null"}[self.kind]
            return name, name, None
        return self.kind, str(self.value), None


@dataclass
class Criterion:
    field: str
    patterns: list[Pattern]
    every: bool = False

    def test(self, resolve: Callable[[str], Column | None], low: dict[str, Column] | None = None) -> Column:
        missing = any(p.kind == "null" for p in self.patterns)
        c = resolve(self.field)
        if c is None:
            return F.lit(missing)
        lower = (low or {}).get(self.field)
        tests = [p.test(c, resolve, lower) for p in self.patterns]
        same = [p for p in self.patterns if p.kind == "exact" and not p.cased]
        if not self.every and len(same) == len(self.patterns) > 8:  # a long list of values is one set
            tests = [C.true((C.ascii_lower(c) if lower is None else lower).isin([C.ascii_lower_text(p.value) for p in same]))]
        return F.when(c.isNull(), F.lit(missing)).otherwise(C.all_of(tests) if self.every else C.any_of(tests))


@dataclass
class Selection:
    keywords: list[Pattern] = field(default_factory=list)
    groups: list[list[Criterion]] = field(default_factory=list)  # any group, all of its criteria

    def test(self, resolve: Callable[[str], Column | None], values: list[Column], low: dict[str, Column] | None = None) -> Column:
        words = [C.any_of([C.true(v.isNotNull()) & p.test(v, lambda _: None) for v in values]) for p in self.keywords]
        if len(self.groups) == 1 and not words:
            return C.all_of([c.test(resolve, low) for c in self.groups[0]])
        return C.any_of(words + [C.all_of([c.test(resolve, low) for c in g]) for g in self.groups])


@dataclass
class Compiled:
    rule: Rule
    selections: dict[str, Selection]
    tree: tuple | None  # of the condition; None: any selection

    @property
    def bucket(self) -> tuple[str, tuple[int, ...] | None]:
        return SUPPORTED[self.rule.category]

    def results(self, resolve, values, low: dict[str, Column] | None = None) -> dict[str, Column]:
        return {k: s.test(resolve, values, low) for k, s in self.selections.items()}

    def folded(self) -> set[str]:
        """Fields that are compared without regard to case."""
        return {c.field for s in self.selections.values() for g in s.groups for c in g if any(p.folds for p in c.patterns)}

    def predicate(self, low: dict[str, Column] | None = None, seen: tuple | None = None) -> Column:
        """Whether an event of the rule's category matches; `seen` is what `visible` gives for it."""
        resolve, values = seen or visible(self.bucket[0])
        got = self.results(resolve, values, low)
        if self.tree is None:
            return C.any_of(list(got.values()))
        if not names(self.tree) <= set(got):
            return F.lit(False)
        return evaluate(self.tree, got, lambda a, b: a & b, lambda a, b: a | b, lambda a: ~a)


def visible(category: str) -> tuple[Callable[[str], Column | None], list[Column]]:
    """How a field is looked up in events of a category, and the columns that keywords search."""
    cols = {"EventID": F.col("event_id").cast("string"), **{f: F.col(f) for f in ("timestamp", *FIELDS[category])}}
    return cols.get, [cols[f] for f in (*ALWAYS, *FIELDS[category])]


# literals


def wide(s: str, big: bool = False) -> str:
    return "".join(f"\0{c}" if big else f"{c}\0" for c in s)


def base64_forms(s: bytes) -> list[str]:
    """The encodings of a text at each of the three places it can have in a group of bytes."""
    return [base64.b64encode(s).decode(), *(e[4:] for k in (1, 2) if len(e := base64.b64encode(b"\0" * k + s).decode()) > 4)]


def quote(c: str) -> str:
    return "\\" + c if c in _SPECIAL else c


def wildcard(s: str) -> str:
    """A pattern with * and ? as the inside of a regular expression; a backslash before them or itself makes them ordinary."""
    out, i = [], 0
    while i < len(s):
        c = s[i]
        if c == "\\" and i + 1 < len(s) and s[i + 1] in "*?\\":
            out.append(quote(s[i + 1]))
            i += 1
        else:
            out.append({"*": ".*", "?": "."}.get(c) or quote(c))
        i += 1
    return "".join(out)


def whole(inner: str, cased: bool) -> str:
    """Matches the whole value; a point is anything but a line feed."""
    return ("(?d)" if cased else "(?diu)") + r"\A(?:" + inner + r")\z"


def guarded(pattern: str, flags: str) -> str | None:
    """A user's regular expression for Java, with the meaning it has in a linear-time engine; None if such an engine would refuse it."""
    out, i, cls = [], 0, 0
    multi = "m" in flags
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            n = pattern[i + 1 : i + 2]
            if not n or n in "kKGRXCEQ" or (n.isdigit() and n != "0") or n == "Z":
                return None
            out.append(c + n)
            i += 2
            continue
        if cls:
            cls += (c == "[") - (c == "]" and not pattern[i - 1] == "[" and not pattern[i - 2 : i] == "[^")
        elif c == "[":
            cls = 1
        elif c == "(" and pattern[i + 1 : i + 2] == "?":
            if re.match(r"\(\?(=|!|<=|<!|>|\||\()", pattern[i:]):
                return None
            if pattern.startswith("(?P<", i):
                out.append("(?<")
                i += 4
                continue
            if (m := re.match(r"\(\?([a-z]+)", pattern[i:])) and "m" in m[1]:
                multi = True
        elif c in "*+?}" and pattern[i + 1 : i + 2] == "+":
            return None
        elif c == "$" and not multi:
            out.append(r"\z")
            i += 1
            continue
        out.append(c)
        i += 1
    flags = "".join(sorted(set(flags)))
    java = f"(?d{flags}{'u' if 'i' in flags else ''})" + "".join(out)
    try:
        re.compile(re.sub(r"\\z", r"\\Z", re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", "".join(out))))
    except re.error:
        return None
    return java


def text_pattern(s: str, mods: list[str]) -> Pattern:
    cased = "cased" in mods
    if "*" in s or "?" in s:
        return Pattern("regex", whole(wildcard(s), cased))
    for m in ("contains", "startswith", "endswith"):
        if m in mods:
            return Pattern(m, s, cased)
    return Pattern("exact", s, cased)


def _number_text(v: Any) -> str:
    return str(int(v)) if isinstance(v, float) and v.is_integer() and abs(v) < 1e15 else str(v)


def patterns(value: Any, mods: list[str]) -> list[Pattern]:
    """What a field's value or values stand for."""
    if "exists" in mods and (isinstance(value, bool) or value in ("true", "false")):
        return [Pattern("notnull" if value in (True, "true") else "null")]
    if "fieldref" in mods and isinstance(value, str):
        return [Pattern("fieldref", value)]
    out: list[Pattern] = []
    op = next((o for o in _OPS if o in mods or {"le": "lte", "ge": "gte"}.get(o) in mods), None)
    for v in value if isinstance(value, list) else [value]:
        if v is None:
            out.append(Pattern("null"))
        elif isinstance(v, str):
            out += _of_text(v, mods, op)
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            out.append(Pattern(op, float(v)) if op else Pattern("exact", _number_text(v), "cased" in mods))
    return out


def _of_text(v: str, mods: list[str], op: str | None) -> list[Pattern]:
    if v == "":
        return [Pattern("notnull")]
    if "cidr" in mods:
        try:
            return [Pattern("cidr", str(ipaddress.ip_network(v, strict=False)))]
        except ValueError:
            return []
    if op:
        return [Pattern(op, float(v))] if re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?)", v) else []
    if "re" in mods:
        java = guarded(v, "".join(m for m in "ims" if m in mods))
        return [Pattern("regex", java)] if java else []
    if "windash" in mods:
        return [Pattern("regex", whole("".join(_DASHES if c in "-/" else quote(c) for c in v), "cased" in mods))]
    if "wide" in mods or "utf16" in mods or "utf16le" in mods:
        v = wide(v)
    if "utf16be" in mods:
        v = wide(v, big=True)
    if "base64" in mods:
        v = base64.b64encode(v.encode()).decode()
    if "base64offset" in mods:
        return [text_pattern(x, mods) for x in base64_forms(v.encode())]
    return [text_pattern(v, mods)]


def criteria(group: dict) -> list[Criterion]:
    out = []
    for key, value in group.items():
        name, *mods = str(key).split("|")
        out.append(Criterion(name, patterns(value, mods), "all" in mods))
    return out


def selection(value: Any) -> Selection:
    if isinstance(value, dict):
        return Selection(groups=[criteria(value)] if value else [])
    s = Selection()
    if isinstance(value, list):
        for v in value:
            if isinstance(v, dict):
                s.groups.append(criteria(v))
            elif isinstance(v, str):
                s.keywords += patterns(v, [])
    return s


# conditions

_TOKEN = re.compile(r"\s*(?:(\()|(\))|((?:1|all)\s+of\s+(?:them\b|[A-Za-z0-9_]+\*))|([A-Za-z0-9_]+)|(\S))")


def parse_condition(text: str, keys: list[str]) -> tuple:
    """('id', name), ('not', x), ('and', x, y), ('or', x, y)."""
    tokens: list[tuple[str, str]] = []
    at = 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        at = m.end()
        if m[5]:
            raise ValueError(f"{m[5]!r} has no meaning in a condition")
        if m[1] or m[2]:
            tokens.append((m[1] or m[2], ""))
        elif m[3]:
            tokens.append(("quant", m[3]))
        elif m[4] in ("and", "AND", "or", "OR", "not", "NOT"):
            tokens.append((m[4].lower(), ""))
        else:
            tokens.append(("id", m[4]))
    pos = 0

    def peek() -> str:
        return tokens[pos][0] if pos < len(tokens) else ""

    def chain(op: str, below: Callable[[], tuple]) -> tuple:
        nonlocal pos
        x = below()
        while peek() == op:
            pos += 1
            x = (op, x, below())
        return x

    def unit() -> tuple:
        nonlocal pos
        kind, value = tokens[pos] if pos < len(tokens) else ("", "")
        pos += 1
        if kind == "not":
            return ("not", unit())
        if kind == "(":
            x = either()
            if peek() != ")":
                raise ValueError("a bracket is not closed")
            pos += 1
            return x
        if kind == "quant":
            how, _, what = value.split()
            own = keys if what == "them" else [k for k in keys if k.startswith(what[:-1])]
            if not own:
                raise ValueError(f"no selection begins with {what[:-1]!r}")
            x: tuple = ("id", own[0])
            for k in own[1:]:
                x = ("or" if how == "1" else "and", x, ("id", k))
            return x
        if kind == "id":
            return ("id", value)
        raise ValueError("the condition breaks off")

    def both() -> tuple:
        return chain("and", unit)

    def either() -> tuple:
        return chain("or", both)

    if not tokens:
        raise ValueError("the condition is empty")
    out = either()
    if pos < len(tokens):
        raise ValueError("the condition goes on after its end")
    return out


def names(tree: tuple) -> set[str]:
    return {tree[1]} if tree[0] == "id" else set().union(*(names(x) for x in tree[1:]))


def evaluate(tree: tuple, env: dict, conj, disj, neg):
    if tree[0] == "id":
        return env[tree[1]]
    got = [evaluate(x, env, conj, disj, neg) for x in tree[1:]]
    return neg(got[0]) if tree[0] == "not" else (conj if tree[0] == "and" else disj)(*got)


def compile_rule(rule: Rule) -> Compiled:
    sel = {str(k): selection(v) for k, v in rule.detection.items() if k != "condition"}
    if rule.condition is None:
        return Compiled(rule, sel, None)
    bad = [k for k in sel if not re.fullmatch(r"[A-Za-z0-9_]+", k) or k.lower() in ("and", "or", "not")]
    if bad:
        raise ValueError(f"a condition cannot name the selection {bad[0]!r}")
    return Compiled(rule, sel, parse_condition(rule.condition, list(sel)))


# rule sets


class RuleSet:
    """Compiled rules in the order in which they are tried: generic buckets first, then those for some opcodes; each by path and place."""

    def __init__(self, rules: list[Compiled]) -> None:
        self.rules = sorted(rules, key=lambda r: (r.bucket[1] is not None, r.rule.path, r.rule.index))

    @classmethod
    def of(cls, catalogue: Catalogue) -> RuleSet:
        return cls([compile_rule(r) for r in catalogue.rules])

    def lowered(self) -> dict[str, Column]:
        """Lower-case columns, by name, of the fields that more than one rule folds: computed once a row."""
        uses: dict[str, int] = {}
        for r in self.rules:
            for f in r.folded():
                uses[f] = uses.get(f, 0) + 1
        known = {f for own in FIELDS.values() for f in own}
        return {f"__low_{f}": C.ascii_lower(F.col(f)) for f, n in sorted(uses.items()) if n > 1 and f in known}

    def hits(self, low: dict[str, Column] | None = None) -> Column:
        """Indices of the rules that match, in order.  A category's rules are evaluated for its own events only."""
        by: dict[str, list[tuple[int, Compiled]]] = {}
        for i, r in enumerate(self.rules):
            by.setdefault(r.bucket[0], []).append((i, r))
        none = F.array().cast("array<int>")
        out: Column | None = None
        for category, own in by.items():
            tests, seen = [], visible(category)
            for i, r in own:
                p = r.predicate(low, seen)
                if r.bucket[1]:
                    p = C.true(F.col("opcode").isin(*r.bucket[1])) & p
                tests.append(F.when(p, F.lit(i)))
            arr = F.array_compact(F.array(*tests))
            here = F.col("category") == category
            out = F.when(here, arr) if out is None else out.when(here, arr)
        return out.otherwise(none) if out is not None else none

    def match(self, events: DataFrame, every: bool = False) -> DataFrame:
        """Events with `rule` (index), one row for the first rule that matches, or for each.

        The rule array is exploded rather than filtered, so the optimizer has no predicate to copy below the projection."""
        lowered = self.lowered()
        hits = self.hits({n.removeprefix("__low_"): F.col(n) for n in lowered})
        return events.withColumns(lowered).withColumn("rule", F.explode(hits if every else F.slice(hits, 1, 1))).drop(*lowered)

    def table(self, spark) -> DataFrame:
        """(rule, rule_name, rule_description, severity, logsource): as long as the rule set, known on the driver."""
        rows = [(i, r.rule.title, r.rule.description or None, r.rule.severity, r.rule.category) for i, r in enumerate(self.rules)]
        return spark.createDataFrame(rows, "rule int, rule_name string, rule_description string, severity string, logsource string")

    def alerts(self, events: DataFrame, every: bool = False) -> DataFrame:
        return self.match(events, every).join(F.broadcast(self.table(events.sparkSession)), "rule").withColumn("engine", F.lit("Sigma"))
