"""Content rules in a subset of YARA: text (nocase, ascii, wide, fullword), hexadecimal and regular-expression strings, and conditions with and, or, not,
`any/all/none/N of`, counts, `at`, `in`, filesize and the usual comparisons.

Rules whose strings are plain text can be evaluated on a text column as native predicates (`text_hits`).  Anything else runs over binary content in
Arrow batches (`scan`), one compiled byte expression for each string and worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C

MOST_STRINGS = 8
SNIPPET = 80
MATCH = "struct<rule:string,tags:array<string>,namespace:string,strings:array<struct<id:string,offset:bigint,snippet:string>>>"


@dataclass
class String:
    id: str
    kind: str  # text hex regex
    value: str
    mods: tuple[str, ...] = ()

    def expression(self) -> re.Pattern[bytes]:
        flags = re.DOTALL if self.kind == "hex" or "s" in self.mods else 0
        if self.kind == "text":
            raw = self.value.encode("latin-1", "replace") if all(ord(c) < 256 for c in self.value) else self.value.encode()
            forms = []
            if "wide" not in self.mods or "ascii" in self.mods:
                forms.append(self._bounded(re.escape(raw), b""))
            if "wide" in self.mods:
                forms.append(self._bounded(b"".join(re.escape(bytes([b])) + b"\\x00" for b in raw), b"\\x00"))
            body = b"|".join(forms)
        elif self.kind == "hex":
            body = hex_expression(self.value)
        else:
            body = self._bounded(self.value.encode(), b"")
        if "nocase" in self.mods or "i" in self.mods:
            flags |= re.IGNORECASE
        return re.compile(b"(?=(" + body + b"))", flags)

    def _bounded(self, body: bytes, pad: bytes) -> bytes:
        if "fullword" not in self.mods:
            return body
        return (b"(?<![A-Za-z0-9_])" if not pad else b"(?<![A-Za-z0-9_]\\x00)") + b"(?:" + body + b")(?![A-Za-z0-9_]" + pad + b")"


@dataclass
class Rule:
    name: str
    condition: tuple
    strings: list[String] = field(default_factory=list)
    tags: tuple[str, ...] = ()
    meta: dict[str, Any] = field(default_factory=dict)
    namespace: str = "default"


def hex_expression(text: str) -> bytes:
    """`E2 ?4 ?? [2-4] ( A1 | B2 B3 )` as a byte expression."""
    out = b""
    for t in re.findall(r"\[[^\]]*\]|~?[0-9A-Fa-f?]{2}|[()|]|\S", re.sub(r"//[^\n]*|/\*.*?\*/", " ", text, flags=re.S)):
        if t.startswith("["):
            lo, dash, hi = t[1:-1].replace(" ", "").partition("-")
            out += f"[\\x00-\\xff]{{{lo or 0}{',' if dash else ''}{hi}}}".encode()
        elif t in ("(", ")", "|"):
            out += {"(": b"(?:", ")": b")", "|": b"|"}[t]
        elif t == "??":
            out += b"[\\x00-\\xff]"
        elif re.fullmatch(r"~?[0-9A-Fa-f?]{2}", t):
            neg, t = t.startswith("~"), t.lstrip("~")
            own = [b for b in range(256) if all(p in ("?", q) for p, q in zip(t.upper(), f"{b:02X}", strict=True))]
            out += b"[" + b"^" * neg + b"".join(f"\\x{b:02x}".encode() for b in own) + b"]"
        else:
            raise ValueError(f"{t!r} has no meaning in a hexadecimal string")
    return out


# parsing

_LEX = re.compile(
    r"""\s+|//[^\n]*|/\*.*?\*/
    |(?P<str>"(?:\\.|[^"\\])*")
    |(?P<num>0x[0-9A-Fa-f]+|[0-9]+(?:KB|MB)?)
    |(?P<id>[$#@!][A-Za-z0-9_]*\*?|[A-Za-z_][A-Za-z0-9_.]*)
    |(?P<op>==|!=|<=|>=|\.\.|[(){}\[\]:=<>,|+\-*/?~])""",
    re.X | re.S,
)


def unescape(s: str) -> str:
    return re.sub(r"\\(x[0-9A-Fa-f]{2}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "x" and len(m[1]) == 3 else {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), s)


class _Parser:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def skip(self) -> None:
        while (m := _LEX.match(self.text, self.at)) and m.lastgroup is None and m.end() > self.at:
            self.at = m.end()

    def peek(self) -> tuple[str, str]:
        self.skip()
        m = _LEX.match(self.text, self.at)
        return (m.lastgroup, m[0]) if m and m.lastgroup else ("", self.text[self.at : self.at + 1])

    def next(self, want: str | None = None) -> tuple[str, str]:
        got = self.peek()
        if not got[0] or want is not None and got[1] != want:
            raise ValueError(f"{want or 'more'} expected, not {got[1]!r}")
        self.at = _LEX.match(self.text, self.at).end()
        return got

    def rules(self, namespace: str) -> list[Rule]:
        out = []
        while self.peek()[1]:
            while self.peek()[1] in ("private", "global"):
                self.next()
            if self.peek()[1] in ("import", "include"):
                self.next()
                self.next()
                continue
            out.append(self.rule(namespace))
        return out

    def rule(self, namespace: str) -> Rule:
        self.next("rule")
        name = self.next()[1]
        tags, meta, strings = [], {}, []
        if self.peek()[1] == ":":
            self.next()
            while self.peek()[1] != "{":
                tags.append(self.next()[1])
        self.next("{")
        condition = None
        while self.peek()[1] != "}":
            part = self.next()[1]
            self.next(":")
            if part == "meta":
                while self.peek()[0] == "id" and self.peek()[1] not in ("strings", "condition"):
                    k = self.next()[1]
                    self.next("=")
                    kind, v = self.next()
                    meta[k] = unescape(v[1:-1]) if kind == "str" else v
            elif part == "strings":
                while self.peek()[1].startswith("$"):
                    strings.append(self.string())
            elif part == "condition":
                condition = self.either()
            else:
                raise ValueError(f"{part!r} is no part of a rule")
        self.next("}")
        if condition is None:
            raise ValueError(f"{name} has no condition")
        return Rule(name, condition, strings, tuple(tags), meta, namespace)

    def string(self) -> String:
        ident = self.next()[1]
        self.next("=")
        self.skip()
        c = self.text[self.at]
        if c == '"':
            kind, value = "text", unescape(self.next()[1][1:-1])
        elif c == "{":
            end = self.text.index("}", self.at)
            kind, value = "hex", self.text[self.at + 1 : end]
            self.at = end + 1
            hex_expression(value)
        elif c == "/":
            m = re.compile(r"/((?:\\.|[^/\\\n])+)/([is]*)").match(self.text, self.at)
            if not m:
                raise ValueError(f"{ident} is no expression")
            kind, value, self.at = "regex", m[1], m.end()
            return String(ident, kind, value, tuple(m[2]) + self.modifiers())
        else:
            raise ValueError(f"{ident} has no value")
        return String(ident, kind, value, self.modifiers())

    def modifiers(self) -> tuple[str, ...]:
        out = []
        while self.peek()[1] in ("nocase", "wide", "ascii", "fullword", "private"):
            out.append(self.next()[1])
        return tuple(out)

    def either(self) -> tuple:
        x = self.both()
        while self.peek()[1] == "or":
            self.next()
            x = ("or", x, self.both())
        return x

    def both(self) -> tuple:
        x = self.unit()
        while self.peek()[1] == "and":
            self.next()
            x = ("and", x, self.unit())
        return x

    def number(self) -> int:
        v = self.next()[1]
        scale = {"KB": 1024, "MB": 1 << 20}.get(v[-2:], 1)
        return int(v.removesuffix("KB").removesuffix("MB"), 0 if v.startswith("0x") else 10) * scale

    def string_set(self) -> list[str]:
        if self.peek()[1] == "them":
            self.next()
            return ["$*"]
        self.next("(")
        out = [self.next()[1]]
        while self.peek()[1] == ",":
            self.next()
            out.append(self.next()[1])
        self.next(")")
        return out

    def unit(self) -> tuple:
        kind, t = self.peek()
        if t == "not":
            self.next()
            return ("not", self.unit())
        if t == "(":
            self.next()
            x = self.either()
            self.next(")")
            return x
        if t in ("true", "false"):
            self.next()
            return ("const", t == "true")
        if t in ("any", "all", "none"):
            self.next()
            self.next("of")
            return ("of", t, self.string_set())
        if kind == "num":
            n = self.number()
            if self.peek()[1] == "of":
                self.next()
                return ("of", n, self.string_set())
            op = self.next()[1]
            return ("cmp", {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op), self.quantity(), n)
        if t.startswith("$"):
            self.next()
            nxt = self.peek()[1]
            if nxt == "at":
                self.next()
                return ("at", t, self.number())
            if nxt == "in":
                self.next()
                self.next("(")
                lo = self.number()
                self.next("..")
                hi = self.number()
                self.next(")")
                return ("in", t, lo, hi)
            return ("found", t)
        left = self.quantity()
        op = self.next()[1]
        return ("cmp", op, left, self.number())

    def quantity(self) -> tuple:
        kind, t = self.next()
        if t == "filesize":
            return ("size",)
        if t.startswith("#"):
            return ("count", "$" + t[1:])
        raise ValueError(f"{t!r} has no meaning in a condition")


def parse(text: str, namespace: str = "default") -> list[Rule]:
    out = _Parser(text).rules(namespace)
    for r in out:
        have = {s.id for s in r.strings}
        for used in _used(r.condition):
            if used.endswith("*"):
                if used != "$*" and not any(h.startswith(used[:-1]) for h in have):
                    raise ValueError(f"{r.name}: nothing matches {used}")
            elif used not in have:
                raise ValueError(f"{r.name}: {used} is not defined")
        for s in r.strings:
            try:
                s.expression()
            except re.error as e:
                raise ValueError(f"{r.name}: {s.id}: {e}") from e
    return out


def _used(c: tuple) -> Iterator[str]:
    if c[0] in ("found", "at", "in", "count"):
        yield c[1]
    elif c[0] == "of":
        yield from c[2]
    else:
        for x in c[1:]:
            if isinstance(x, tuple):
                yield from _used(x)


def load(folder: str) -> tuple[list[Rule], list[tuple[str, str]]]:
    """Rules of the .yar and .yara files in a folder, not below it, and what could not be read."""
    rules: list[Rule] = []
    failed: list[tuple[str, str]] = []
    for p in sorted(Path(folder).glob("*")) if Path(folder).is_dir() else []:
        if p.is_file() and p.suffix in (".yar", ".yara"):
            try:
                rules += parse(p.read_text(), p.stem)
            except (ValueError, OSError) as e:
                failed.append((str(p), str(e)))
    return rules, failed


# evaluation

_CMP = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


def _members(rule: Rule, names: list[str]) -> list[str]:
    out = []
    for n in names:
        out += [s.id for s in rule.strings if (s.id.startswith(n[:-1]) if n.endswith("*") else s.id == n)]
    return list(dict.fromkeys(out))


def holds(rule: Rule, c: tuple, places: dict[str, list[int]], size: int) -> bool:
    k = c[0]
    if k in ("and", "or"):
        a = holds(rule, c[1], places, size)
        return (a and holds(rule, c[2], places, size)) if k == "and" else (a or holds(rule, c[2], places, size))
    if k == "not":
        return not holds(rule, c[1], places, size)
    if k == "const":
        return c[1]
    if k == "found":
        return bool(places[c[1]])
    if k == "at":
        return c[2] in places[c[1]]
    if k == "in":
        return any(c[2] <= p <= c[3] for p in places[c[1]])
    if k == "of":
        own = _members(rule, c[2])
        n = sum(bool(places[m]) for m in own)
        return n == 0 if c[1] == "none" else n >= (1 if c[1] == "any" else len(own) if c[1] == "all" else c[1])
    left = size if c[2][0] == "size" else len(places[c[2][1]])
    return _CMP[c[1]](left, c[3])


def matches(rules: list[tuple[Rule, list[tuple[String, re.Pattern[bytes]]]]], data: bytes, detail: str = "full") -> list[dict]:
    out = []
    for rule, strings in rules:
        places = {s.id: [m.start() for m in e.finditer(data)] for s, e in strings}
        if not holds(rule, rule.condition, places, len(data)):
            continue
        shown = []
        if detail == "full":
            for s, e in strings:
                for p in places[s.id]:
                    if len(shown) < MOST_STRINGS:
                        shown.append({"id": s.id, "offset": p, "snippet": e.match(data, p)[1][:SNIPPET].decode("latin-1")})
        told = detail != "off"
        out.append({"rule": rule.name, "tags": list(rule.tags) if told else [], "namespace": rule.namespace if told else None, "strings": shown})
    return out


def scan(files: DataFrame, rules: list[Rule], content: str = "content", detail: str = "full") -> DataFrame:
    """`files` without their content, one row for each rule that matches, with `yara`."""
    keep = [c for c in files.columns if c != content]
    schema = T.StructType([*files.select(*keep).schema.fields, *T.StructType.fromDDL(f"yara {MATCH}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(r, [(s, s.expression()) for s in r.strings]) for r in rules]
        kind = pa.struct([("rule", pa.string()), ("tags", pa.list_(pa.string())), ("namespace", pa.string()), ("strings", pa.list_(pa.struct([("id", pa.string()), ("offset", pa.int64()), ("snippet", pa.string())])))])
        for b in batches:
            rows, got = [], []
            for i, data in enumerate(b.column(len(keep)).to_pylist()):
                for m in matches(compiled, data, detail) if data is not None else ():
                    rows.append(i)
                    got.append(m)
            if rows:
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(rows)) for k in range(len(keep))), pa.array(got, kind)], names=[*keep, "yara"])

    return files.select(*keep, content).mapInArrow(run, schema)


def text_count(s: String, c: Column) -> Column:
    """Occurrences of a text string in a text column, overlapping ones included."""
    body = re.sub(r"([\\.+*?()|\[\]{}^$])", r"\\\1", s.value)
    if "fullword" in s.mods:
        body = f"(?<![A-Za-z0-9_]){body}(?![A-Za-z0-9_])"
    return F.regexp_count(c, F.lit(("(?i)" if "nocase" in s.mods else "") + f"(?={body})"))


def text_found(s: String, c: Column) -> Column:
    if "fullword" in s.mods:
        return text_count(s, c) > 0
    return F.contains(C.ascii_lower(c), F.lit(C.ascii_lower_text(s.value))) if "nocase" in s.mods else F.contains(c, F.lit(s.value))


def text_predicate(rule: Rule, c: Column) -> Column:
    """A rule of plain text strings as a predicate on text; `filesize` is the length in UTF-8."""
    if any(s.kind != "text" or "wide" in s.mods and "ascii" not in s.mods for s in rule.strings):
        raise ValueError(f"{rule.name} needs bytes: use scan")
    by = {s.id: s for s in rule.strings}

    def go(x: tuple) -> Column:
        k = x[0]
        if k == "and":
            return go(x[1]) & go(x[2])
        if k == "or":
            return go(x[1]) | go(x[2])
        if k == "not":
            return ~go(x[1])
        if k == "const":
            return F.lit(x[1])
        if k == "found":
            return C.true(text_found(by[x[1]], c))
        if k == "at":
            return C.true(F.startswith(F.substr(c, F.lit(x[2] + 1)), F.lit(by[x[1]].value)))
        if k == "of":
            own = [C.true(text_found(by[m], c)) for m in _members(rule, x[2])]
            if x[1] in ("any", "all"):
                return C.any_of(own) if x[1] == "any" else C.all_of(own)
            n = sum((o.cast("int") for o in own), F.lit(0))
            return n == 0 if x[1] == "none" else n >= x[1]
        if k == "cmp":
            left = F.octet_length(c) if x[2][0] == "size" else F.coalesce(text_count(by[x[2][1]], c), F.lit(0))
            return C.true(_CMP[x[1]](left, x[3]))
        raise ValueError(f"{k} needs bytes: use scan")

    return C.true(c.isNotNull() & go(rule.condition))


def text_hits(rows: DataFrame, rules: list[Rule], text: str) -> DataFrame:
    """`rows` with `rule_name`, one row for each rule that matches the text column."""
    hit = F.array_compact(F.array(*(F.when(text_predicate(r, F.col(text)), F.lit(r.name)) for r in rules)))
    return rows.withColumn("rule_name", F.explode(hit))


def device_free(path: Column) -> Column:
    """A path without the prefix of the object manager."""
    return F.when(F.startswith(path, F.lit("\\??\\")), F.substr(path, F.lit(5))).otherwise(path)


def triggers(events: DataFrame, allow: tuple[str, ...] = ()) -> DataFrame:
    """(path, pid) of started processes whose image is to be scanned: not below an allowed folder, each path and pid once."""
    from .response import normal_path, normal_text

    path = device_free(F.col("Image"))
    low = normal_path(path)
    skip = C.any_of([F.startswith(low, F.lit(p if p.endswith("\\") else p + "\\")) for v in allow if (p := normal_text(v))])
    return events.where((F.col("category") == "Process") & (F.col("opcode") == 1) & F.col("Image").isNotNull() & ~C.true(skip)).select(path.alias("path"), F.coalesce(F.col("ProcessId"), F.col("header_pid").cast("string")).alias("pid")).distinct()


def as_process_events(found: DataFrame, **more: Column) -> DataFrame:
    """Files (path, pid) as process events of now, with the columns `more`."""
    from ..schema import ALL_FIELDS

    own = {"Image": F.col("path"), "ProcessId": F.col("pid").cast("string")}
    return found.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.lit("Process").alias("category"),
        F.lit(1).alias("event_id"),
        F.lit(1).alias("opcode"),
        F.lit(None).cast("long").alias("header_pid"),
        *(own.get(f, F.lit(None).cast("string")).alias(f) for f in ALL_FIELDS),
        *(c.alias(n) for n, c in more.items()),
    )


def alerts(found: DataFrame) -> DataFrame:
    """Alerts for scanned files (path, pid, yara): a process event of now, critical whatever else."""
    told = F.struct(F.concat(F.lit("rule matched: "), "yara.rule").alias("summary"), F.array("yara").alias("rules"))
    return as_process_events(found, rule_name=F.col("yara.rule"), rule_description=F.lit(None).cast("string"), severity=F.lit("Critical"), engine=F.lit("Yara"), match=told)
