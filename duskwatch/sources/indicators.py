"""Indicator files: one value a line, an optional comment after a semicolon; blank lines and lines that begin with # or // are skipped."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, field
from pathlib import Path

from ..operators.sigma import guarded


@dataclass(frozen=True)
class Indicator:
    kind: str  # md5 sha1 sha256 ip cidr domain suffix path_regex
    value: str
    comment: str | None = None
    source: str = ""
    line: int = 0


@dataclass
class Indicators:
    rows: list[Indicator] = field(default_factory=list)

    def of(self, *kinds: str) -> list[Indicator]:
        return [r for r in self.rows if r.kind in kinds]

    def stats(self) -> list[tuple[str, int]]:
        return [(k, len(self.of(k))) for k in ("md5", "sha1", "sha256", "ip", "cidr", "domain", "suffix", "path_regex")]


def lines(text: str, source: str) -> list[tuple[str, str | None, str, int]]:
    out = []
    for n, raw in enumerate(text.split("\n"), 1):
        s = raw.strip()
        if not s or s.startswith(("#", "//")):
            continue
        value, _, comment = s.partition(";")
        if value.strip():
            out.append((value.strip(), comment.strip() or None, source, n))
    return out


def hashes(text: str, source: str = "") -> list[Indicator]:
    """md5, sha1 or sha256 by length; of a repeated value the last line counts."""
    kinds = {32: "md5", 40: "sha1", 64: "sha256"}
    out = {v.lower(): Indicator(kinds[len(v)], v.lower(), *rest) for v, *rest in lines(text, source) if len(v) in kinds and re.fullmatch(r"[0-9A-Fa-f]+", v)}
    return list(out.values())


def ips(text: str, source: str = "") -> list[Indicator]:
    out: dict[tuple[str, str], Indicator] = {}
    for v, *rest in lines(text, source):
        try:
            if "/" in v:
                addr, _, bits = v.partition("/")
                net = ipaddress.ip_interface(f"{addr}/{int(bits)}")
                out["cidr", f"{v}#{rest[-1]}"] = Indicator("cidr", str(net), *rest)
            else:
                ip = str(ipaddress.ip_address(v))
                out["ip", ip] = Indicator("ip", ip, *rest)
        except ValueError:
            continue
    return list(out.values())


def domains(text: str, source: str = "") -> list[Indicator]:
    """`*.x` and `.x` stand for x and all below it."""
    out: dict[tuple[str, str], Indicator] = {}
    for v, *rest in lines(text, source):
        host = v.lower().rstrip(".")
        suffix = host.startswith(("*.", "."))
        host = host.removeprefix("*").lstrip(".") if suffix else host
        if host:
            kind = "suffix" if suffix else "domain"
            out[kind, host if kind == "domain" else f"{host}#{rest[-1]}"] = Indicator(kind, host, *rest)
    return list(out.values())


def paths(text: str, source: str = "") -> list[Indicator]:
    return [Indicator("path_regex", v, *rest) for v, *rest in lines(text, source) if guarded(v, "i")]


def load(files: dict[str, str]) -> Indicators:
    """Indicators of files by kind: hashes, ips, domains, paths.  A file that is missing counts as empty."""
    out = Indicators()
    for kind, parse in (("hashes", hashes), ("ips", ips), ("domains", domains), ("paths", paths)):
        p = Path(files.get(kind) or "/nonexistent")
        if p.is_file():
            out.rows += parse(p.read_text(), p.name)
    return out
