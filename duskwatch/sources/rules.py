"""Sigma rule files: reading, gating and the catalogue of what was loaded, skipped or refused."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

SUPPORTED = {
    "process_creation": ("Process", None),
    "image_load": ("ImageLoad", None),
    "network_connection": ("Network", None),
    "dns_query": ("Dns", None),
    "file_event": ("File", None),
    "file_create": ("File", (64, 65)),
    "file_delete": ("File", (70, 72)),
    "registry_event": ("Registry", None),
    "registry_add": ("Registry", (36,)),
    "registry_set": ("Registry", (39,)),
    "registry_delete": ("Registry", (38, 41)),
    "ps_script": ("Scripting", None),
    "wmi_event": ("Wmi", None),
    "service_creation": ("Service", None),
    "task_creation": ("Task", None),
}
SERVICES = frozenset(["dns", "dns-client", "microsoft-windows-powershell", "powershell", "powershell-classic", "security", "sysmon", "system", "task scheduler", "taskscheduler", "wmi"])
SEVERITY = {"critical": "Critical", "high": "High", "medium": "Medium"}


class _Loader(yaml.SafeLoader):
    """YAML with only true and false as booleans, and no repeated keys."""


_Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t not in ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:timestamp")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
_Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


def _mapping(loader: _Loader, node: yaml.MappingNode) -> dict:
    loader.flatten_mapping(node)
    out: dict = {}
    for k, v in node.value:
        key = loader.construct_object(k, deep=True)
        if key in out:
            raise yaml.constructor.ConstructorError(None, None, f"the key {key!r} is repeated", k.start_mark)
        out[key] = loader.construct_object(v, deep=True)
    return out


_Loader.add_constructor("tag:yaml.org,2002:map", _mapping)


@dataclass
class Rule:
    title: str
    logsource: dict[str, Any]
    detection: dict[str, Any]
    level: str = ""
    id: str = ""
    description: str = ""
    path: str = ""
    index: int = 0

    @property
    def category(self) -> str:
        return str(self.logsource.get("category") or "").strip().lower()

    @property
    def severity(self) -> str:
        """Exact spelling only; anything else is low."""
        return SEVERITY.get(self.level, "Low")

    @property
    def condition(self) -> str | None:
        return self.detection.get("condition")


@dataclass
class Catalogue:
    rules: list[Rule] = field(default_factory=list)
    failed: list[tuple[str, str]] = field(default_factory=list)
    skipped: dict[str, int] = field(default_factory=lambda: {"category": 0, "product": 0, "service": 0})

    def stats(self) -> list[tuple[str, int]]:
        """(what, how many): rules by category, then failures and skips by reason."""
        by: dict[str, int] = {}
        for r in self.rules:
            by[r.category] = by.get(r.category, 0) + 1
        return [("total", len(self.rules)), *((f"category:{c}", n) for c, n in sorted(by.items(), key=lambda x: (-x[1], x[0]))), ("failed", len(self.failed)), *((f"skipped:{k}", n) for k, n in self.skipped.items())]


def skip_reason(rule: Rule) -> str | None:
    """Why a rule does not concern this engine, in the order category, product, service."""
    src = {k: str(rule.logsource.get(k) or "").strip().lower() for k in ("product", "service")}
    if rule.category not in SUPPORTED:
        return "category"
    if src["product"] not in ("", "windows"):
        return "product"
    if src["service"] and src["service"] not in SERVICES:
        return "service"
    return None


def to_rule(doc: Any, path: str = "", index: int = 0) -> Rule:
    if not isinstance(doc, dict):
        raise ValueError("a rule is a mapping")
    for k in ("title", "logsource", "detection"):
        if k not in doc:
            raise ValueError(f"{k} is missing")
    if not isinstance(doc["logsource"], dict) or not isinstance(doc["detection"], dict):
        raise ValueError("logsource and detection are mappings")
    condition = doc["detection"].get("condition")
    if condition is not None and not isinstance(condition, str):
        raise ValueError("a condition is one text")
    return Rule(str(doc["title"]), doc["logsource"], doc["detection"], str(doc.get("level") or ""), str(doc.get("id") or ""), str(doc.get("description") or ""), path, index)


def documents(text: str, path: str = "") -> Iterator[Rule]:
    """The rules of one file: of a global document, each later one's logsource and detection laid over it; else the first alone."""
    docs = [d for d in yaml.load_all(text, Loader=_Loader) if d is not None]  # noqa: S506 - a safe loader
    if not docs:
        raise ValueError("the file is empty")
    if not (isinstance(docs[0], dict) and docs[0].get("action") == "global"):
        yield to_rule(docs[0], path)
        return
    for i, d in enumerate(docs[1:], 1):
        whole = dict(docs[0])
        for k in ("logsource", "detection"):
            if isinstance(d, dict) and k in d:
                whole[k] = {**whole[k], **d[k]} if isinstance(whole.get(k), dict) and isinstance(d[k], dict) else d[k]
        yield to_rule(whole, path, i)


def add(into: Catalogue, text: str, path: str, compiles) -> None:
    """Gate and compile the rules of one file; a rule that fails ends its file, those before it stay."""
    try:
        for rule in documents(text, path):
            why = skip_reason(rule)
            if why:
                into.skipped[why] += 1
                continue
            compiles(rule)
            into.rules.append(rule)
    except (ValueError, yaml.YAMLError) as e:
        into.failed.append((path, str(e)))


def load(folder: str, compiles=lambda rule: None) -> Catalogue:
    """All .yml and .yaml files below a folder, by path."""
    out = Catalogue()
    for p in sorted(Path(folder).rglob("*")):
        if p.is_file() and p.suffix in (".yml", ".yaml"):
            try:
                text = p.read_text()
            except (OSError, UnicodeDecodeError) as e:
                out.failed.append((str(p), str(e)))
                continue
            add(out, text, str(p), compiles)
    return out
