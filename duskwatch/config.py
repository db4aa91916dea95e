"""Layered settings: defaults, then a TOML file, then `EDR__SECTION__KEY` from the environment, then the command line."""

from __future__ import annotations

import os
import tomllib
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path
from typing import Any

PREFIX = "EDR__"


@dataclass(frozen=True)
class Scanner:
    sigma_enabled: bool = True
    sigma_rules_path: str = "rules/sigma"
    yara_enabled: bool = True
    yara_rules_path: str = "rules/yara"
    yara_allowlist_paths: tuple[str, ...] = ()


@dataclass(frozen=True)
class Ioc:
    enabled: bool = True
    hashes_path: str = "rules/ioc/hashes.txt"
    ips_path: str = "rules/ioc/ips.txt"
    domains_path: str = "rules/ioc/domains.txt"
    paths_regex_path: str = "rules/ioc/paths_regex.txt"
    default_severity: str = "high"
    max_file_size_mb: int = 50
    hash_allowlist_paths: tuple[str, ...] = ()


@dataclass(frozen=True)
class Network:
    aggregation_enabled: bool = True
    aggregation_interval_buffer_size: int = 50


@dataclass(frozen=True)
class Response:
    enabled: bool = False
    prevention_enabled: bool = False
    min_severity: str = "critical"
    allowlist_images: tuple[str, ...] = ()
    allowlist_paths: tuple[str, ...] = ()


@dataclass(frozen=True)
class Alerts:
    directory: str = "logs"
    filename: str = "alerts.json"
    match_debug: str = "off"


@dataclass(frozen=True)
class Logging:
    level: str = "info"


@dataclass(frozen=True)
class Allowlist:
    paths: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    scanner: Scanner = field(default_factory=Scanner)
    ioc: Ioc = field(default_factory=Ioc)
    network: Network = field(default_factory=Network)
    response: Response = field(default_factory=Response)
    alerts: Alerts = field(default_factory=Alerts)
    logging: Logging = field(default_factory=Logging)
    allowlist: Allowlist = field(default_factory=Allowlist)


def _cast(value: Any, like: Any) -> Any:
    if isinstance(like, bool):
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
    if isinstance(like, int):
        return int(value)
    if isinstance(like, tuple):
        return tuple(value) if isinstance(value, (list, tuple)) else tuple(x.strip() for x in str(value).split(",") if x.strip())
    return str(value)


def _laid(cfg: Config, over: dict[str, dict[str, Any]]) -> Config:
    parts = {}
    for f in fields(cfg):
        own = getattr(cfg, f.name)
        found = {k: _cast(v, getattr(own, k)) for k, v in (over.get(f.name) or {}).items() if hasattr(own, k)}
        parts[f.name] = replace(own, **found)
    return Config(**parts)


def load(path: str | None = None, env: dict[str, str] | None = None, log_level: str | None = None) -> Config:
    """Settings; modules whose own list of allowed paths is empty take the common one."""
    cfg = Config()
    if path and Path(path).is_file():
        cfg = _laid(cfg, tomllib.loads(Path(path).read_text()))
    over: dict[str, dict[str, Any]] = {}
    for k, v in (os.environ if env is None else env).items():
        bits = k.split("__")
        if k.startswith(PREFIX) and len(bits) == 3:
            over.setdefault(bits[1].lower(), {})[bits[2].lower()] = v
    cfg = _laid(cfg, over)
    if log_level:
        cfg = replace(cfg, logging=Logging(log_level))
    common = cfg.allowlist.paths
    return replace(
        cfg,
        scanner=replace(cfg.scanner, yara_allowlist_paths=cfg.scanner.yara_allowlist_paths or common),
        ioc=replace(cfg.ioc, hash_allowlist_paths=cfg.ioc.hash_allowlist_paths or common),
        response=replace(cfg.response, allowlist_paths=cfg.response.allowlist_paths or common),
    )


def as_rows(cfg: Config) -> list[tuple[str, str]]:
    return [(f"{s}.{k}", str(v)) for s, own in asdict(cfg).items() for k, v in own.items()]
