"""What an active response would do about an alert.  Only the decision is made here; nothing is terminated."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import SEVERITIES

LAST_PROTECTED_PID = 4


@dataclass(frozen=True)
class Policy:
    min_severity: str = "critical"
    dry_run: bool = True
    own_pid: int | None = None
    allow_images: tuple[str, ...] = ()
    allow_paths: tuple[str, ...] = ()


def rank(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, s in enumerate(SEVERITIES):
        out = F.when(severity == s, i).otherwise(out)
    return out


def normal_path(c: Column) -> Column:
    return C.ascii_lower(F.replace(F.trim(c), F.lit("/"), F.lit("\\")))


def normal_text(s: str) -> str:
    return C.ascii_lower_text(s.strip().replace("/", "\\"))


def allowed(image: Column, policy: Policy) -> Column:
    """Below an allowed path, or an allowed image by its whole path or, if given without one, its name."""
    path = normal_path(image)
    name = F.regexp_extract(F.regexp_replace(path, r"\\+\z", ""), r"([^\\]*)\z", 1)
    tests = [F.startswith(path, F.lit(p if p.endswith("\\") else p + "\\")) for v in policy.allow_paths if (p := normal_text(v))]
    images = [p for v in policy.allow_images if (p := normal_text(v))]
    tests += [path.isin([p for p in images if "\\" in p])] if any("\\" in p for p in images) else []
    tests += [name.isin([p for p in images if "\\" not in p])] if any("\\" not in p for p in images) else []
    return C.true(C.any_of(tests))


def decide(alerts: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008 - frozen
    """Alerts with `response_pid`, `response_image` and `response_decision`; null if the alert is not severe enough."""
    have = set(alerts.columns)
    ctx = lambda n: F.col(f"ctx_{n}") if f"ctx_{n}" in have else F.lit(None).cast("string")
    pid = F.coalesce(C.parse_pid(F.col("ProcessId")), C.parse_pid(ctx("ProcessId")))
    image = F.coalesce("Image", ctx("Image"))
    if "TargetProcessId" in have:
        target = (F.col("category") == "RemoteThread") & C.parse_pid(F.col("TargetProcessId")).isNotNull()
        remote = F.col("category") == "RemoteThread"
        pid = F.when(target, C.parse_pid(F.col("TargetProcessId"))).when(remote, F.coalesce(C.parse_pid(F.col("SourceProcessId")), pid)).otherwise(pid)
        image = F.when(target, F.coalesce("TargetImage", ctx("Image"))).when(remote, F.coalesce("SourceImage", ctx("Image"))).otherwise(image)
    least = {s.lower(): i for i, s in enumerate(SEVERITIES)}.get(policy.min_severity.strip().lower(), 3)
    severity = F.when(F.col("engine") == "Yara", "Critical").otherwise(F.col("severity"))
    guarded = pid <= LAST_PROTECTED_PID
    if policy.own_pid is not None:
        guarded = guarded | (pid == policy.own_pid)
    decision = (
        F.when(~C.true(rank(severity) >= least), F.lit(None).cast("string"))
        .when(pid.isNull(), "skip-no-pid")
        .when(guarded, "skip-protected-pid")
        .when(image.isNull(), "skip-no-image")
        .when(allowed(image, policy), "skip-allowlisted")
        .otherwise("dry-run" if policy.dry_run else "terminate")
    )
    return alerts.withColumns({"response_pid": pid, "response_image": image, "response_decision": decision})
