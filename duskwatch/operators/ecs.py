"""Alerts in the Elastic Common Schema, version 9.3.0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import SEVERITY_NUMBER

VERSION, MODULE, PROVIDER = "9.3.0", "edr", "edr-rust"
CREATE, DELETE = (64, 65), (70, 72)
PORT = (1 << 16) - 1
_CATEGORY = {"Process": "process", "Network": "network", "File": "file", "Registry": "registry", "Dns": "network", "ImageLoad": "library", "Scripting": "process", "Wmi": "api", "Service": "configuration", "Task": "configuration"}
_DATASET = {c: c.lower() for c in _CATEGORY} | {"ImageLoad": "library"}


def _map(c: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def _by_opcode(test: dict[tuple[int, ...], str], other: str) -> Column:
    out = F.lit(other)
    for ops, v in test.items():
        out = F.when(F.col("opcode").isin(*ops), v).otherwise(out)
    return out


def kind_and_action() -> tuple[Column, Column]:
    """event.type and event.action, before overrides."""
    fresh = lambda n, a, b: F.when(F.col("event_id") == n, a).otherwise(b)
    table = {
        "Process": (_by_opcode({(1,): "start", (2,): "end"}, "info"), _by_opcode({(1,): "process-start", (2,): "process-end"}, "process-info")),
        "Network": (F.lit("connection"), F.lit("network-connection")),
        "File": (_by_opcode({CREATE: "creation", DELETE: "deletion"}, "change"), _by_opcode({CREATE: "file-create", DELETE: "file-delete"}, "file-change")),
        "Registry": (_by_opcode({(36,): "creation", (38, 41): "deletion"}, "change"), _by_opcode({(36,): "registry-create", (38, 41): "registry-delete", (39,): "registry-set"}, "registry-change")),
        "Dns": (F.lit("protocol"), F.lit("dns-query")),
        "ImageLoad": (F.lit("start"), F.lit("image-load")),
        "Scripting": (F.lit("info"), F.lit("powershell-script")),
        "Wmi": (F.lit("info"), F.lit("wmi-operation")),
        "Service": (fresh(7045, "creation", "change"), fresh(7045, "service-create", "service-change")),
        "Task": (fresh(106, "creation", "change"), fresh(106, "task-create", "task-change")),
    }
    kind = action = F.lit(None).cast("string")
    for c, (k, a) in table.items():
        kind = F.when(F.col("category") == c, k).otherwise(kind)
        action = F.when(F.col("category") == c, a).otherwise(action)
    return kind, action


def project(alerts: DataFrame, v6: bool = True, most_source_port: int = PORT) -> DataFrame:
    """One column for each ECS key (dots and all); what an alert lacks is null.

    `alerts` are telemetry rows with rule_name, rule_description, severity and engine, and may have context columns `ctx_<field>` and a struct `match`.
    A source port beyond `most_source_port` is null, and a destination port beyond 65,535."""
    have = set(alerts.columns)
    cat = F.col("category")
    pid64 = (1 << 64) - 1

    def on(names: str, c: Column) -> Column:
        return F.when(cat.isin(*names.split()), c)

    def ctx(name: str) -> Column:
        return F.col(f"ctx_{name}") if f"ctx_{name}" in have else F.lit(None).cast("string")

    process = lambda n: F.coalesce(on("Process", F.col(n)), ctx(n))
    number = lambda c: C.whole_number(c, pid64)
    kind, action = kind_and_action()
    own_user = F.when(cat != "Dns", F.nullif("User", F.lit("")))
    user, back = C.user_parts(own_user), C.user_parts(ctx("User"))
    reg = C.registry_parts(F.col("TargetObject"), F.col("EventType"))
    path = on("File", F.col("TargetFilename"))
    path = F.coalesce(path, on("ImageLoad", F.col("ImageLoaded")), on("Scripting", F.col("Path")))
    ips = on("Dns", C.addresses(F.col("QueryResults")))
    src, dst = on("Network", F.col("SourceIp")), on("Network", F.col("DestinationIp"))
    net = F.coalesce(src, dst)
    executable = F.coalesce("Image", ctx("Image"))
    parent = process("ParentImage")
    user_name, user_id = F.coalesce(user["name"], back["name"]), F.coalesce(user["id"], back["id"])
    six = F.when(C.ip_text(net).isNotNull(), F.lit("ipv6")) if v6 else F.lit(None).cast("string")
    none_if_empty = lambda a: F.when(F.size(a) > 0, a)
    cols = {
        "@timestamp": F.col("timestamp"),
        "ecs.version": F.lit(VERSION),
        "event.kind": F.lit("alert"),
        "event.category": F.array(_map(cat, _CATEGORY)),
        "event.type": F.array(kind),
        "event.action": F.coalesce(on("Registry", F.col("EventType")), on("Wmi", F.col("Operation")), action),
        "event.code": F.col("event_id").cast("string"),
        "event.severity": _map(F.col("severity"), {k: str(v) for k, v in SEVERITY_NUMBER.items()}).cast("int"),
        "event.module": F.lit(MODULE),
        "event.dataset": F.concat(F.lit(MODULE + "."), _map(cat, _DATASET)),
        "event.provider": F.lit(PROVIDER),
        "rule.name": F.col("rule_name"),
        "rule.description": F.col("rule_description"),
        "edr.rule.severity": F.col("severity"),
        "edr.rule.engine": F.col("engine"),
        "process.executable": executable,
        "process.name": C.basename(executable),
        "process.command_line": process("CommandLine"),
        "process.pid": F.coalesce(number(F.col("ProcessId")), number(ctx("ProcessId"))),
        "process.parent.executable": parent,
        "process.parent.name": C.basename(parent),
        "process.parent.command_line": process("ParentCommandLine"),
        "process.parent.pid": F.coalesce(on("Process", number(F.col("ParentProcessId"))), number(ctx("ParentProcessId"))),
        "process.working_directory": process("CurrentDirectory"),
        "edr.process.integrity_level": process("IntegrityLevel"),
        "process.pe.original_file_name": process("OriginalFileName"),
        "process.pe.product": process("Product"),
        "process.pe.description": process("Description"),
        "edr.process.target_image": on("Process", F.col("TargetImage")),
        "winlog.logon.id": process("LogonId"),
        "winlog.logon.guid": process("LogonGuid"),
        "user.name": user_name,
        "user.id": user_id,
        "user.domain": F.coalesce(user["domain"], back["domain"]),
        "destination.ip": dst,
        "destination.port": on("Network", C.whole_number(F.col("DestinationPort"), PORT).cast("int")),
        "destination.domain": on("Network Wmi", F.col("DestinationHostname")),
        "source.ip": src,
        "source.port": on("Network", C.whole_number(F.col("SourcePort"), most_source_port).cast("int")),
        "network.transport": on("Network", F.when(F.col("opcode") == 12, "tcp").when(F.col("opcode") == 15, "udp")),
        "network.type": F.when(C.is_ipv4(net), "ipv4").otherwise(six),
        "network.protocol": on("Dns", F.lit("dns")),
        "network.direction": on("Network Dns", F.lit("egress")),
        "file.path": path,
        "file.name": C.basename(path),
        "file.extension": C.extension(path),
        "file.created": on("File", F.col("CreationUtcTime")),
        "edr.file.previous_created": on("File", F.col("PreviousCreationUtcTime")),
        "file.pe.original_file_name": on("ImageLoad", F.col("OriginalFileName")),
        "file.pe.product": on("ImageLoad", F.col("Product")),
        "file.pe.description": on("ImageLoad", F.col("Description")),
        "file.code_signature.exists": on("ImageLoad", C.truth(F.col("Signed"))),
        "file.code_signature.subject_name": on("ImageLoad", F.col("Signature")),
        "dll.path": on("ImageLoad", F.col("ImageLoaded")),
        "dll.name": on("ImageLoad", C.basename(F.col("ImageLoaded"))),
        "registry.path": on("Registry", F.col("TargetObject")),
        "registry.hive": on("Registry", reg["hive"]),
        "registry.key": on("Registry", reg["key"]),
        "registry.value": on("Registry", reg["value"]),
        "registry.data.strings": on("Registry", F.when(F.col("Details").isNotNull(), F.array("Details"))),
        "edr.registry.event_type": on("Registry", F.col("EventType")),
        "edr.registry.new_name": on("Registry", F.col("NewName")),
        "dns.question.name": on("Dns", F.col("QueryName")),
        "dns.answers": on("Dns", F.when(F.col("QueryResults").isNotNull(), F.array(F.struct(F.col("QueryResults").alias("data"))))),
        "dns.response_code": on("Dns", F.col("QueryStatus")),
        "dns.resolved_ip": none_if_empty(ips),
        "service.name": on("Service", F.col("ServiceName")),
        "edr.service.executable": on("Service", F.col("ServiceFileName")),
        "edr.service.type": on("Service", F.col("ServiceType")),
        "edr.service.start_type": on("Service", F.col("StartType")),
        "edr.service.account_name": on("Service", F.col("AccountName")),
        "edr.task.name": on("Task", F.col("TaskName")),
        "edr.task.content": on("Task", F.col("TaskContent")),
        "edr.task.user_name": on("Task", F.col("UserName")),
        "edr.powershell.script_block_text": on("Scripting", F.col("ScriptBlockText")),
        "edr.powershell.script_block_id": on("Scripting", F.col("ScriptBlockId")),
        "edr.wmi.operation": on("Wmi", F.col("Operation")),
        "edr.wmi.query": on("Wmi", F.col("Query")),
        "edr.wmi.namespace": on("Wmi", F.col("EventNamespace")),
        "edr.wmi.event_type": on("Wmi", F.col("EventType")),
        "related.ip": none_if_empty(F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(src, dst), F.coalesce(ips, F.array().cast("array<string>"))))))),
        "related.user": none_if_empty(F.array_sort(F.array_distinct(F.array_compact(F.array(user_name, user_id))))),
    }
    if "match" in have:
        cols["edr.match"] = F.col("match")
    if "response_decision" in have:
        cols["edr.response.decision"] = F.col("response_decision")
    return alerts.select(*(c for c in ("seq", "rule") if c in have), *(v.alias(k) for k, v in cols.items()))


def ndjson(ecs: DataFrame) -> DataFrame:
    """One JSON object a row, keys with dots, nulls left out."""
    keep = [c for c in ecs.columns if c not in ("seq", "rule")]
    return ecs.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in keep))).alias("value"))


def write_ndjson(ecs: DataFrame, path: str) -> None:
    """Files by day of the alert."""
    day = F.substring(F.col("`@timestamp`"), 1, 10).alias("alert_date")
    keep = [c for c in ecs.columns if c not in ("seq", "rule")]
    ecs.select(day, F.to_json(F.struct(*(F.col(f"`{c}`") for c in keep))).alias("value")).write.partitionBy("alert_date").mode("append").text(path)
