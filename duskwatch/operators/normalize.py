"""Raw provider records to telemetry: routing, noise filters, renaming and the scalar repairs.

A raw record has provider, event_id, opcode, level, keywords, header_pid, filetime and `props`, a map of property names to text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import ALL_FIELDS, FIELDS

#: provider -> (keyword mask or none, categories by opcode or one for all)
PROVIDERS: dict[str, tuple[int | None, str | dict[int, str]]] = {
    "kernel-process": (0x0050, {1: "Process", 2: "Process", 10: "ImageLoad"}),
    "kernel-file": (0x0EB0, "File"),
    "kernel-registry": (0xF000, "Registry"),
    "kernel-network": (0x0030, "Network"),
    "dns-client": (None, "Dns"),
    "powershell": (None, "Scripting"),
    "wmi-activity": (None, "Wmi"),
    "service-control-manager": (None, "Service"),
    "task-scheduler": (None, "Task"),
}
NOISE = {"Network": (10, 11)}
MOST_LEVEL = 4
#: (category, opcodes) -> event id; other rows keep the raw id
EVENT_IDS: list[tuple[str, tuple[int, ...] | None, int]] = [
    ("Process", (1,), 1),
    ("Process", (2,), 5),
    ("Process", (10,), 7),
    ("ImageLoad", (10,), 7),
    ("File", (64, 65), 11),
    ("File", (70, 72), 23),
    ("Registry", (36, 38, 41), 12),
    ("Registry", (39,), 13),
    ("Network", (12, 15), 3),
    ("Dns", None, 22),
    ("Wmi", None, 19),
    ("Scripting", None, 4104),
    ("Service", None, 7045),
    ("Task", None, 106),
]
_IMAGE = ("ImageName", "Image", "ProcessName")
#: field -> properties to try in order, by category; a field that is not here has the property of its own name
SOURCES: dict[str, dict[str, tuple[str, ...]]] = {
    "Process": {"Image": ("ImageName", "ImageFileName", "ProcessName"), "TargetImage": ("ImageName",), "ProcessId": ("ProcessID", "ProcessId"), "ParentProcessId": ("ParentProcessID", "ParentProcessId"), "User": ("UserSID", "User")},
    "File": {"TargetFilename": ("FileName", "FilePath"), "ProcessId": ("ProcessID", "ProcessId"), "User": ("UserSID", "User"), "CreationUtcTime": ("CreationTime",), "PreviousCreationUtcTime": ("PreviousCreationTime",)},
    "Registry": {"TargetObject": ("KeyName", "RelativeName"), "Details": ("ValueName",), "ProcessId": ("ProcessID", "ProcessId"), "User": ("UserSID", "User")},
    "Network": {"DestinationIp": ("daddr", "DestinationIp", "DestAddress", "DestinationAddress"), "SourceIp": ("saddr", "SourceIp", "SourceAddress", "LocalAddress"), "DestinationPort": ("dport", "DestinationPort", "DestPort", "RemotePort"), "SourcePort": ("sport", "SourcePort", "SrcPort", "LocalPort"), "ProcessId": ("PID", "ProcessId"), "Image": _IMAGE},
    "Dns": {"ProcessId": ("ClientPID", "ProcessId"), "Image": _IMAGE},
    "ImageLoad": {"ImageLoaded": ("ImageName", "FileName"), "Image": ("ParentImageName",), "ProcessId": ("ProcessID", "ProcessId")},
    "Scripting": {"ScriptBlockId": ("ScriptBlockID", "ScriptBlockId"), "ProcessId": ("ProcessID", "ProcessId")},
    "Wmi": {"ProcessId": ("ClientProcessId", "ProcessId"), "EventNamespace": ("Namespace", "EventNamespace")},
    "Service": {"ServiceFileName": ("ImagePath", "ServiceFileName")},
    "Task": {"UserName": ("UserContext", "UserName"), "TaskContent": ("TaskContent", "ActionName")},
}
HEADER_PID = ("Process", "Network")
RESOLVES_SID = ("Process", "File", "Registry")
WELL_KNOWN_SIDS = {"S-1-5-18": "NT AUTHORITY\\SYSTEM", "S-1-5-19": "NT AUTHORITY\\LOCAL SERVICE", "S-1-5-20": "NT AUTHORITY\\NETWORK SERVICE"}


def wanted(raw: DataFrame) -> DataFrame:
    """Records that the provider's keyword mask and the level let through."""
    masks = {p: m for p, (m, _) in PROVIDERS.items() if m is not None}
    keep = F.lit(True)
    for p, m in masks.items():
        keep = keep & ((F.col("provider") != p) | (F.col("keywords").bitwiseAND(m) != 0))
    return raw.where(F.col("provider").isin(*PROVIDERS) & (F.col("level") <= MOST_LEVEL) & keep)


def category() -> Column:
    out = F.lit(None).cast("string")
    for p, (_, to) in PROVIDERS.items():
        here = F.col("provider") == p
        for test, c in [(here, to)] if isinstance(to, str) else [(here & (F.col("opcode") == o), c) for o, c in to.items()]:
            out = F.when(test, c).otherwise(out)
    return out


def route(raw: DataFrame) -> DataFrame:
    """Records with their category; those of no category, and network bookkeeping, go."""
    # exploded, not filtered: else the optimizer copies the routing into each of the columns that ask for the category
    out = raw.withColumn("category", F.explode(F.array_compact(F.array(category()))))
    for c, ids in NOISE.items():
        out = out.where(~((F.col("category") == c) & F.col("event_id").isin(*ids)))
    return out


def mapped_event_id(cat: Column | None = None, opcode: Column | None = None, raw: Column | None = None) -> Column:
    cat = F.col("category") if cat is None else cat
    opcode = F.col("opcode") if opcode is None else opcode
    out = F.col("event_id") if raw is None else raw
    for c, ops, to in reversed(EVENT_IDS):
        out = F.when((cat == c) & (opcode.isin(*ops) if ops else F.lit(True)), F.lit(to)).otherwise(out)
    return out


def dos_path(c: Column, drives: dict[str, str]) -> Column:
    """A device path with its drive letter; the longest device name counts.  Other paths stay."""
    out = c
    for device, drive in sorted(drives.items(), key=lambda x: (len(x[0]), x[0])):
        out = F.when(C.ascii_lower(c) == device.lower(), F.lit(drive)).when(F.startswith(C.ascii_lower(c), F.lit(device.lower() + "\\")), F.concat(F.lit(drive), F.substr(c, F.lit(len(device) + 1)))).otherwise(out)
    return out


def resolve_sid(user: Column, names: dict[str, str] | None = None) -> Column:
    """The account of a known SID; anything else as it is.  For a large directory join `with_accounts` instead."""
    out = user
    for sid, name in (WELL_KNOWN_SIDS | (names or {})).items():
        out = F.when(user == sid, name).otherwise(out)
    return F.when(C.is_sid(user), out).otherwise(user)


def with_accounts(events: DataFrame, directory: DataFrame) -> DataFrame:
    """Users that are SIDs replaced by the account in `directory` (sid, account), where the category resolves them."""
    d = directory.select(F.col("sid").alias("__sid"), F.col("account").alias("__account")).dropDuplicates(["__sid"])
    own = C.true(F.col("category").isin(*RESOLVES_SID) & C.is_sid(F.col("User")))
    return events.join(d, own & (F.col("User") == F.col("__sid")), "left").withColumn("User", F.coalesce("__account", "User")).drop("__sid", "__account")


def with_file_metadata(events: DataFrame, files: DataFrame) -> DataFrame:
    """OriginalFileName, Product and Description from `files` (path and those) where a process starts or an image loads, and the event has none."""
    names = ("OriginalFileName", "Product", "Description")
    f = files.select(C.ascii_lower(F.col("path")).alias("__path"), *(F.col(n).alias(f"__{n}") for n in names)).dropDuplicates(["__path"])
    path = F.when((F.col("category") == "Process") & (F.col("opcode") == 1), F.col("Image")).when(F.col("category") == "ImageLoad", F.col("ImageLoaded"))
    return events.join(f, C.ascii_lower(path) == F.col("__path"), "left").withColumns({n: F.coalesce(n, f"__{n}") for n in names}).drop("__path", *(f"__{n}" for n in names))


def with_command_lines(events: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Command lines of started processes that lack one, from `snapshot` (pid, command_line)."""
    s = snapshot.select(F.col("pid").cast("string").alias("__pid"), F.col("command_line").alias("__line")).dropDuplicates(["__pid"])
    lacks = (F.col("category") == "Process") & (F.col("opcode") == 1) & F.col("CommandLine").isNull()
    return events.join(s, lacks & (F.col("ProcessId") == F.col("__pid")), "left").withColumn("CommandLine", F.coalesce("CommandLine", "__line")).drop("__pid", "__line")


def with_clean_props(raw: DataFrame) -> DataFrame:
    """Properties without NULs at the end, the empty ones dropped; exploded so that this is done once a row and not once a field."""
    kept = F.map_filter(F.transform_values("props", lambda _, v: C.clean(v)), lambda _, v: v.isNotNull())
    return raw.withColumn("props", F.explode(F.array(kept)))


def _field(cat: str, name: str) -> Column:
    tries = SOURCES.get(cat, {}).get(name, (name,))
    c = F.coalesce(*(F.col("props")[t] for t in tries))
    if cat == "Network" and name.endswith("Port"):
        n = c.try_cast("long")
        c = C.port_swap(n).cast("string")
    if cat == "Network" and name.endswith("Ip"):
        c = F.coalesce(C.ipv4_text(F.when(c.rlike(r"\A[0-9]+\z"), c.try_cast("long"))), c)
    if name == "ProcessId" and cat in HEADER_PID:
        c = F.coalesce(c, F.col("header_pid").cast("string"))
    return c


def normalize(raw: DataFrame, drives: dict[str, str] | None = None, sids: dict[str, str] | None = None, keep: dict[str, Column] | None = None) -> DataFrame:
    """Telemetry rows of the records that matter, and columns to keep of the raw ones.  A process stop is kept out: `lifecycle` has it."""
    routed = with_clean_props(route(wanted(raw)))
    out = {}
    for f in ALL_FIELDS:
        own = [c for c in FIELDS if c in SOURCES and f in FIELDS[c]]
        col = F.lit(None).cast("string")
        for c in own:
            v = _field(c, f)
            if drives and f in ("Image", "TargetImage", "ParentImage", "TargetFilename", "ImageLoaded"):
                v = dos_path(v, drives)
            if f == "User" and c in RESOLVES_SID:
                v = resolve_sid(v, sids)
            col = F.when(F.col("category") == c, v).otherwise(col)
        out[f] = col
    rows = routed.select(F.col("seq"), C.filetime(F.col("filetime")).alias("timestamp"), "category", mapped_event_id().alias("event_id"), "opcode", "header_pid", *(v.alias(k) for k, v in out.items()), *(v.alias(k) for k, v in (keep or {}).items()))
    return rows.where(~((F.col("category") == "Process") & (F.col("opcode") == 2)))


def lifecycle(raw: DataFrame) -> DataFrame:
    """(seq, pid, kind, Image, ...) of process starts and stops, for the as-of joins."""
    p = with_clean_props(route(wanted(raw)).where("category = 'Process'"))
    return p.select("seq", _field("Process", "ProcessId").alias("pid"), F.when(F.col("opcode") == 2, "stop").otherwise("start").alias("kind"), _field("Process", "Image").alias("Image"), _field("Process", "CommandLine").alias("CommandLine"))
