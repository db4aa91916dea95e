"""The telemetry model: categories, the fields that each has, and the wide row that holds them all.

A row of telemetry has `BASE` columns and one nullable string column for each field of any category.  A rule sees only
the fields of its event's category; to it any other field is missing, whatever the row holds.
"""

from __future__ import annotations

from pyspark.sql import types as T

_COMMON = "Image ProcessId User"
FIELDS: dict[str, tuple[str, ...]] = {
    c: tuple(f.split())
    for c, f in {
        "Process": _COMMON + " CommandLine CurrentDirectory Description IntegrityLevel LogonGuid LogonId OriginalFileName ParentCommandLine ParentImage ParentProcessId Product TargetImage",
        "File": _COMMON + " CreationUtcTime PreviousCreationUtcTime TargetFilename",
        "Network": _COMMON + " DestinationHostname DestinationIp DestinationPort SourceIp SourcePort",
        "Registry": _COMMON + " Details EventType NewName TargetObject",
        "Dns": "Image ProcessId QueryName QueryResults QueryStatus",
        "ImageLoad": _COMMON + " Description ImageLoaded OriginalFileName Product Signature Signed",
        "Scripting": _COMMON + " Path ScriptBlockId ScriptBlockText",
        "RemoteThread": "SourceImage SourceProcessId StartAddress StartFunction StartModule TargetImage TargetProcessId User",
        "Wmi": _COMMON + " DestinationHostname EventNamespace EventType Operation Query",
        "Service": _COMMON + " AccountName ServiceFileName ServiceName ServiceType StartType",
        "Task": _COMMON + " TaskContent TaskName UserName",
    }.items()
}
CATEGORIES = tuple(c for c in FIELDS if c != "RemoteThread")
ALL_FIELDS = tuple(sorted({f for own in FIELDS.values() for f in own}))
#: Readable in every category, besides its own fields.
ALWAYS = ("timestamp", "EventID")
BASE = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("event_id", T.IntegerType()),
        T.StructField("opcode", T.IntegerType()),
        T.StructField("header_pid", T.LongType()),
    ]
)
TELEMETRY = T.StructType([*BASE.fields, *(T.StructField(f, T.StringType()) for f in ALL_FIELDS)])
CONTEXT_FIELDS = ("Image", "CommandLine", "ProcessId", "ParentImage", "ParentCommandLine", "ParentProcessId", "CurrentDirectory", "IntegrityLevel", "OriginalFileName", "Product", "Description", "User", "LogonId", "LogonGuid")

SEVERITIES = ("Low", "Medium", "High", "Critical")
SEVERITY_NUMBER = dict(zip(SEVERITIES, (25, 50, 75, 100), strict=True))
