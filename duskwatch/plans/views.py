"""Telemetry, raw records and content seen in the test tables: one SQL text for Spark and for DuckDB.

`events` becomes telemetry: event types stand for categories, users for processes and hosts, and `event_id`, which never decreases in time, for
seconds.  `documents` is script and file content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ALL_FIELDS

BS = "chr(92)"

BASE = """SELECT event_id AS seq, user_id AS u, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k, event_type AS et FROM {events}"""

KEYED = f"""SELECT seq, u, k, et,
  '2024-01-01T00:' || lpad(CAST(seq % 3600 DIV 60 AS STRING), 2, '0') || ':' || lpad(CAST(seq % 60 AS STRING), 2, '0') || 'Z' AS timestamp,
  CASE et WHEN 'view' THEN CASE WHEN seq % 5 = 4 THEN 'ImageLoad' ELSE 'Process' END WHEN 'click' THEN 'Network' WHEN 'signup' THEN 'Dns' WHEN 'purchase' THEN 'File'
    ELSE CASE seq % 5 WHEN 0 THEN 'Registry' WHEN 1 THEN 'Wmi' WHEN 2 THEN 'Service' WHEN 3 THEN 'Task' ELSE 'Scripting' END END AS category,
  CASE k % 3 WHEN 0 THEN 'C:' || {BS} || 'Windows' || {BS} || 'System32' || {BS} WHEN 1 THEN 'C:' || {BS} || 'Users' || {BS} || 'alice' || {BS} ELSE 'D:' || {BS} || 'Tools' || {BS} END AS dir,
  CASE (u + k) % 8 WHEN 0 THEN 'whoami.exe' WHEN 1 THEN 'cmd.exe' WHEN 2 THEN 'PowerShell.exe' WHEN 3 THEN 'rundll32.exe' WHEN 4 THEN 'svchost.exe' WHEN 5 THEN 'explorer.exe' WHEN 6 THEN 'notepad.exe' END AS exe
FROM ({BASE}) b"""

TELEMETRY = f"""SELECT seq, timestamp, category,
  CASE category WHEN 'Process' THEN 1 WHEN 'ImageLoad' THEN 7 WHEN 'Network' THEN 3 WHEN 'Dns' THEN 22 WHEN 'File' THEN CASE WHEN k % 4 < 2 THEN 11 ELSE 23 END
    WHEN 'Registry' THEN CASE WHEN k % 4 = 3 THEN 13 ELSE 12 END WHEN 'Wmi' THEN 19 WHEN 'Service' THEN CASE WHEN k % 2 = 0 THEN 7045 ELSE 7036 END WHEN 'Task' THEN CASE WHEN k % 2 = 0 THEN 106 ELSE 140 END ELSE 4104 END AS event_id,
  CASE category WHEN 'Process' THEN 1 WHEN 'ImageLoad' THEN 10 WHEN 'Network' THEN CASE k % 3 WHEN 0 THEN 12 WHEN 1 THEN 15 ELSE 10 END
    WHEN 'File' THEN CASE k % 5 WHEN 0 THEN 64 WHEN 1 THEN 65 WHEN 2 THEN 70 WHEN 3 THEN 72 ELSE 66 END WHEN 'Registry' THEN CASE k % 4 WHEN 0 THEN 36 WHEN 1 THEN 38 WHEN 2 THEN 41 ELSE 39 END ELSE 0 END AS opcode,
  u * 4 AS header_pid,
  CASE WHEN category IN ('Process', 'File', 'ImageLoad', 'Scripting', 'Wmi') OR seq % 3 = 0 THEN dir || exe END AS Image,
  CASE WHEN category = 'Process' AND k % 10 = 9 THEN '0x' || CAST(u AS STRING) WHEN k % 10 = 8 THEN NULL ELSE CAST(u * 4 AS STRING) END AS ProcessId,
  CASE WHEN category <> 'Dns' THEN CASE u % 4 WHEN 0 THEN 'S-1-5-18' WHEN 1 THEN 'CORP' || {BS} || 'alice' WHEN 2 THEN 'bob' END END AS User,
  CASE WHEN category = 'Process' THEN exe || CASE k % 7 WHEN 0 THEN ' /all' WHEN 1 THEN ' -enc SQBFAFgA' WHEN 2 THEN ' /c DEL *.tmp' WHEN 3 THEN ' -NoProfile -Command Get-Item' WHEN 4 THEN '' WHEN 5 THEN ' foo bar baz' ELSE ' /NoProfile foo' END END AS CommandLine,
  CASE WHEN category = 'Process' AND k % 2 = 0 THEN dir END AS CurrentDirectory,
  CASE WHEN category = 'Process' THEN CASE k % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' END END AS IntegrityLevel,
  CASE WHEN category = 'Process' THEN dir || CASE u % 3 WHEN 0 THEN 'explorer.exe' WHEN 1 THEN 'services.exe' ELSE 'cmd.exe' END END AS ParentImage,
  CASE WHEN category = 'Process' AND k % 3 = 0 THEN 'cmd.exe /k start' END AS ParentCommandLine,
  CASE WHEN category = 'Process' THEN CAST((u % 7) * 4 AS STRING) END AS ParentProcessId,
  CASE WHEN category IN ('Process', 'ImageLoad') THEN CASE u % 5 WHEN 0 THEN 'WHOAMI.EXE' WHEN 1 THEN exe WHEN 2 THEN '' END END AS OriginalFileName,
  CASE WHEN category = 'Process' THEN '0x3e' || CAST(k % 10 AS STRING) END AS LogonId,
  CASE WHEN category = 'Network' THEN CASE WHEN seq % 7 = 0 THEN '2001:db8::' || CAST(k % 10 AS STRING) ELSE '10.' || CAST(u % 4 AS STRING) || '.' || CAST(k AS STRING) || '.' || CAST(seq % 256 AS STRING) END END AS DestinationIp,
  CASE WHEN category = 'Network' AND k % 4 > 0 THEN '192.168.1.' || CAST(u % 300 AS STRING) END AS SourceIp,
  CASE WHEN category = 'Network' THEN CASE k % 4 WHEN 0 THEN '443' WHEN 1 THEN '8080' WHEN 2 THEN '70000' ELSE '53' END END AS DestinationPort,
  CASE WHEN category = 'Network' THEN CAST(49152 + u AS STRING) END AS SourcePort,
  CASE WHEN category IN ('Network', 'Wmi') AND k % 2 = 0 THEN 'Host' || CAST(u % 10 AS STRING) || '.Example.COM.' END AS DestinationHostname,
  CASE WHEN category = 'Dns' THEN CASE k % 4 WHEN 0 THEN 'c2.evil.test' WHEN 1 THEN 'WWW.Example.com' WHEN 2 THEN 'example.org' ELSE 'a.b.example.net.' END END AS QueryName,
  CASE WHEN category = 'Dns' THEN '10.' || CAST(u % 4 AS STRING) || '.0.' || CAST(k AS STRING) || ';type: 5 192.0.2.' || CAST(u % 256 AS STRING) || ';' END AS QueryResults,
  CASE WHEN category = 'Dns' THEN CAST(k % 2 AS STRING) END AS QueryStatus,
  CASE WHEN category = 'File' THEN dir || 'report' || CAST(k AS STRING) || CASE k % 4 WHEN 0 THEN '.ps1' WHEN 1 THEN '.TXT' WHEN 2 THEN '' ELSE '.tar.gz' END END AS TargetFilename,
  CASE WHEN category = 'Registry' THEN 'HKLM' || CASE WHEN k % 5 = 0 THEN '' ELSE {BS} || 'Software' || {BS} || 'Run' || {BS} || exe END END AS TargetObject,
  CASE WHEN category = 'Registry' THEN CASE k % 3 WHEN 0 THEN 'SetValue' WHEN 1 THEN 'CreateKey' END WHEN category = 'Wmi' THEN 'Query' END AS EventType,
  CASE WHEN category = 'Registry' THEN 'DWORD ' || CAST(k AS STRING) END AS Details,
  CASE WHEN category = 'ImageLoad' THEN dir || CASE k % 2 WHEN 0 THEN 'evil.dll' ELSE 'kernel32.dll' END END AS ImageLoaded,
  CASE WHEN category = 'ImageLoad' THEN CASE k % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'Unsigned' ELSE 'maybe' END END AS Signed,
  CASE WHEN category = 'Scripting' THEN 'Invoke-Thing ' || CAST(k AS STRING) END AS ScriptBlockText,
  CASE WHEN category = 'Scripting' THEN dir || 'run.ps1' END AS Path,
  CASE WHEN category = 'Wmi' THEN CASE WHEN k % 2 = 0 THEN 'ExecQuery' END END AS Operation,
  CASE WHEN category = 'Wmi' THEN 'select * from Win32_Process' END AS Query,
  CASE WHEN category = 'Service' THEN 'svc' || CAST(k % 5 AS STRING) END AS ServiceName,
  CASE WHEN category = 'Service' THEN dir || 'svc.exe' END AS ServiceFileName,
  CASE WHEN category = 'Task' THEN {BS} || 'Task' || CAST(k AS STRING) END AS TaskName
FROM ({KEYED}) b"""

RAW = f"""SELECT seq, u, k,
  CASE seq % 10 WHEN 0 THEN 'kernel-process' WHEN 1 THEN 'kernel-file' WHEN 2 THEN 'kernel-registry' WHEN 3 THEN 'kernel-network' WHEN 4 THEN 'dns-client' WHEN 5 THEN 'powershell' WHEN 6 THEN 'wmi-activity' WHEN 7 THEN 'service-control-manager' WHEN 8 THEN 'task-scheduler' ELSE 'unknown' END AS provider,
  CAST(10 + k % 5 AS INT) AS event_id,
  CAST(CASE seq % 10 WHEN 0 THEN CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 10 ELSE 3 END WHEN 1 THEN 62 + k % 12 WHEN 2 THEN 35 + k % 7 WHEN 3 THEN 10 + k % 6 ELSE 0 END AS INT) AS opcode,
  CAST(k % 6 AS INT) AS level, k * 16 AS keywords, u * 4 AS header_pid,
  CASE WHEN k % 20 = 19 THEN 5 ELSE 116444736000000000 + seq * 10000000 + k * 99999 END AS filetime,
  u * 65536 + k * 257 AS port_raw, 167772160 + u * 256 + k AS ip_raw,
  CASE k % 3 WHEN 0 THEN {BS} || 'Device' || {BS} || 'HarddiskVolume1' || {BS} || 'a.exe' WHEN 1 THEN {BS} || 'Device' || {BS} || 'HarddiskVolume12' || {BS} || 'b.exe' ELSE 'C:' || {BS} || 'c.exe' END AS nt_path,
  CASE u % 5 WHEN 0 THEN 'S-1-5-18' WHEN 1 THEN 'S-1-5-19' WHEN 2 THEN 'S-1-5-21-7' WHEN 3 THEN 'carol' END AS sid
FROM ({BASE}) b"""

#: Process starts and stops, and what asks about them; two seconds to a step, pids few so that they are used again.
LIFE = f"""SELECT seq, u % 40 AS pid, k, et, CASE WHEN et = 'view' THEN 'start' WHEN et = 'error' THEN 'stop' ELSE 'probe' END AS kind,
  'p' || CAST(k AS STRING) || '.exe' AS Image, 'p' || CAST(k AS STRING) || ' -x' AS CommandLine, (u + k) % 40 AS ppid FROM ({BASE}) b"""

CONNECTIONS = f"""SELECT seq, 'img' || CAST(u % 20 AS STRING) AS image, '10.0.0.' || CAST(k AS STRING) AS dest_ip, CASE WHEN k % 2 = 0 THEN 443 ELSE 80 END AS dest_port,
  CASE seq % 3 WHEN 0 THEN 'tcp' ELSE 'udp' END AS protocol, u AS pid FROM ({BASE}) b WHERE et = 'click'"""


def duck(sql: str) -> str:
    """The text as DuckDB takes it."""
    return sql.replace("{events}", "events").replace(" DIV ", " // ")


def events_view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view with a null column for each field that it leaves out."""
    df = events_view(spark, sf_dir, TELEMETRY)
    have = set(df.columns)
    own = [F.col("seq"), F.col("timestamp"), F.col("category"), F.col("event_id").cast(T.IntegerType()).alias("event_id"), F.col("opcode").cast(T.IntegerType()).alias("opcode"), F.col("header_pid")]
    return df.select(*own, *(F.col(f) if f in have else F.lit(None).cast("string").alias(f) for f in ALL_FIELDS))
