"""Indicator matching as joins: equality, masked-prefix equality for networks, suffix equality for domains, and path expressions.

The indicator side comes from files read on the driver.  It is broadcast while it has at most `BROADCAST_ROWS` rows; a longer list is joined by
shuffle, with the same keys.  Only the candidate values of the event side travel, in that case.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.indicators import Indicator, Indicators, guarded

BROADCAST_ROWS = 100_000
PATTERNS_INLINE = 500
_META = "comment string, source string, line int"


def _side(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def _meta(i: Indicator) -> tuple:
    return i.comment, i.source, i.line


def normal_host(c: Column) -> Column:
    """Trimmed, lower case, without points at the end; null if nothing is left."""
    return F.nullif(F.regexp_replace(C.ascii_lower(F.trim(c)), r"\.+\z", ""), F.lit(""))


def hosts(events: DataFrame) -> DataFrame:
    """Events with `observed`, the host that each speaks of."""
    raw = F.when(F.col("category") == "Dns", F.col("QueryName")).when(F.col("category").isin("Network", "Wmi"), F.col("DestinationHostname"))
    return events.withColumn("observed", normal_host(raw)).where("observed IS NOT NULL")


def observed_ips(events: DataFrame) -> DataFrame:
    """Events with `observed`, one row for each address that they speak of; `ip` is its canonical text."""
    answers = F.filter(F.split("QueryResults", r"[\s,;]+"), lambda t: t != "")
    both = F.array_compact(F.array("DestinationIp", "SourceIp"))
    some = F.when(F.col("category") == "Network", both).when(F.col("category") == "Dns", answers)
    return events.withColumn("observed", F.explode(F.array_distinct(some))).withColumn("ip", C.ip_text(F.col("observed"))).where("ip IS NOT NULL")


def observed_paths(events: DataFrame) -> DataFrame:
    c = F.col("category")
    some = (
        F.when(c == "Process", F.array_compact(F.array("Image", "TargetImage")))
        .when(c == "File", F.array_compact(F.array("TargetFilename")))
        .when(c == "ImageLoad", F.array_compact(F.array("ImageLoaded")))
        .when(c == "Scripting", F.array_compact(F.array("Path")))
        .when(c == "Service", F.array_compact(F.array("ServiceFileName")))
    )
    return events.withColumn("observed", F.explode(F.array_distinct(some)))


def match_domains(events: DataFrame, indicators: Indicators) -> DataFrame:
    spark = events.sparkSession
    exact = _side(spark, [(i.value, "domain", i.value, *_meta(i)) for i in indicators.of("domain")], f"key string, kind string, indicator string, {_META}")
    found = hosts(events)
    one = found.join(exact, found["observed"] == exact["key"]).drop("key")
    below = _side(spark, [(i.value, "domain", "." + i.value, *_meta(i)) for i in indicators.of("suffix")], f"key string, kind string, indicator string, {_META}")
    parts = F.split("observed", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    spread = found.withColumn("tail", F.explode(F.array_distinct(tails)))
    two = spread.join(below, spread["tail"] == below["key"]).drop("tail", "key")
    return one.unionByName(two)


def match_ips(events: DataFrame, indicators: Indicators) -> DataFrame:
    """Equality on the canonical text, and for networks equality on (length, masked address), one key for each length in use."""
    spark = events.sparkSession
    found = observed_ips(events)
    exact = _side(spark, [(str(ipaddress.ip_address(i.value)), "ip", i.value, *_meta(i)) for i in indicators.of("ip")], f"key string, kind string, indicator string, {_META}")
    out = found.join(exact, found["ip"] == exact["key"]).drop("key", "ip")
    nets = [(ipaddress.ip_interface(i.value), i) for i in indicators.of("cidr")]
    four = [(n.network.prefixlen, int(n.network.network_address), "ip", i.value, *_meta(i)) for n, i in nets if n.version == 4]
    if four:
        side = _side(spark, four, f"bits int, key long, kind string, indicator string, {_META}")
        lengths = sorted({r[0] for r in four})
        number = C.ipv4_number(F.col("ip"))
        keys = F.array(*(F.struct(F.lit(b).alias("bits"), F.shiftleft(F.shiftright(number, 32 - b), 32 - b).alias("key")) for b in lengths))
        spread = found.where(C.is_ipv4(F.col("ip"))).withColumn("net", F.explode(keys))
        out = out.unionByName(spread.join(side, (F.col("net.bits") == side["bits"]) & (F.col("net.key") == side["key"])).drop("net", "bits", "key", "ip"))
    six = [(n.network.prefixlen, f"{int(n.network.network_address):0128b}"[: n.network.prefixlen], "ip", i.value, *_meta(i)) for n, i in nets if n.version == 6]
    if six:
        side = _side(spark, six, f"bits int, key string, kind string, indicator string, {_META}")
        lengths = sorted({r[0] for r in six})
        own = found.withColumn("digits", C.ipv6_bits(F.col("ip"))).where("digits IS NOT NULL")
        keys = F.array(*(F.struct(F.lit(b).alias("bits"), F.substring("digits", 1, b).alias("key")) for b in lengths))
        spread = own.withColumn("net", F.explode(keys))
        out = out.unionByName(spread.join(side, (F.col("net.bits") == side["bits"]) & (F.col("net.key") == side["key"])).drop("net", "digits", "bits", "key", "ip"))
    return out


def match_paths(events: DataFrame, indicators: Indicators) -> DataFrame:
    """Case-insensitive search of path expressions.  Literal patterns, each compiled once; a long list becomes a join so that the plan stays small."""
    rows = indicators.of("path_regex")
    found = observed_paths(events)
    side = _side(events.sparkSession, [(k, "path_regex", i.value, guarded(i.value, "i"), *_meta(i)) for k, i in enumerate(rows)], f"n int, kind string, indicator string, java string, {_META}")
    if len(rows) <= PATTERNS_INLINE:
        hit = F.array_compact(F.array(*(F.when(F.col("observed").rlike(guarded(i.value, "i")), F.lit(k)) for k, i in enumerate(rows)))) if rows else F.array().cast("array<int>")
        spread = found.withColumn("n", F.explode(hit))
        return spread.join(side.drop("java"), "n").drop("n")
    return found.join(side, F.expr("observed RLIKE java")).drop("n", "java")


def match_hashes(files: DataFrame, indicators: Indicators | DataFrame, content: str = "content", most_bytes: int = 50 << 20, allow: tuple[str, ...] = ()) -> DataFrame:
    """Files (path, size, mtime, content) whose digest is listed, in indicators or in a table (kind, indicator, comment, source, line) of any size.

    Each (path, size, mtime) is hashed once, only with the digests that have indicators; files beyond `most_bytes` (0: no limit) and below an allowed
    prefix are left out.  Prefixes are lower-cased and no more, so `C:\\Win` covers `C:\\Windows` too."""
    own = files
    if most_bytes:
        own = own.where(F.col("size") <= most_bytes)
    low = C.ascii_lower(F.col("path"))
    for p in allow:
        own = own.where(~C.true(F.startswith(low, F.lit(p.lower()))))
    own = own.dropDuplicates(["path", "size", "mtime"])
    digest = {"md5": F.md5(content), "sha1": F.sha1(content), "sha256": F.sha2(content, 256)}
    if isinstance(indicators, DataFrame):
        kinds, side = list(digest), indicators.withColumn("key", F.col("indicator"))
    else:
        kinds = [k for k in digest if indicators.of(k)]
        side = _side(files.sparkSession, [(i.kind, i.value, i.value, *_meta(i)) for k in digest for i in indicators.of(k)], f"kind string, key string, indicator string, {_META}")
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), digest[k].alias("observed")) for k in kinds)) if kinds else F.array().cast("array<struct<kind:string,observed:string>>")
    spread = own.drop(content) if not kinds else own.withColumn("h", F.explode(pairs)).drop(content).select("*", "h.*").drop("h")
    if not kinds:
        spread = spread.withColumns({"kind": F.lit("md5"), "observed": F.lit(None).cast("string")}).where("false")
    return spread.join(side.withColumnRenamed("kind", "k"), (F.col("kind") == F.col("k")) & (F.col("observed") == F.col("key"))).drop("k", "key")


def alert_columns(matches: DataFrame, severity: str = "high") -> DataFrame:
    """Rule name, description, severity and engine of indicator alerts; an unknown severity is high."""
    level = {"low": "Low", "medium": "Medium", "high": "High", "critical": "Critical"}.get(severity.strip().lower(), "High")
    told = F.concat_ws(" | ", "comment", F.when(F.col("observed") != F.col("indicator"), F.concat(F.lit("observed: "), "observed")), F.concat(F.lit("source: "), "source"))
    return matches.withColumns({"rule_name": F.concat(F.lit("ioc:"), "kind", F.lit(":"), "indicator"), "rule_description": told, "severity": F.lit(level), "engine": F.lit("Ioc")})


def match_all(events: DataFrame, indicators: Indicators, key: str = "seq") -> DataFrame:
    """Every domain, address and path match of every event, each once."""
    got = match_domains(events, indicators).unionByName(match_ips(events, indicators)).unionByName(match_paths(events, indicators))
    return got.dropDuplicates([key, "kind", "indicator", "observed", "source", "line"])
