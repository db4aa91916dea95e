"""Stateful enrichment as window and as-of operations over event time.

The caches of a live agent become, in batch, the last value before each row within a key; each is one shuffle on the key and one sort.  Ages are whole
seconds of event time, so a replay gives the same result every time.  Rows of equal time are ordered start, probe, stop.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAVE_SECONDS = 60
DNS_SECONDS = 900
INTERVALS = 50
CONNECTION = ("image", "dest_ip", "dest_port", "protocol")


def asof_process(probes: DataFrame, starts: DataFrame, stops: DataFrame, pid: str = "pid", at: str = "seq", carry: tuple[str, ...] = ("Image",), grave: int = GRAVE_SECONDS, prefix: str = "proc_") -> DataFrame:
    """`probes` with the columns `carry` of the process that last started under their pid, if it still ran or stopped at most `grave` seconds before."""
    none = F.lit(None)
    kinds = starts.schema
    s = starts.select(F.col(pid).alias("__p"), F.col(at).alias("__t"), F.lit(0).alias("__k"), *(F.col(c).alias(f"__c_{c}") for c in carry))
    e = stops.select(F.col(pid).alias("__p"), F.col(at).alias("__t"), F.lit(2).alias("__k"), *(none.cast(kinds[c].dataType).alias(f"__c_{c}") for c in carry))
    row = F.struct(*probes.columns)
    p = probes.select(F.col(pid).alias("__p"), F.col(at).alias("__t"), F.lit(1).alias("__k"), *(none.cast(kinds[c].dataType).alias(f"__c_{c}") for c in carry), row.alias("__row"))
    every = p.unionByName(s.unionByName(e), allowMissingColumns=True)
    w = Window.partitionBy("__p").orderBy("__t", "__k").rowsBetween(Window.unboundedPreceding, 0)
    start = F.last(F.when(F.col("__k") == 0, F.struct(F.col("__t").alias("t"), *(F.col(f"__c_{c}") for c in carry))), ignorenulls=True).over(w)
    stop = F.last(F.when(F.col("__k") == 2, F.col("__t")), ignorenulls=True).over(w)
    out = every.withColumns({"__start": start, "__stop": stop}).where("__row IS NOT NULL")
    live = F.col("__start").isNotNull() & (F.col("__stop").isNull() | (F.col("__stop") < F.col("__start.t")) | (F.col("__t") - F.col("__stop") <= grave))
    return out.select("__row.*", *(F.when(live, F.col(f"__start.__c_{c}")).alias(prefix + c) for c in carry))


def exact_process(probes: DataFrame, starts: DataFrame, keys: tuple[str, str] = ("pid", "created")) -> DataFrame:
    """Lookup by pid and creation time."""
    return probes.join(starts, list(keys), "left")


def with_parents(starts: DataFrame, pid: str = "pid", ppid: str = "ppid", at: str = "seq", stops: DataFrame | None = None) -> DataFrame:
    """Starts with ParentImage and ParentCommandLine from the parent's own start, where they lack them."""
    none = starts.select(F.col(pid), F.col(at)).where("false") if stops is None else stops
    probe = starts.withColumnRenamed(pid, "__own").withColumnRenamed(ppid, pid)
    got = asof_process(probe, starts, none, pid, at, ("Image", "CommandLine"), prefix="__parent_")
    return got.withColumnRenamed(pid, ppid).withColumnRenamed("__own", pid).withColumns({"ParentImage": F.coalesce("ParentImage", "__parent_Image"), "ParentCommandLine": F.coalesce("ParentCommandLine", "__parent_CommandLine")}).drop("__parent_Image", "__parent_CommandLine")


BACK_FILLED = ("Registry", "Network", "Dns", "Service", "Task")


def back_fill_image(events: DataFrame, starts: DataFrame, stops: DataFrame, pid: str = "header_pid", at: str = "seq") -> DataFrame:
    """Image of the process in the event's header, where a category that takes it has none."""
    s, e = starts.withColumnRenamed("pid", pid), stops.withColumnRenamed("pid", pid)
    got = asof_process(events, s, e, pid, at, ("Image",), prefix="__")
    return got.withColumn("Image", F.when(F.col("category").isin(*BACK_FILLED), F.coalesce("Image", "__Image")).otherwise(F.col("Image"))).drop("__Image")


def answers(dns: DataFrame, name: str = "QueryName", results: str = "QueryResults", at: str = "seq", key: tuple[str, ...] = ()) -> DataFrame:
    """(key..., ip, at, hostname): one row for each address in an answer, of either family."""
    from ..functions.columns import addresses

    return dns.where(F.col(name).isNotNull()).select(*key, F.explode(addresses(F.col(results))).alias("ip"), F.col(at), F.col(name).alias("hostname"))


def asof_dns(probes: DataFrame, cache: DataFrame, at: str = "seq", ip: str = "ip", key: tuple[str, ...] = (), ttl: int = DNS_SECONDS) -> DataFrame:
    """`probes` with `asof_hostname`, the last name that resolved to their address less than `ttl` seconds before."""
    by = [*key, ip]
    c = cache.select(*by, F.col(at).alias("__t"), F.lit(0).alias("__k"), F.col("hostname").alias("__h"))
    p = probes.select(*by, F.col(at).alias("__t"), F.lit(1).alias("__k"), F.struct(*probes.columns).alias("__row"))
    w = Window.partitionBy(*by).orderBy("__t", "__k", "__h").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("__k") == 0, F.struct(F.col("__t").alias("t"), F.col("__h").alias("h"))), ignorenulls=True).over(w)
    out = p.unionByName(c, allowMissingColumns=True).withColumn("__last", last).where("__row IS NOT NULL")
    return out.select("__row.*", F.when(F.col("__t") - F.col("__last.t") < ttl, F.col("__last.h")).alias("asof_hostname"))


def protocol(event_id: Column) -> Column:
    """Of a connection, by its raw event id."""
    return F.when(event_id == 12, "tcp").when(event_id == 14, "udp").otherwise("unknown")


def first_connections(events: DataFrame, key: tuple[str, ...] = CONNECTION, at: str = "seq") -> DataFrame:
    """The first event of each connection; an event that lacks a part of the key is always kept."""
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    n = F.row_number().over(Window.partitionBy(*key).orderBy(at))
    return events.where(~whole).unionByName(events.where(whole).withColumn("__n", n).where("__n = 1").drop("__n"))


def connection_stats(events: DataFrame, key: tuple[str, ...] = CONNECTION, at: str = "seq", pid: str = "pid") -> DataFrame:
    return events.groupBy(*key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("connections"), F.countDistinct(pid).alias("pids"))


def beacon_stddev(events: DataFrame, key: tuple[str, ...] = CONNECTION, at: str = "seq", most: int = INTERVALS) -> DataFrame:
    """Population standard deviation of the last `most` intervals of each connection; null below two intervals."""
    w = Window.partitionBy(*key).orderBy(at)
    back = Window.partitionBy(*key).orderBy(F.col(at).desc())
    d = events.select(*key, at, (F.col(at) - F.lag(at).over(w)).alias("d"), F.row_number().over(back).alias("n")).where(F.col("d").isNotNull() & (F.col("n") <= most))
    some = d.groupBy(*key).agg(F.count("*").alias("intervals"), F.stddev_pop("d").alias("s"))
    every = events.select(*key).distinct()
    return every.join(some, list(key), "left").select(*key, F.coalesce("intervals", F.lit(0)).cast("long").alias("intervals"), F.when(F.col("intervals") >= 2, F.col("s")).alias("stddev"))


def rate_limited(events: DataFrame, key: str, at: str, window: int) -> DataFrame:
    """Events that pass a limit of one for each key and `window` seconds, counted from the last that passed, with the number suppressed since.

    Whether an event passes depends on the one that passed before it, so each key is walked in order; keys are spread over the cluster."""
    schema = f"{key} {events.schema[key].dataType.simpleString()}, {at} long, suppressed long"

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        out, last, held = [], None, 0
        for t in sorted(pdf[at].tolist()):
            if last is None or t - last >= window:
                out.append((t, held))
                last, held = t, 0
            else:
                held += 1
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(out), at: [o[0] for o in out], "suppressed": [o[1] for o in out]})

    return events.select(key, F.col(at).cast("long").alias(at)).groupBy(key).applyInPandas(walk, schema)


def with_context(alerts: DataFrame, starts: DataFrame, stops: DataFrame, at: str = "seq", carry: tuple[str, ...] = ("Image", "CommandLine")) -> DataFrame:
    """Alerts with the context of the process they speak of (payload pid, else header pid; never pid 0, never for process events).

    Joined after detection, so that it costs what alerts cost and not what events cost."""
    from ..functions.columns import parse_pid

    pid = F.coalesce(parse_pid(F.col("ProcessId")), F.col("header_pid"))
    probe = alerts.withColumn("__pid", F.when((F.col("category") != "Process") & (pid != 0), pid))
    return asof_process(probe, starts.withColumnRenamed("pid", "__pid"), stops.withColumnRenamed("pid", "__pid"), "__pid", at, carry, prefix="ctx_").drop("__pid")
