"""The whole path from raw records, or telemetry, to decided alerts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .config import Config
from .functions import columns as C
from .operators import ecs, enrich, explain, indicators, normalize, response, yara
from .operators.sigma import RuleSet, compile_rule
from .schema import CONTEXT_FIELDS
from .sources import indicators as indicator_files
from .sources import rules as rule_files
from .sources.indicators import Indicators
from .sources.shared import written

ALERT = ("rule_name", "rule_description", "severity", "engine")
CONNECTION = ("Image", "DestinationIp", "DestinationPort", "protocol")


@dataclass
class Detector:
    rules: RuleSet
    indicators: Indicators = field(default_factory=Indicators)
    yara_rules: list[yara.Rule] = field(default_factory=list)
    severity: str = "high"
    match_debug: str = "off"
    policy: response.Policy = field(default_factory=response.Policy)
    most_file_bytes: int = 50 << 20
    hash_allow: tuple[str, ...] = ()
    yara_allow: tuple[str, ...] = ()
    aggregate_connections: bool = True

    @classmethod
    def load(cls, cfg: Config) -> Detector:
        cat = rule_files.load(cfg.scanner.sigma_rules_path, compile_rule) if cfg.scanner.sigma_enabled else rule_files.Catalogue()
        files = {"hashes": cfg.ioc.hashes_path, "ips": cfg.ioc.ips_path, "domains": cfg.ioc.domains_path, "paths": cfg.ioc.paths_regex_path}
        found = indicator_files.load(files) if cfg.ioc.enabled else Indicators()
        own = yara.load(cfg.scanner.yara_rules_path)[0] if cfg.scanner.yara_enabled else []
        policy = response.Policy(cfg.response.min_severity, not cfg.response.prevention_enabled, None, cfg.response.allowlist_images, cfg.response.allowlist_paths)
        return cls(
            RuleSet.of(cat),
            found,
            own,
            cfg.ioc.default_severity,
            cfg.alerts.match_debug,
            policy,
            cfg.ioc.max_file_size_mb << 20,
            cfg.ioc.hash_allowlist_paths,
            cfg.scanner.yara_allowlist_paths,
            cfg.network.aggregation_enabled,
        )

    @staticmethod
    def tune(spark: SparkSession) -> None:
        """Generated methods beyond 8000 bytes of bytecode are not compiled by the JVM; let such stages run without one."""
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")

    def prepare(self, raw: DataFrame, drives: dict[str, str] | None = None, sids: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Telemetry of raw records, and the process stops among them (pid, seq).

        Parents come from the parent's own start, images of events without one from the process in their header, host names of connections from the last
        answer with their address; of each connection the first event stays.  Both are written to the shared folder, since rules, indicators and context each read them."""
        t = normalize.normalize(raw, drives, sids, {"protocol": enrich.protocol(F.col("event_id"))})
        life = normalize.lifecycle(raw)
        if drives:
            life = life.withColumn("Image", normalize.dos_path(F.col("Image"), drives))
        life = written(life.withColumn("pid", C.parse_pid(F.col("pid"))), "lifecycle")
        starts, stops = life.where("kind = 'start'"), life.where("kind = 'stop'").select("pid", "seq")
        t = written(t, "normalized")
        begun = (F.col("category") == "Process") & (F.col("opcode") == 1)
        process = t.where(begun).withColumns({"pid": C.parse_pid(F.col("ProcessId")), "ppid": C.parse_pid(F.col("ParentProcessId"))})
        process = enrich.with_parents(process, stops=stops).select(t.columns)
        rest = enrich.back_fill_image(t.where(~begun), starts.select("pid", "seq", "Image"), stops)
        network, rest = rest.where("category = 'Network'"), rest.where("category <> 'Network'")
        named = enrich.asof_dns(network, enrich.answers(t.where("category = 'Dns'")).withColumnRenamed("ip", "DestinationIp"), ip="DestinationIp")
        network = named.withColumn("DestinationHostname", F.coalesce("DestinationHostname", "asof_hostname")).drop("asof_hostname")
        if self.aggregate_connections:
            network = enrich.first_connections(network, CONNECTION)
        return written(process.unionByName(rest).unionByName(network).drop("protocol"), "telemetry"), stops

    def detect(self, events: DataFrame, every: bool = False, stops: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
        """Alerts of rules and indicators, with the context of their processes; and of the hashes and content of the images that start, where `files`
        (path, size, mtime, content) has them.  Telemetry columns, `ALERT`, `ctx_<field>` and, if asked for, `match`."""
        self.tune(events.sparkSession)
        sigma = explain.explain(self.rules.alerts(events, every), self.rules, self.match_debug).drop("rule", "logsource")
        found = indicators.alert_columns(indicators.match_all(events, self.indicators), self.severity)
        out = sigma.unionByName(found.select(*events.columns, *ALERT), allowMissingColumns=True)
        starts = events.where("category = 'Process' AND opcode = 1").withColumn("pid", C.parse_pid(F.col("ProcessId"))).select("pid", "seq", *CONTEXT_FIELDS)
        out = enrich.with_context(out, starts, starts.select("pid", "seq").where("false") if stops is None else stops, carry=CONTEXT_FIELDS)
        if files is None:
            return out
        for own in (self.hash_alerts(events, files), self.content_alerts(events, files)):
            out = out.unionByName(own.drop("match") if self.match_debug == "off" else own, allowMissingColumns=True)
        return out

    @staticmethod
    def _images(started: DataFrame, files: DataFrame) -> DataFrame:
        """The files that are images of started processes."""
        return files.join(started.select(C.ascii_lower(F.col("path")).alias("__path")).distinct(), C.ascii_lower(F.col("path")) == F.col("__path"), "left_semi")

    def hash_alerts(self, events: DataFrame, files: DataFrame) -> DataFrame:
        started = yara.triggers(events)
        hit = indicators.match_hashes(self._images(started, files), self.indicators, most_bytes=self.most_file_bytes, allow=self.hash_allow)
        hit = indicators.alert_columns(hit, self.severity).select(C.ascii_lower(F.col("path")).alias("__path"), *ALERT)
        return yara.as_process_events(started.join(hit, C.ascii_lower(F.col("path")) == F.col("__path")), **{c: F.col(c) for c in ALERT})

    def content_alerts(self, events: DataFrame, files: DataFrame) -> DataFrame:
        started = yara.triggers(events, self.yara_allow)
        hit = yara.scan(self._images(started, files).select(C.ascii_lower(F.col("path")).alias("__path"), "content"), self.yara_rules, detail="full")
        return yara.alerts(started.join(hit, C.ascii_lower(F.col("path")) == F.col("__path")))

    def run(self, events: DataFrame, every: bool = False, stops: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
        """ECS columns of all alerts and the response decision of each."""
        decided = response.decide(self.detect(events, every, stops, files), self.policy)
        return ecs.project(decided).withColumn("response_decision", F.col("`edr.response.decision`"))

    def write(self, events: DataFrame, path: str, every: bool = False, stops: DataFrame | None = None, files: DataFrame | None = None) -> None:
        ecs.write_ndjson(self.run(events, every, stops, files).drop("response_decision"), path)

    def follow(self, stream: DataFrame, path: str, checkpoint: str, every: bool = False) -> StreamingQuery:
        """Rules, indicators and decisions over a stream of telemetry, as NDJSON by day.  What needs other events (images, names, context) is taken as the stream has it;
        process starts of the same batch give context."""
        return stream.writeStream.foreachBatch(lambda batch, _: self.write(batch, path, every)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
