"""`python -m duskwatch run --input <parquet> --output <folder>`; a bare call is `run` with the settings' own folders."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from . import config
from .engine import Detector
from .sources.files import read_files


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="duskwatch")
    sub = p.add_subparsers(dest="verb")
    run = sub.add_parser("run", help="detect over a telemetry table")
    rules = sub.add_parser("rules", help="report what the rule files hold")
    for s in (p, run, rules):
        s.add_argument("--config", default="config.toml")
        s.add_argument("--log-level")
    for s in (p, run):
        s.add_argument("--input", default="telemetry.parquet")
        s.add_argument("--output")
        s.add_argument("--console", action="store_true")
        s.add_argument("--raw", action="store_true", help="the input holds raw records, not telemetry")
        s.add_argument("--files", help="a folder with the images that start, for hashes and content rules")
        s.add_argument("--follow", metavar="STATE", help="read new files of the input folder as a stream, with its state in this folder")
    a = p.parse_args(argv)
    cfg = config.load(a.config, log_level=a.log_level)
    logging.basicConfig(level=cfg.logging.level.upper())
    if a.verb == "rules":
        from .operators.sigma import compile_rule
        from .sources.rules import load

        cat = load(cfg.scanner.sigma_rules_path, compile_rule)
        for k, n in cat.stats():
            print(f"{k}\t{n}")
        for path, why in cat.failed[:10]:
            print(f"failed\t{path}\t{why}")
        return 0
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found = Detector.load(cfg)
    if a.follow:
        stream = spark.readStream.schema(spark.read.parquet(a.input).schema).parquet(a.input)
        found.follow(stream, a.output or cfg.alerts.directory, a.follow).awaitTermination()
        return 0
    events, stops = spark.read.parquet(a.input), None
    if a.raw:
        events, stops = found.prepare(events)
    files = read_files(spark, a.files) if a.files else None
    if a.console:
        from .operators import ecs

        ecs.ndjson(found.run(events, stops=stops, files=files).drop("response_decision")).show(50, truncate=False)
    else:
        found.write(events, a.output or cfg.alerts.directory, stops=stops, files=files)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
