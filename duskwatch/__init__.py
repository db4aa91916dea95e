"""Duskwatch: endpoint telemetry to alerts on Spark.

Raw records are routed and normalized, enriched by as-of joins, matched against Sigma rules, atomic indicators and
content rules, shaped into ECS alerts and given a response decision: all as DataFrames, batch or streaming.
"""
