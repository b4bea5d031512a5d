"""Operational counters: aggregates without content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that a metric may carry as labels.
LABELS = frozenset(("metric", "value", "day", "kind", "source_type", "assessor", "call_status", "status", "bucket", "source"))


def _unpivoted(rows: DataFrame, **values) -> DataFrame:
    """All metrics of one input by one aggregation."""
    held = rows.agg(*[v.cast("double").alias(n) for n, v in values.items()])
    return held.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in values])))


def counters(ev: DataFrame, quarantined: DataFrame, calls: DataFrame, escalated: DataFrame, deliveries: DataFrame) -> DataFrame:
    """(metric, value) of all counters; each input is scanned once."""
    parts = [
        _unpivoted(ev, sessions_observed=F.count_distinct("session_id"), events_ingested=F.count("*"), unknown_event_types=F.count_distinct(F.when(F.col("kind") == "unknown", F.col("source_type")))),
        _unpivoted(quarantined, events_rejected=F.count("*")),
        _unpivoted(calls, model_calls=F.count("*"), model_failures=F.count_if(F.col("call_status") != "ok"), input_tokens_avg=F.avg("input_tokens")),
        _unpivoted(escalated, escalation_rate=F.avg(F.col("escalate").cast("double"))),
        _unpivoted(deliveries, notifications_sent=F.count_if(F.col("status") == "sent"), notifications_failed=F.count_if(F.col("status").startswith("failed"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def latency_histogram(calls: DataFrame, low: float = 0, high: float = 60_000, buckets: int = 12) -> DataFrame:
    return calls.groupBy("assessor", F.width_bucket(F.col("latency_ms").cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"))


def availability(supplemental: DataFrame) -> DataFrame:
    """(source, available, last_at) from rows (source, available, ts)."""
    return supplemental.groupBy("source").agg(F.max_by("available", "ts").alias("available"), F.max("ts").alias("last_at"))


def lag(ev: DataFrame, files: DataFrame, cursors: DataFrame) -> DataFrame:
    """(source_path, lag_seconds, unread_bytes): the parser's delay, and what of a file (path, size) is beyond its cursor."""
    late = ev.groupBy("source_path").agg(F.max(F.timestamp_diff("SECOND", F.col("event_ts"), F.col("ingest_ts"))).alias("lag_seconds"))
    behind = files.join(cursors.select(F.col("source_path").alias("path"), "source_offset"), "path", "left").select(F.col("path").alias("source_path"), (F.col("size") - F.coalesce("source_offset", F.lit(0))).alias("unread_bytes"))
    return late.join(behind, "source_path", "full_outer")


def deduplicated(told: DataFrame, deliveries: DataFrame) -> DataFrame:
    """How many notices their key suppressed."""
    return told.join(deliveries.select("dedupe_key").distinct(), "dedupe_key", "left_semi").agg(F.count("*").alias("n"))


def check_metric_labels(metrics: DataFrame) -> list[str]:
    """Columns that a metric table must not have."""
    return sorted(set(metrics.columns) - LABELS - {"n"})
