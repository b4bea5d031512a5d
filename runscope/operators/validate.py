"""Validation jobs: every row gets the codes of the constraints that it violates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscope import schemas as S
from runscope.functions import text as X


def _codes(checks: dict[str, Column]) -> Column:
    """Codes of the checks that do not hold; a null counts as not holding."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in checks.items()]))


def _length(c: str, low: int, high: int) -> Column:
    return F.length(c).between(low, high)


def _optional(c: str, ok: Column) -> Column:
    return F.col(c).isNull() | ok


def validate_events(ev: DataFrame) -> DataFrame:
    return ev.withColumn("violations", _codes({
        "id": _length("event_id", 1, 1 << 20), "timestamp": F.col("event_ts").isNotNull(), "kind": F.col("kind").isin(*S.EVENT_KINDS), "summary": _length("summary", 0, S.MAX_SUMMARY),
    }))


def validate_signals(signals: DataFrame) -> DataFrame:
    return signals.withColumn("violations", _codes({
        "id": _length("id", 1, 1 << 20), "kind": F.col("kind").isin(*S.SIGNAL_KINDS), "severity": F.col("severity").isin(*S.SEVERITIES), "source": F.col("source").isin(*S.SIGNAL_SOURCES),
        "event_ids": X.is_unique(F.col("event_ids")), "observed_at": F.col("observed_at").isNotNull(), "freshness": F.col("freshness").isin(*S.FRESHNESS), "summary": _length("summary", 1, S.MAX_SIGNAL_SUMMARY),
        "payload": F.coalesce(F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT"), F.lit(False)),
    }))


def validate_observations(packets: DataFrame) -> DataFrame:
    event_ok = lambda e: (F.length(e["id"]) >= 1) & e["timestamp"].isNotNull() & e["kind"].isin(*S.EVENT_KINDS) & (F.length(e["summary"]) <= S.MAX_SUMMARY)
    signal_ok = lambda s: (F.length(s["id"]) >= 1) & s["kind"].isin(*S.SIGNAL_KINDS) & s["severity"].isin(*S.SEVERITIES) & s["source"].isin(*S.SIGNAL_SOURCES) & X.is_unique(s["event_ids"]) & s["freshness"].isin(*S.FRESHNESS) & F.length(s["summary"]).between(1, S.MAX_SIGNAL_SUMMARY)
    return packets.withColumn("violations", _codes({
        "schema_version": F.col("schema_version") == S.SCHEMA_VERSION, "session.id": F.length("session.id") >= 1, "session.workspace": F.col("session.workspace").isNotNull(), "session.started_at": F.col("session.started_at").isNotNull(),
        "session.elapsed_seconds": F.col("session.elapsed_seconds") >= 0, "session.state": F.col("session.state").isin(*S.SESSION_STATES), "goal.text": F.col("goal.text").isNotNull(), "goal.acceptance_criteria": F.col("goal.acceptance_criteria").isNotNull(),
        "goal.paths": X.is_unique(F.col("goal.expected_paths")) & X.is_unique(F.col("goal.forbidden_paths")), "window.to_cursor": F.col("window.to_cursor").isNotNull(), "window.order": F.col("window.opened_at") <= F.col("window.closed_at"),
        "events.count": F.size("events").between(0, S.MAX_EVENTS), "events": F.forall("events", event_ok), "signals": F.forall("signals", signal_ok), "redactions": X.is_unique(F.col("redactions")),
    }))


def validate_assessments(a: DataFrame) -> DataFrame:
    evidence_ok = lambda e: e["ref_type"].isin(*S.REF_TYPES) & (F.length(e["ref_id"]) >= 1) & F.length(e["claim"]).between(1, S.MAX_CLAIM)
    concern_ok = lambda c: c["severity"].isin(*S.SEVERITIES) & c["kind"].isin(*S.CONCERN_KINDS) & F.length(c["explanation"]).between(1, S.MAX_EXPLANATION) & X.is_unique(c["evidence_refs"])
    return a.withColumn("violations", _codes({
        "schema_version": F.col("schema_version") == S.SCHEMA_VERSION, "status": F.col("status").isin(*S.STATUSES), "current_action": _length("current_action", 1, S.MAX_ACTION), "goal_alignment": F.col("goal_alignment").isin(*S.ALIGNMENTS),
        "evidence.count": F.size("evidence").between(1, S.MAX_EVIDENCE), "evidence": F.forall("evidence", evidence_ok), "basis_ids": (F.size("basis_ids") >= 1) & X.is_unique(F.col("basis_ids")),
        "concerns.count": F.size("concerns").between(0, S.MAX_CONCERNS), "concerns": F.forall("concerns", concern_ok), "needs_attention": F.col("needs_attention").isNotNull(),
        "recommended_human_action": _optional("recommended_human_action", _length("recommended_human_action", 0, 1000)), "confidence": F.col("confidence").between(0, 1), "assessed_by": F.col("assessed_by").isin(*S.ASSESSORS),
        "escalation_reason": _optional("escalation_reason", _length("escalation_reason", 0, 500)), "assessed_at": F.col("assessed_at").isNotNull(),
    }))


def unknown_fields(raw: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Keys of JSON objects that a closed object does not have."""
    return raw.withColumn("extra", F.array_except(F.json_object_keys(column), F.array(*[F.lit(a) for a in allowed]))).where(F.size("extra") > 0)


def validate_semantics(packets: DataFrame) -> DataFrame:
    """Across fields: window order, cursors, order and uniqueness of events, events within the window, references."""
    times = F.transform("events", lambda e: e["timestamp"])
    ids = F.transform("events", lambda e: e["id"])
    refs = F.flatten(F.transform("signals", lambda s: s["event_ids"]))
    offset = lambda c: X.parse_cursor(F.col(c))["offset"]
    return packets.withColumn("violations", _codes({
        "window.order": F.col("window.opened_at") <= F.col("window.closed_at"), "cursor.order": F.col("window.from_cursor").isNull() | (offset("window.from_cursor") <= offset("window.to_cursor")),
        "events.order": times == F.array_sort(times), "events.unique": X.is_unique(ids), "events.window": F.forall(times, lambda t: t.between(F.col("window.opened_at"), F.col("window.closed_at"))),
        "signals.unique": X.is_unique(F.transform("signals", lambda s: s["id"])), "references": F.size(F.array_except(refs, ids)) == 0,
    }))


def unresolved_refs(assessments: DataFrame, packets: DataFrame) -> DataFrame:
    """(packet_id, ref) for every reference of an assessment that its packet does not hold."""
    given = packets.select("packet_id", F.concat(F.transform("events", lambda e: e["id"]), F.transform("signals", lambda s: s["id"])).alias("ids"))
    cited = assessments.select("packet_id", F.array_distinct(F.concat("basis_ids", F.flatten(F.transform("concerns", lambda c: c["evidence_refs"])), F.transform(F.filter("evidence", lambda e: e["ref_type"] != "system"), lambda e: e["ref_id"]))).alias("refs"))
    both = cited.join(given, "packet_id", "left")
    return both.select("packet_id", F.explode(F.array_except("refs", F.coalesce("ids", F.array().cast("array<string>")))).alias("ref"))


def citation_validity(assessments: DataFrame, packets: DataFrame) -> DataFrame:
    """One row: n, n_valid, rate of assessments all of whose references resolve."""
    bad = unresolved_refs(assessments, packets).select("packet_id", F.lit(1).alias("bad")).distinct()
    out = assessments.select("packet_id").join(bad, "packet_id", "left").agg(F.count("*").alias("n"), F.count_if(F.col("bad").isNull()).alias("n_valid"))
    return out.withColumn("rate", F.try_divide(F.col("n_valid").cast("double"), F.col("n")))
