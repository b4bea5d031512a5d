"""Types and enumerations of the event model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = "1.0"

# The enumerations of the data contract (assessors and the outside source carry neutral names here).
SESSION_STATES = ("active_turn", "between_turns", "waiting", "terminal_completed", "terminal_failed", "unknown")
EVENT_KINDS = ("message", "reasoning", "command", "command_result", "file_read", "file_changed", "test_result", "error", "turn_lifecycle", "process_lifecycle", "unknown")
SIGNAL_KINDS = (
    "repeated_command", "recurring_error", "stagnation", "scope_expansion", "forbidden_path", "waiting", "turn_failed",
    "process_failed", "test_regression", "context_growth", "supplemental_finding", "dependency_unavailable", "other",
)
SEVERITIES = ("info", "warning", "critical")
SIGNAL_SOURCES = ("local_rule", "supplemental", "system")
FRESHNESS = ("current", "stale", "unknown")
STATUSES = ("progressing", "investigating", "between_turns", "waiting", "stalled", "looping", "off_scope", "terminal_completed", "terminal_failed", "unknown")
ALIGNMENTS = ("aligned", "possibly_aligned", "misaligned", "unknown")
CONCERN_KINDS = ("loop", "stagnation", "scope", "tests", "errors", "waiting", "resource", "uncertainty", "infrastructure", "other")
REF_TYPES = ("event", "signal", "system")
ASSESSORS = ("routine", "strong", "rules")

# Bounds of the data contract.
MAX_EVENTS, MAX_SUMMARY, MAX_EVIDENCE, MAX_CONCERNS = 200, 4000, 12, 8
MAX_SIGNAL_SUMMARY, MAX_ACTION, MAX_EXPLANATION, MAX_CLAIM = 1000, 500, 1000, 500
MIN_CONFIDENCE = 0.72

#: Severity of each rule's signals.
SEVERITY_OF = {
    "repeated_command": "warning", "recurring_error": "warning", "stagnation": "warning", "test_regression": "warning",
    "scope_expansion": "warning", "waiting": "warning", "turn_failed": "warning", "forbidden_path": "critical",
    "process_failed": "critical", "context_growth": "critical", "supplemental_finding": "critical", "dependency_unavailable": "info", "other": "info",
}

EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()), T.StructField("session_id", T.StringType()), T.StructField("event_ts", T.TimestampType()),
        T.StructField("ingest_ts", T.TimestampType()), T.StructField("source_path", T.StringType()), T.StructField("source_offset", T.LongType()),
        T.StructField("kind", T.StringType()), T.StructField("source_type", T.StringType()), T.StructField("summary", T.StringType()),
        T.StructField("path", T.StringType()), T.StructField("exit_code", T.IntegerType()), T.StructField("role", T.StringType()),
        T.StructField("phase", T.StringType()), T.StructField("call_id", T.StringType()), T.StructField("command_norm", T.StringType()),
        T.StructField("error_fp", T.StringType()), T.StructField("runner", T.StringType()), T.StructField("test_target", T.StringType()),
        T.StructField("tests_passed", T.IntegerType()), T.StructField("tests_failed", T.IntegerType()), T.StructField("payload_sha256", T.StringType()),
        T.StructField("payload_bytes", T.LongType()), T.StructField("redactions", T.ArrayType(T.StringType())), T.StructField("day", T.DateType()),
    ]
)

SIGNAL = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("session_id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("subject", T.StringType()),
        T.StructField("severity", T.StringType()), T.StructField("source", T.StringType()), T.StructField("event_ids", T.ArrayType(T.StringType())),
        T.StructField("observed_at", T.TimestampType()), T.StructField("freshness", T.StringType()), T.StructField("summary", T.StringType()), T.StructField("payload", T.StringType()),
    ]
)

EVIDENCE = "struct<ref_type:string,ref_id:string,claim:string>"
CONCERN = "struct<severity:string,kind:string,explanation:string,evidence_refs:array<string>>"
ASSESSMENT = (
    f"packet_id string, session_id string, schema_version string, status string, current_action string, goal_alignment string, evidence array<{EVIDENCE}>, "
    f"basis_ids array<string>, concerns array<{CONCERN}>, needs_attention boolean, recommended_human_action string, confidence double, assessed_by string, "
    "escalation_reason string, event_cursor string, assessed_at timestamp"
)
MODEL_CALL = "packet_id string, session_id string, assessor string, attempt int, call_status string, latency_ms long, input_tokens long, called_at timestamp"
DELIVERY = "dedupe_key string, session_id string, status string, attempt int, last_at timestamp, retry_after_s int"
REQUEST = "idempotency_key string, session_id string, requested_at timestamp, cost double"
SUPPLEMENTAL = "canonical_session_id string, schema_version string, prompt_tokens long, context_tokens long, observed_at timestamp"
LABEL = "session_id string, status string, goal_alignment string, needs_attention boolean, evidence_event_ids array<string>, acceptable_summary string, outcome_class string, factual boolean"


def severity_rank(severity: Column) -> Column:
    """info 0, warning 1, critical 2; anything else null."""
    return F.when(severity == "info", 0).when(severity == "warning", 1).when(severity == "critical", 2)


def severity_name(rank: Column) -> Column:
    return F.when(rank == 0, "info").when(rank == 1, "warning").when(rank == 2, "critical")
