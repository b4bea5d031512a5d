"""The generic ``events`` table as normalised session events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runscope.schemas import EVENT

EXPECTED, FORBIDDEN = ("src", "docs"), ("secrets",)


def project_events(events: DataFrame) -> DataFrame:
    """``events`` (event_id, ts, user_id, event_type, value, props) in the columns of EVENT.

    The session is the user, the offset the event id; what the kind has no use for
    is null.
    """
    k = F.get_json_object("props", "$.k").try_cast("int")
    on = lambda kind, value: F.when(F.col("event_type") == kind, value)
    kind = F.coalesce(on("click", F.lit("command_result")), on("error", F.lit("error")), on("view", F.lit("file_changed")), on("purchase", F.lit("test_result")), on("signup", F.lit("turn_lifecycle")), F.lit("unknown"))
    top = F.when(k % 10 == 0, "secrets").when(k % 10 == 1, "infra").when(k % 10 == 2, "docs").otherwise("src")
    ts = F.col("ts").cast("timestamp")
    made = {
        "event_id": F.col("event_id").cast("string"),
        "session_id": F.concat(F.lit("s"), F.col("user_id")),
        "event_ts": ts,
        "ingest_ts": ts,
        "source_path": F.concat(F.lit("events/"), F.col("user_id")),
        "source_offset": F.col("event_id"),
        "kind": kind,
        "source_type": F.col("event_type"),
        "summary": F.concat_ws(" ", "event_type", "props"),
        "path": on("view", F.concat(top, F.lit("/f"), k, F.lit(".py"))),
        "exit_code": on("click", F.when(k % 5 == 0, 0).otherwise(1)),
        "phase": on("signup", F.when(k % 2 == 0, "turn_started").otherwise("turn_complete")),
        "command_norm": on("click", F.concat(F.lit("cmd_"), k % 3)),
        "error_fp": on("error", F.concat(F.lit("err_"), k % 4)),
        "test_target": on("purchase", F.concat(F.lit("t"), k % 2)),
        "tests_failed": on("purchase", k % 7),
        "payload_sha256": F.sha2("props", 256),
        "payload_bytes": F.octet_length("props").cast("long"),
        "day": F.to_date("ts"),
    }
    return events.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT])
