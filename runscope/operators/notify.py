"""Transitions, notification policy, rendering, outbox and retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runscope.functions import redaction as R
from runscope.functions import text as X

#: Statuses whose entry is always told.
TOLD = ("waiting", "stalled", "looping", "off_scope", "terminal_failed", "terminal_completed")


def transitions(assessments: DataFrame, order: tuple[str, ...] = ("assessed_at",)) -> DataFrame:
    """Assessments (session_id, status, needs_attention, fingerprint) with the previous one's values; only where one of them changes."""
    w = Window.partitionBy("session_id").orderBy(*order)
    out = assessments
    for c in ("status", "needs_attention", "fingerprint"):
        out = out.withColumn(f"prev_{c}", F.lag(c).over(w))
    same = F.col("status").eqNullSafe(F.col("prev_status")) & F.col("needs_attention").eqNullSafe(F.col("prev_needs_attention")) & F.col("fingerprint").eqNullSafe(F.col("prev_fingerprint"))
    return out.where(~same)


def notifications(changes: DataFrame) -> DataFrame:
    """What is told, with ``reason``: attention turned on, a told status entered, or a warning that stays with other concerns.

    A change of wording alone leaves the fingerprint and is never told.
    """
    entered = F.col("status").isin(*TOLD) & ~F.col("status").eqNullSafe(F.col("prev_status"))
    risen = F.col("needs_attention") & ~F.coalesce("prev_needs_attention", F.lit(False))
    stays = F.col("prev_status").eqNullSafe(F.col("status")) & ~F.col("fingerprint").eqNullSafe(F.col("prev_fingerprint")) & (F.col("needs_attention") | F.col("status").isin(*TOLD))
    return changes.withColumn("reason", F.when(risen, "attention").when(entered, "status").when(stays, "warning_changed")).where("reason is not null")


def digest_due(sessions: DataFrame, last: DataFrame, now, every_seconds: int | None = None) -> DataFrame:
    """Sessions whose periodic digest is due; none unless an interval is set."""
    if every_seconds is None:
        return sessions.where(F.lit(False))
    out = sessions.join(last.select("session_id", "last_at"), "session_id", "left")
    return out.where(F.col("last_at").isNull() | (X.elapsed(F.col("last_at"), F.lit(now).cast("timestamp")) >= every_seconds)).drop("last_at")


def keyed(told: DataFrame, cursor: str = "event_cursor") -> DataFrame:
    return told.withColumn("dedupe_key", X.dedupe_key(F.col("session_id"), F.col("status"), F.col("fingerprint"), F.col(cursor).cast("string")))


def undelivered(told: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Each key once, without those delivered or pending."""
    first = told.withColumn("__n", F.row_number().over(Window.partitionBy("dedupe_key").orderBy("session_id"))).where("__n = 1").drop("__n")
    return first.join(deliveries.select("dedupe_key"), "dedupe_key", "left_anti")


def render(told: DataFrame, drilldown: str | None = None) -> DataFrame:
    """The text of a notice: times, action, alignment, concerns, tests, file names, session; never prompts or outputs.

    Columns elapsed_seconds, current_action, goal_alignment, concerns (kinds),
    latest_test, paths.
    """
    e = lambda c: X.escape_markup(R.redact(F.coalesce(c, F.lit("-"))))
    lines = [
        F.concat(F.lit("*"), e(F.col("status")), F.lit("* after "), e((F.col("elapsed_seconds") / 60).cast("long").cast("string")), F.lit(" min")),
        F.concat(F.lit("Action: "), e(F.col("current_action"))),
        F.concat(F.lit("Alignment: "), e(F.col("goal_alignment"))),
        F.concat(F.lit("Concerns: "), e(F.array_join("concerns", ", "))),
        F.concat(F.lit("Tests: "), e(F.col("latest_test"))),
        F.concat(F.lit("Files: "), e(F.array_join(F.transform("paths", X.file_name), ", "))),
        F.concat(F.lit("Session: "), e(F.col("session_id"))),
    ]
    if drilldown:
        lines.append(F.concat(F.lit("Trace: "), e(F.col(drilldown))))
    return told.withColumn("text", F.concat_ws("\n", *lines))


def outbox(told: DataFrame, now) -> DataFrame:
    """New rows of the outbox, pending until a send is confirmed."""
    return told.select("dedupe_key", "session_id", F.lit("pending").alias("status"), F.lit(0).alias("attempt"), F.lit(now).cast("timestamp").alias("last_at"), F.lit(None).cast("int").alias("retry_after_s"))


def latest_deliveries(deliveries: DataFrame) -> DataFrame:
    """The outbox is append-only: the newest row of each key."""
    newest = Window.partitionBy("dedupe_key").orderBy(F.desc("attempt"), F.desc("last_at"), F.desc("status"))
    return deliveries.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def due_retries(deliveries: DataFrame, now, base_seconds: int = 30, longest_seconds: int = 3600, most: int = 10) -> DataFrame:
    """Keys to send again: pending, or failed for a time and past their back-off (doubled each time, or what the far side asked for)."""
    wait = F.greatest(F.coalesce("retry_after_s", F.lit(0)).cast("double"), F.least(F.lit(float(longest_seconds)), base_seconds * F.pow(F.lit(2.0), F.col("attempt"))))
    out = latest_deliveries(deliveries).withColumn("wait_seconds", F.when(F.col("status") == "failed_transient", wait).otherwise(0.0))
    return out.where(F.col("status").isin("pending", "failed_transient") & (F.col("attempt") < most) & (F.unix_seconds("last_at") + F.col("wait_seconds") <= F.unix_seconds(F.lit(now).cast("timestamp"))))


def final_report(ev: DataFrame, assessments: DataFrame) -> DataFrame:
    """One row for each session that ended: status, elapsed, changed files, tests seen."""
    ended = assessments.where("status in ('terminal_completed', 'terminal_failed')").groupBy("session_id").agg(F.max_by("status", "assessed_at").alias("status"))
    facts = ev.groupBy("session_id").agg(
        X.elapsed(F.min("event_ts"), F.max("event_ts")).alias("elapsed_seconds"), F.array_sort(F.collect_set(F.when(F.col("kind") == "file_changed", F.col("path")))).alias("files"),
        F.count_if(F.col("kind") == "test_result").alias("n_tests"), F.max_by("tests_failed", F.when(F.col("kind") == "test_result", F.struct("event_ts", "source_offset"))).alias("last_failed"),
    )
    return ended.join(facts, "session_id")
