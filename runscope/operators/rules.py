"""Deterministic signals and their reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscope.functions import text as X
from runscope.operators import events as E
from runscope.schemas import SEVERITY_OF, severity_name, severity_rank


def make_signal(rows: DataFrame, kind: str, subject: Column, event_ids: Column, observed: Column, summary: Column, payload: Column | None = None, source: str = "local_rule", freshness: str = "current") -> DataFrame:
    """Rows with session_id as signals; the id is stable over session, kind and subject."""
    subject = F.coalesce(subject.cast("string"), F.lit(""))
    return rows.select(
        F.sha2(F.concat_ws("\x1f", F.col("session_id"), F.lit(kind), subject), 256).alias("id"),
        "session_id", F.lit(kind).alias("kind"), subject.alias("subject"), F.lit(SEVERITY_OF[kind]).alias("severity"), F.lit(source).alias("source"),
        event_ids.cast("array<string>").alias("event_ids"), observed.alias("observed_at"), F.lit(freshness).alias("freshness"),
        F.substring(summary, 1, 1000).alias("summary"), (F.to_json(payload) if payload is not None else F.lit("{}")).alias("payload"),
    )


def lifecycle(ev: DataFrame, asof=None, grace_seconds: int = 300) -> DataFrame:
    """(session_id, state, last_ts, last_turn_phase, exit_code): a session's state from explicit evidence alone.

    A turn's end leaves it between turns.  It is over only by a terminal marker, or
    by a process exit that no new turn follows within the grace period before
    ``asof`` (the newest event by default).  Prose never counts.
    """
    struct = F.struct(*E.ORDER)
    turn, process = F.col("kind") == "turn_lifecycle", F.col("kind") == "process_lifecycle"
    out = ev.groupBy("session_id").agg(
        F.max("event_ts").alias("last_ts"), F.max_by("phase", F.when(turn, struct)).alias("last_turn_phase"), F.max(F.when(turn & (F.col("phase") == "turn_started"), F.col("event_ts"))).alias("last_start"),
        F.max_by("exit_code", F.when(process, struct)).alias("exit_code"), F.max(F.when(process, F.col("event_ts"))).alias("exit_ts"), F.max_by("phase", F.when(process, struct)).alias("exit_phase"),
    )
    if asof is None:
        out = out.crossJoin(F.broadcast(ev.agg(F.max("event_ts").alias("__now"))))  # one row
    now = F.col("__now") if asof is None else F.lit(asof).cast("timestamp")
    ended = F.col("exit_ts").isNotNull() & ~F.coalesce(F.col("last_start") > F.col("exit_ts"), F.lit(False))
    quiet = X.elapsed(F.col("exit_ts"), now) >= grace_seconds
    state = (
        F.when(ended & (F.col("exit_phase") == "terminal_marker"), "terminal_completed")
        .when(ended & (F.col("exit_code") != 0), "terminal_failed")
        .when(ended & (F.col("exit_code") == 0) & quiet, "terminal_completed")
        .when(F.col("last_turn_phase").isin("input_requested", "approval_requested"), "waiting")
        .when(F.col("last_turn_phase") == "turn_started", "active_turn")
        .when(F.col("last_turn_phase").isin("turn_complete", "turn_failed"), "between_turns")
        .otherwise("unknown")
    )
    return out.select("session_id", state.alias("state"), "last_ts", "last_turn_phase", "exit_code")


def path_scope(ev: DataFrame, goals: DataFrame) -> DataFrame:
    """File changes with ``forbidden`` and ``unexpected`` against the session's bounds (goals: session_id, expected_paths, forbidden_paths)."""
    g = goals.select("session_id", "expected_paths", "forbidden_paths")
    own = ev.where("kind = 'file_changed' and path is not null").join(g, "session_id", "left")
    return own.withColumn("forbidden", X.is_forbidden(F.col("path"), F.col("forbidden_paths"))).withColumn("unexpected", X.is_unexpected(F.col("path"), F.col("expected_paths")))


def repeated_command_signals(ev: DataFrame, n: int = 3) -> DataFrame:
    r = E.repeated_command(ev, n)
    subject = F.concat_ws(":", "command_norm", "epoch", "island")
    return make_signal(r, "repeated_command", subject, F.array("first_event", "last_event"), F.col("last_ts"), F.concat(F.lit("repeated "), F.col("n"), F.lit(" times: "), F.col("command_norm")), F.struct("n", "exit_code"))


def recurring_error_signals(ev: DataFrame, n: int = 3) -> DataFrame:
    r = E.recurring_error(ev, n)
    return make_signal(r, "recurring_error", F.col("error_fp"), F.array_distinct(F.array("first_event", "last_event")), F.col("last_ts"), F.concat(F.lit("same error "), F.col("n"), F.lit(" times")), F.struct("n"))


def test_regression_signals(ev: DataFrame) -> DataFrame:
    r = E.test_trend(ev).where("trend = 'worsening'")
    return make_signal(r, "test_regression", F.col("event_id"), F.array("event_id"), F.col("event_ts"), F.concat(F.lit("tests got worse: "), F.coalesce("test_target", F.lit("?"))), F.struct("prev_failed", "tests_failed"))


def scope_signals(ev: DataFrame, goals: DataFrame) -> DataFrame:
    """One signal for each path: forbidden ones critical, unexpected ones that are not forbidden warnings."""
    own = path_scope(ev, goals)
    out = None
    for kind, rows in (("forbidden_path", own.where("forbidden")), ("scope_expansion", own.where("unexpected and not forbidden"))):
        first = rows.groupBy("session_id", "path").agg(F.min_by("event_id", F.struct(*E.ORDER)).alias("event_id"), F.max("event_ts").alias("at"), F.count("*").alias("n"))
        made = make_signal(first, kind, F.col("path"), F.array("event_id"), F.col("at"), F.concat(F.lit("changed "), F.col("path")), F.struct("n"))
        out = made if out is None else out.unionByName(made)
    return out


def stagnation_signals(ev: DataFrame, markers: DataFrame, seconds: int = 1500, max_command_seconds: int = 3600, asof=None) -> DataFrame:
    gaps = E.suppress_active(E.stagnation_gaps(ev, markers, seconds, asof), E.pair_commands(ev), max_command_seconds)
    return make_signal(gaps, "stagnation", F.unix_seconds("gap_start"), F.array().cast("array<string>"), F.col("gap_end"), F.concat(F.lit("no progress for "), F.col("seconds"), F.lit(" s")), F.struct("seconds"))


def lifecycle_signals(ev: DataFrame, states: DataFrame) -> DataFrame:
    waiting = make_signal(states.where("state = 'waiting'"), "waiting", F.lit("session"), F.array().cast("array<string>"), F.col("last_ts"), F.concat(F.lit("waiting: "), F.col("last_turn_phase")))
    turn = ev.where("phase = 'turn_failed'")
    failed = make_signal(turn, "turn_failed", F.col("event_id"), F.array("event_id"), F.col("event_ts"), F.lit("a turn failed"))
    ended = ev.where("kind = 'process_lifecycle' and exit_code <> 0")
    return waiting.unionByName(failed).unionByName(make_signal(ended, "process_failed", F.col("event_id"), F.array("event_id"), F.col("event_ts"), F.concat(F.lit("process ended with "), F.col("exit_code")), F.struct("exit_code")))


def read_supplemental(rows: DataFrame, versions: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, dependency_unavailable signals for the rows of other versions)."""
    known = F.col("schema_version").isin(*versions) if versions else F.lit(False)
    other = rows.where(~F.coalesce(known, F.lit(False))).groupBy(F.col("canonical_session_id").alias("session_id"), "schema_version").agg(F.max("observed_at").alias("at"))
    return rows.where(known), make_signal(other, "dependency_unavailable", F.col("schema_version"), F.array().cast("array<string>"), F.col("at"), F.concat(F.lit("unsupported version "), F.coalesce("schema_version", F.lit("none"))), source="system")


def correlate(sessions: DataFrame, supplemental: DataFrame) -> DataFrame:
    """Sessions with the one supplemental row of their id; none where it is missing or ambiguous, and no new session."""
    once = supplemental.groupBy("canonical_session_id").agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in supplemental.columns if c != "canonical_session_id"]).where("__n = 1").drop("__n")
    out = sessions.join(once, sessions["session_id"] == once["canonical_session_id"], "left")
    return out.withColumn("correlation", F.when(F.col("canonical_session_id").isNotNull(), F.concat(F.lit("canonical_id/"), F.col("schema_version")))).drop("canonical_session_id")


def context_growth_signals(correlated: DataFrame, limit: int) -> DataFrame:
    return make_signal(correlated.where(F.col("context_tokens") >= limit), "context_growth", F.lit("context"), F.array().cast("array<string>"), F.col("observed_at"), F.concat(F.lit("context of "), F.col("context_tokens"), F.lit(" tokens")), F.struct("context_tokens"), source="supplemental")


def all_signals(ev: DataFrame, goals: DataFrame, seconds: int = 1500, asof=None, n: int = 3, markers: DataFrame | None = None, states: DataFrame | None = None) -> DataFrame:
    """Every local rule's signals; ``markers`` and ``states`` are the events' progress markers and lifecycle where they are at hand."""
    markers = E.progress_markers(ev) if markers is None else markers
    out = repeated_command_signals(ev, n)
    for more in (recurring_error_signals(ev, n), test_regression_signals(ev), scope_signals(ev, goals), stagnation_signals(ev, markers, seconds, asof=asof), lifecycle_signals(ev, lifecycle(ev, asof) if states is None else states)):
        out = out.unionByName(more)
    return out


def freshness(signals: DataFrame, now, ttl_seconds: int = 900) -> DataFrame:
    age = X.elapsed(F.col("observed_at"), F.lit(now).cast("timestamp"))
    return signals.withColumn("freshness", F.when(age.isNull(), "unknown").when(age <= ttl_seconds, "current").otherwise("stale"))


def merge_signals(signals: DataFrame) -> DataFrame:
    """One row for each finding: all sources, all events, the highest severity, and the text of the newest current local signal.

    A stale outside signal never replaces a newer local one.
    """
    local = ((F.col("source") == "local_rule") & (F.col("freshness") == "current")).cast("int")
    best = F.struct(local, F.col("observed_at"), F.col("id"))
    out = signals.groupBy("session_id", "kind", "subject").agg(
        F.max(severity_rank(F.col("severity"))).alias("rank"), F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("event_ids")))).alias("event_ids"),
        F.max_by("summary", best).alias("summary"), F.max_by("freshness", best).alias("freshness"), F.max("observed_at").alias("observed_at"), F.max_by("id", best).alias("id"),
    )
    return out.withColumn("severity", severity_name(F.col("rank"))).drop("rank")


def attention(signals: DataFrame) -> DataFrame:
    """(session_id, max_severity, n_signals, needs_attention): a critical signal asks for a human."""
    rank = severity_rank(F.col("severity"))
    out = signals.groupBy("session_id").agg(F.max(rank).alias("rank"), F.count("*").alias("n_signals"), F.coalesce(F.bool_or(rank == 2), F.lit(False)).alias("needs_attention"))
    return out.select("session_id", severity_name(F.col("rank")).alias("max_severity"), "n_signals", "needs_attention")


def sessions_with_critical(sessions: DataFrame, signals: DataFrame) -> DataFrame:
    return sessions.join(signals.where("severity = 'critical'").select("session_id"), "session_id", "left_semi")
