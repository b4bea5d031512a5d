"""Normalisation of raw records, and the per-session window operators.

All windows share one order within a session: event time, source path, source
offset.  Rules over one session therefore need a single shuffle.  Events that
``segments.segmented`` has cut make the rules run by segment, with the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runscope.functions import redaction as R
from runscope.functions import text as X
from runscope.operators import segments as G
from runscope.operators.segments import ORDER
from runscope.schemas import EVENT, EVENT_KINDS, MAX_SUMMARY
from runscope.session import materialize

#: Record types of the raw log and their kinds; a mapping table of the caller may replace it.
MAPPING = {
    "user_message": "message", "assistant_message": "message", "message": "message", "reasoning": "reasoning", "exec_command": "command",
    "exec_result": "command_result", "file_read": "file_read", "patch_applied": "file_changed", "test_run": "test_result", "error": "error",
    "turn_started": "turn_lifecycle", "turn_complete": "turn_lifecycle", "turn_failed": "turn_lifecycle", "input_requested": "turn_lifecycle", "approval_requested": "turn_lifecycle",
    "process_exit": "process_lifecycle", "terminal_marker": "process_lifecycle",
}


#: The columns of an event that the rules read.
RULED = ("session_id", "event_id", *ORDER, "kind", "phase", "path", "exit_code", "call_id", "command_norm", "error_fp", "test_target", "tests_passed", "tests_failed", "summary")


def session_window(*more: str) -> Window:
    return Window.partitionBy("session_id", *more).orderBy(*ORDER)


def running(*more: str) -> Window:
    return session_window(*more).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _field(path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col("__v"), f"$.{path}", kind)


def quarantine(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of ``raw`` (source_path, source_offset, line): a line that is no JSON object keeps only its hash and length."""
    fine = F.coalesce(F.schema_of_variant(F.try_parse_json("line")).startswith("OBJECT"), F.lit(False))
    bad = raw.where(~fine).select("source_path", "source_offset", F.sha2("line", 256).alias("line_sha256"), F.octet_length("line").cast("long").alias("line_bytes"))
    return raw.where(fine), bad


def log_sessions(raw: DataFrame) -> DataFrame:
    """(source_path, session_id): the id in each log's first metadata record; no row for a log without one."""
    v = raw.select("source_path", "source_offset", F.try_parse_json("line").alias("__v"))
    own = v.where((_field("type") == "session_meta") & _field("payload.id").isNotNull()).select("source_path", "source_offset", _field("payload.id").alias("id"))
    return own.groupBy("source_path").agg(F.min_by("id", "source_offset").alias("session_id"))


def file_session(path: Column) -> Column:
    """The session that a log's name stands for."""
    return F.regexp_extract(path, r"([^/]+)\.jsonl$", 1)


def normalize(raw: DataFrame, mapping: dict[str, str] | None = None, prefixes: tuple[str, ...] = (), usernames: tuple[str, ...] = (), size: int = MAX_SUMMARY, logs: DataFrame | None = None) -> DataFrame:
    """Raw lines (source_path, source_offset, line, optional ingest_ts) as events.

    The session is a record's own ``session_id``, else the one of its log's metadata
    (``logs``, as ``log_sessions`` gives it), else the file's name, so that events and
    metadata of a log agree.  Of a long command output the summary keeps both ends.  An
    unknown type stays, as kind ``unknown`` with its type.  Texts are redacted and
    cut before anything is stored; of the payload only hash and length remain.
    """
    good, _ = quarantine(raw)
    if logs is not None:
        good = good.join(logs.select("source_path", F.col("session_id").alias("__log")), "source_path", "left")
    v = good.withColumn("__v", F.try_parse_json("line"))
    kinds = F.create_map(*[F.lit(x) for kv in (mapping or MAPPING).items() for x in kv])
    table = R.patterns(prefixes, usernames)
    body = F.coalesce(_field("payload.text"), _field("payload.output"), _field("payload.message"), _field("payload.command"), F.lit(""))
    source_type = F.coalesce(_field("type"), F.lit("missing"))
    workspace = F.coalesce(_field("payload.workspace"), F.lit(""))
    code = _field("payload.exit_code", "int")
    step = v.select(
        "source_path", "source_offset", "line", (F.col("ingest_ts") if "ingest_ts" in raw.columns else F.current_timestamp()).alias("ingest_ts"),
        source_type.alias("source_type"), X.parse_time(_field("timestamp")).alias("event_ts"), body.alias("body"), code.alias("exit_code"), _field("payload.role").alias("role"),
        F.coalesce(_field("payload.session_id"), _field("session_id"), *([F.col("__log")] if logs is not None else []), file_session(F.col("source_path"))).alias("session_id"),
        F.when(_field("payload.path").isNotNull(), X.canonical_path(_field("payload.path"), workspace)).alias("path"),
        _field("payload.call_id").alias("call_id"), _field("payload.command").alias("command"), _field("payload.target").alias("test_target"),
    )
    kind = F.coalesce(F.try_element_at(kinds, F.col("source_type")), F.lit("unknown"))
    step = step.withColumn("kind", F.when(kind.isin(*EVENT_KINDS), kind).otherwise("unknown")).withColumn("payload_sha256", F.sha2("line", 256))
    counts = X.test_counts(F.col("body"), F.col("exit_code"))
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    made = {
        "event_id": X.event_id(F.col("session_id"), F.col("source_offset"), F.col("source_type"), F.col("payload_sha256")),
        "summary": R.safe_summary(F.col("body"), size, table, F.when(is_("command_result", "test_result"), F.col("exit_code"))),
        "phase": F.when(is_("turn_lifecycle", "process_lifecycle"), F.col("source_type")),
        "command_norm": F.when(is_("command", "command_result"), X.normalize_command(R.redact(F.col("command"), table))),
        "error_fp": F.when(is_("error"), X.error_fingerprint(F.col("body"))),
        "runner": F.when(is_("test_result"), counts["runner"]),
        "tests_passed": F.when(is_("test_result"), counts["passed"]),
        "tests_failed": F.when(is_("test_result"), counts["failed"]),
        "payload_bytes": F.octet_length("line").cast("long"),
        "redactions": R.classes(F.col("body"), table, size),
        "day": F.to_date("event_ts"),
    }
    return step.select(*[made.get(f.name, F.col(f.name) if f.name in step.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT])


def unknown_types(ev: DataFrame) -> DataFrame:
    return ev.where("kind = 'unknown'").groupBy("source_type").agg(F.count("*").alias("n"))


def all_events(*sources: DataFrame) -> DataFrame:
    """Union of event sources by column names (rollout, process evidence, ...)."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def dedupe(ev: DataFrame) -> DataFrame:
    """One row for each id.  A row number leaves wide rows as they are, where an aggregate would take each column apart."""
    nth = Window.partitionBy("event_id").orderBy("event_id")
    return ev.withColumn("__nth", F.row_number().over(nth)).where("__nth = 1").drop("__nth")


def new_events(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    return incoming.join(stored.select("event_id"), "event_id", "left_anti")


def after_cursor(ev: DataFrame, cursors: DataFrame) -> DataFrame:
    """Events beyond each session's cursor (session_id, source_offset); all of a session that has none."""
    c = cursors.select("session_id", F.col("source_offset").alias("__from"))
    return ev.join(c, "session_id", "left").where(F.col("source_offset") > F.coalesce("__from", F.lit(-1))).drop("__from")


def session_goal(messages: DataFrame, goals: DataFrame | None = None) -> DataFrame:
    """(session_id, goal_text, expected_paths, forbidden_paths, acceptance_criteria): the first user message unless a goal is given.

    ``messages`` has session_id, role, text and the columns of the order that it
    names ``seq``; absent criteria and paths are empty, never null.
    """
    first = messages.where("role = 'user'").groupBy("session_id").agg(F.min_by("text", "seq").alias("first_text"))
    empty = F.array().cast("array<string>")
    names = ("expected_paths", "forbidden_paths", "acceptance_criteria")
    if goals is None:
        return first.select("session_id", F.col("first_text").alias("goal_text"), *[empty.alias(n) for n in names])
    both = first.join(goals, "session_id", "full_outer")
    return both.select("session_id", F.coalesce("goal_text", "first_text").alias("goal_text"), *[F.coalesce(n, empty).alias(n) for n in names])


def session_summary(ev: DataFrame) -> DataFrame:
    """One row a session: events, each kind's count, first and last time, elapsed seconds."""
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in EVENT_KINDS]
    out = ev.groupBy("session_id").agg(F.count("*").alias("n_events"), F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"), *counts)
    return out.withColumn("elapsed_seconds", X.elapsed(F.col("first_ts"), F.col("last_ts")))


def turns(ev: DataFrame) -> DataFrame:
    """Adds turn_no (started turns so far) and ordinal within the turn, from 1."""
    started = F.col("phase") == "turn_started"
    numbered = G.running(ev, "turn_no", F.when(started, 1).otherwise(0))
    if not G.columns(ev):
        return numbered.withColumn("ordinal", F.row_number().over(session_window("turn_no")))
    placed = G.latest(G.running(numbered, "__at", F.lit(1)), "__start", F.when(started, F.col("__at")))
    return placed.withColumn("ordinal", (F.col("__at") - F.coalesce("__start", F.lit(1)) + 1).cast("int")).drop("__at", "__start")


def pair_commands(ev: DataFrame, max_seconds: int | None = None) -> DataFrame:
    """(session_id, call_id, command_id, result_id, exit_code, started, ended): a command and its result.

    By call id where both have one; a command without takes the next result of its
    session before the next command.
    """
    run = ev.where("kind in ('command', 'command_result')")
    by_call = run.where("kind = 'command' and call_id is not null").alias("c").join(run.where("kind = 'command_result' and call_id is not null").alias("r"), ["session_id", "call_id"], "left")
    called = by_call.select("session_id", "call_id", F.col("c.event_id").alias("command_id"), F.col("r.event_id").alias("result_id"), F.col("r.exit_code").alias("exit_code"), F.col("c.event_ts").alias("started"), F.col("r.event_ts").alias("ended"))
    w = session_window()
    loose = run.where("call_id is null").select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in ("kind", "event_id", "exit_code", "event_ts")]).where("kind = 'command'")
    got = F.col("next_kind") == "command_result"
    rest = loose.select("session_id", "call_id", F.col("event_id").alias("command_id"), *[F.when(got, F.col(f"next_{c}")).alias(n) for c, n in (("event_id", "result_id"), ("exit_code", "exit_code"))], F.col("event_ts").alias("started"), F.when(got, F.col("next_event_ts")).alias("ended"))
    return called.unionByName(rest)


def repeated_command(ev: DataFrame, n: int = 3) -> DataFrame:
    """Runs of a command with the same outcome, without a file change between, of ``n`` or more.

    Other commands between do not break a run.  One row for each run.
    """
    epoch = G.running(ev.where("kind in ('file_changed', 'command_result')"), "epoch", (F.col("kind") == "file_changed").cast("int"))
    own = G.previous(epoch.where("kind = 'command_result' and command_norm is not null"), "__before", F.struct("exit_code"), "command_norm", "epoch")
    same = F.col("__before").isNull() | F.col("__before.exit_code").eqNullSafe(F.col("exit_code"))
    own = G.running(own.withColumn("changed", F.when(same, 0).otherwise(1)), "island", F.col("changed"), "command_norm", "epoch")
    key = ("session_id", "command_norm", "epoch", "island")
    found = own.groupBy(*key).agg(
        F.count("*").alias("n"), F.min_by("event_id", F.struct(*ORDER)).alias("first_event"), F.max_by("event_id", F.struct(*ORDER)).alias("last_event"),
        F.max("event_ts").alias("last_ts"), F.first("exit_code").alias("exit_code"),
    )
    return found.where(F.col("n") >= n)


def recurring_error(ev: DataFrame, n: int = 3) -> DataFrame:
    own = ev.where("kind = 'error' and error_fp is not null")
    found = own.groupBy("session_id", "error_fp").agg(F.count("*").alias("n"), F.min_by("event_id", F.struct(*ORDER)).alias("first_event"), F.max_by("event_id", F.struct(*ORDER)).alias("last_event"), F.max("event_ts").alias("last_ts"))
    return found.where(F.col("n") >= n)


def new_files(ev: DataFrame) -> DataFrame:
    """The first change of each path in a session."""
    own = ev.where("kind = 'file_changed' and path is not null")
    return G.previous(own, "__before", F.struct(F.lit(1)), "path").where("__before is null").drop("__before")


def test_trend(ev: DataFrame) -> DataFrame:
    """Test results with ``trend`` against the target's previous one: improving, stable, worsening or unknown."""
    own = ev.where("kind = 'test_result'")
    own = G.previous(own, "__before", F.struct("tests_failed", "tests_passed"), "test_target")
    own = own.withColumn("prev_failed", F.col("__before.tests_failed")).withColumn("prev_passed", F.col("__before.tests_passed")).drop("__before")
    f, pf, p, pp = (F.col(c) for c in ("tests_failed", "prev_failed", "tests_passed", "prev_passed"))
    worse = (f > pf) | ((f == pf) & F.coalesce(p < pp, F.lit(False)))
    better = (f < pf) | ((f == pf) & F.coalesce(p > pp, F.lit(False)))
    return own.withColumn("trend", F.when(f.isNull() | pf.isNull(), "unknown").when(worse, "worsening").when(better, "improving").otherwise("stable"))


def fixed_commands(ev: DataFrame) -> DataFrame:
    """Results of a command that failed before and now succeeds."""
    own = ev.where("kind = 'command_result' and command_norm is not null")
    own = G.previous(own, "__before", F.struct("exit_code"), "command_norm")
    return own.withColumn("prev_exit", F.col("__before.exit_code")).drop("__before").where("exit_code = 0 and prev_exit <> 0")


def hypothesis_changes(ev: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Reasoning whose tokens differ from the previous one's by a Jaccard below ``threshold``; the first counts."""
    own = ev.where("kind = 'reasoning'").withColumn("__t", X.tokens(F.col("summary")))
    own = G.previous(own, "__p", F.struct("__t"))
    before = F.col("__p.__t")
    return own.where(before.isNull() | (X.jaccard(F.col("__t"), before) < threshold)).drop("__t", "__p")


def progress_markers(ev: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(session_id, event_id, event_ts, source_path, source_offset, marker), one row for each event and marker."""
    targets = G.previous(ev.where("kind = 'test_result'"), "__before", F.struct(F.lit(1)), "test_target").where("__before is null")
    found = [
        ("hypothesis", hypothesis_changes(ev, threshold)), ("new_file", new_files(ev)), ("new_test_target", targets),
        ("improved_test", test_trend(ev).where("trend = 'improving'")), ("fixed_command", fixed_commands(ev)), ("milestone", ev.where("phase = 'turn_complete'")),
    ]
    out = None
    for name, rows in found:
        rows = rows.select("session_id", "event_id", *ORDER, F.lit(name).alias("marker"), *G.columns(ev))
        out = rows if out is None else out.unionByName(rows)
    return out


def since_progress(ev: DataFrame, markers: DataFrame) -> DataFrame:
    """Each event with the time of the last marker up to it and the seconds since (null before the first)."""
    own = ["session_id", "event_id", *ORDER, *G.columns(ev)]
    marked = ev.select(*own).unionByName(markers.select(*own)).distinct()
    marked = marked.join(markers.select("session_id", "event_id", F.lit(True).alias("__m")).distinct(), ["session_id", "event_id"], "left")
    marked = marked.repartition("session_id", G.SEGMENT) if G.columns(ev) else marked
    marked = G.latest(marked, "last_progress", F.when(F.col("__m"), F.col("event_ts")))
    return marked.withColumn("seconds", X.elapsed(F.col("last_progress"), F.col("event_ts"))).drop("__m")


def stagnation_gaps(ev: DataFrame, markers: DataFrame, seconds: int = 1500, asof=None, segment_rows: int | None = None) -> DataFrame:
    """(session_id, gap_start, gap_end, seconds): stretches of at least ``seconds`` without a marker.

    The stretch behind a session's last marker ends at ``asof`` (a literal time) or
    its last event.  With ``segment_rows`` sessions of more markers are cut; the points
    are written first, as cutting reads them three times.
    """
    ends = ev.groupBy("session_id").agg(F.min("event_ts").alias("event_ts"), F.max("event_ts").alias("last_ts"))
    ends = ends.withColumn("last_ts", F.lit(asof).cast("timestamp")) if asof is not None else ends
    points = markers.select("session_id", "event_ts").unionByName(ends.select("session_id", "event_ts")).unionByName(ends.select("session_id", F.col("last_ts").alias("event_ts"))).distinct()
    points = G.segmented(materialize(points, "points"), segment_rows) if segment_rows else points
    gaps = G.previous(points, "__from", F.struct("event_ts"), order=("event_ts",)).where("__from is not null")
    gaps = gaps.select("session_id", F.col("__from.event_ts").alias("gap_start"), F.col("event_ts").alias("gap_end"))
    return gaps.withColumn("seconds", X.elapsed(F.col("gap_start"), F.col("gap_end"))).where(F.col("seconds") >= seconds)


def suppress_active(gaps: DataFrame, commands: DataFrame, max_seconds: int = 3600, segment_rows: int | None = None) -> DataFrame:
    """Gaps that no running command covers; a command counts until its result, ``max_seconds`` at most.

    A sweep: commands by their start and gaps by their end in one order; a gap is covered
    where the latest end of the commands that began before it lies behind its start.  The
    work is linear in both, whatever overlaps.  With ``segment_rows`` sessions of more are cut,
    and both are written first, as cutting reads them three times.
    """
    limit = F.col("started") + F.make_interval(secs=F.lit(max_seconds))
    none = F.lit(None).cast("timestamp")
    busy = commands.select("session_id", F.col("started").alias("at"), F.lit(1).alias("kind"), F.least(F.coalesce("ended", limit), limit).alias("until"), none.alias("gap_start"), F.lit(None).cast("long").alias("seconds"))
    ends = gaps.select("session_id", F.col("gap_end").alias("at"), F.lit(0).alias("kind"), none.alias("until"), "gap_start", F.col("seconds").cast("long").alias("seconds"))
    both = ends.unionByName(busy)
    both = G.segmented(materialize(both, "sweep"), segment_rows, at="at") if segment_rows else both
    swept = G.running(both, "latest", F.col("until"), of=F.max, order=("at", "kind")).where("kind = 0")
    free = swept.where(F.col("latest").isNull() | (F.col("latest") <= F.col("gap_start")))
    return free.select("session_id", "gap_start", F.col("at").alias("gap_end"), F.col("seconds").cast(gaps.schema["seconds"].dataType).alias("seconds"))


def check_monotonic(ev: DataFrame) -> DataFrame:
    """Events whose time goes back against the previous offset of their file."""
    w = Window.partitionBy("source_path").orderBy("source_offset")
    return ev.withColumn("prev_ts", F.lag("event_ts").over(w)).where("event_ts < prev_ts")


def rate(ev: DataFrame, kind: str, seconds: int) -> DataFrame:
    """Each event with the number of events of ``kind`` in the look-back interval up to it."""
    w = Window.partitionBy("session_id").orderBy(F.unix_micros("event_ts")).rangeBetween(-seconds * 1_000_000, 0)
    return ev.withColumn("n_recent", F.count_if(F.col("kind") == kind).over(w))


def quiet_gaps(ev: DataFrame, seconds: int) -> DataFrame:
    """Events that a silence of more than ``seconds`` follows, with its length."""
    gap = X.elapsed(F.col("event_ts"), F.lead("event_ts").over(session_window()))
    return ev.withColumn("gap_seconds", gap).where(F.col("gap_seconds") > seconds)


def activity(ev: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Events and errors of each session in tumbling windows; batch and stream alike."""
    out = ev.groupBy("session_id", F.window("event_ts", width).alias("w")).agg(F.count("*").alias("n_events"), F.count_if(F.col("kind") == "error").alias("n_errors"))
    return out.select("session_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_events", "n_errors")


def idle_sessions(ev: DataFrame, gap: str) -> DataFrame:
    """Stretches of activity that silences of ``gap`` separate."""
    out = ev.groupBy("session_id", F.session_window("event_ts", gap).alias("w")).agg(F.count("*").alias("n_events"))
    return out.select("session_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events")


def cap_events(ev: DataFrame, n: int = 200) -> DataFrame:
    """The newest ``n`` of each session."""
    newest = Window.partitionBy("session_id").orderBy(*[F.desc(c) for c in ORDER])
    return ev.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= n)


def fold_overflow(ev: DataFrame, n: int = 200) -> DataFrame:
    """Counts by kind of what cap_events leaves out."""
    newest = Window.partitionBy("session_id").orderBy(*[F.desc(c) for c in ORDER])
    return ev.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") > n).groupBy("session_id", "kind").agg(F.count("*").alias("n"))


def changed_files(ev: DataFrame) -> DataFrame:
    return ev.where("kind = 'file_changed' and path is not null").groupBy("session_id").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def new_paths(now: DataFrame, known: DataFrame) -> DataFrame:
    """Paths of a window that no earlier one had."""
    return now.select("session_id", "path").where("path is not null").distinct().join(known.select("session_id", "path"), ["session_id", "path"], "left_anti")


def events_page(ev: DataFrame, session: str, after: int, n: int) -> DataFrame:
    """A page of a session's events beyond a cursor, in order; the next cursor is its last offset."""
    return ev.where((F.col("session_id") == session) & (F.col("source_offset") > after)).orderBy("source_offset").limit(n)


def apply_retention(ev: DataFrame, today, days: int) -> DataFrame:
    """Only partitions of the last ``days`` days."""
    return ev.where(F.col("day") > F.date_sub(F.lit(today).cast("date"), days))


def chronological(ev: DataFrame) -> DataFrame:
    """Each session in one partition and in order."""
    return ev.repartition("session_id").sortWithinPartitions("session_id", *ORDER)


def reconcile_ingest(raw_ids: DataFrame, stored: DataFrame) -> DataFrame:
    """Event ids of a full scan that the store does not have."""
    return raw_ids.select("event_id").distinct().join(stored.select("event_id"), "event_id", "left_anti")
