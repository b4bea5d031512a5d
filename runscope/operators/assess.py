"""Packets, assessors, escalation and the reconciled assessment."""

from __future__ import annotations

import json
import multiprocessing
import signal
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ProcessPoolExecutor
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from runscope.functions import redaction as R
from runscope.functions import text as X
from runscope.operators import events as E
from runscope.schemas import ALIGNMENTS, ASSESSMENT, MAX_EVENTS, MAX_SUMMARY, MIN_CONFIDENCE, SCHEMA_VERSION, STATUSES, severity_rank


def cap_arrays(array: Column, n: int) -> Column:
    """The ``n`` most severe of structs with ``severity``; equals keep a fixed order by kind and text."""
    def before(a: Column, b: Column) -> Column:
        ra, rb = severity_rank(a["severity"]), severity_rank(b["severity"])
        return F.when(ra > rb, -1).when(ra < rb, 1).when(a["kind"] < b["kind"], -1).when(a["kind"] > b["kind"], 1).when(a["explanation"] < b["explanation"], -1).when(a["explanation"] > b["explanation"], 1).otherwise(0)

    return F.slice(F.array_sort(array, before), 1, n)


def previous_assessment(windows: DataFrame, assessments: DataFrame) -> DataFrame:
    """As-of join: each window (session_id, window_id, opened_at) with the latest assessment at or before its opening.

    One union and one window function by session; no range join.
    """
    a = assessments.select("session_id", F.col("assessed_at").alias("at"), F.lit(0).alias("side"), F.lit(None).cast(windows.schema["window_id"].dataType).alias("window_id"), F.struct(*[F.col(c) for c in assessments.columns]).alias("a"))
    w = windows.select("session_id", F.col("opened_at").alias("at"), F.lit(1).alias("side"), "window_id", F.lit(None).cast(a.schema["a"].dataType).alias("a"))
    order = Window.partitionBy("session_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(w).withColumn("previous", F.last("a", ignorenulls=True).over(order))
    return both.where("side = 1").select("session_id", "window_id", F.col("at").alias("opened_at"), "previous")


def packet_state(ev: DataFrame, size: int = MAX_EVENTS) -> DataFrame:
    """What a packet needs of a session's events, in one bounded row: its newest ``size`` ones, how many there are of each kind, and the span.

    ``merge_states`` adds later events to it, so that a packet over a long window never reads the window again.
    """
    event = F.struct(F.col("event_id").alias("id"), F.col("event_ts").alias("timestamp"), "kind", F.substring("summary", 1, MAX_SUMMARY).alias("summary"), "path", "exit_code", "source_type")
    marks = F.coalesce("redactions", F.array().cast("array<string>"))
    recent = E.cap_events(ev, size).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct(*E.ORDER, event.alias("e"), marks.alias("r")))).alias("recent"))
    kinds = ev.groupBy("session_id", "kind").agg(F.count("*").alias("n")).groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("kinds"))
    span = ev.groupBy("session_id").agg(F.min("event_ts").alias("opened_at"), F.max("event_ts").alias("closed_at"), F.min("source_offset").alias("from_offset"), F.max("source_offset").alias("to_offset"))
    return span.join(recent, "session_id").join(kinds, "session_id")


def merge_states(old: DataFrame, new: DataFrame, size: int = MAX_EVENTS) -> DataFrame:
    """The state of the events of both; each event must be in one of them alone."""
    both = old.alias("a").join(new.alias("b"), "session_id", "full_outer")
    side = lambda c: (F.col(f"a.{c}"), F.col(f"b.{c}"))
    none = F.array().cast(new.schema["recent"].dataType)
    every = F.sort_array(F.concat(*[F.coalesce(c, none) for c in side("recent")]))
    no_kinds = F.create_map().cast(new.schema["kinds"].dataType)
    added = F.map_zip_with(*[F.coalesce(c, no_kinds) for c in side("kinds")], lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
    return both.select(
        "session_id", *[F.least(*side(c)).alias(c) if c in ("opened_at", "from_offset") else F.greatest(*side(c)).alias(c) for c in ("opened_at", "closed_at", "from_offset", "to_offset")],
        F.slice(every, F.greatest(F.lit(1), F.size(every) - size + 1), size).alias("recent"), added.alias("kinds"),
    )


def window_signals(signals: DataFrame, state: DataFrame, n: int) -> DataFrame:
    """(session_id, signals, left): the ``n`` most severe signals of each session's window, later ones first among equals, and how many more there are.

    A signal is of the window if it was observed at its opening or later.
    """
    own = signals.join(state.select("session_id", "opened_at"), "session_id").where(F.col("observed_at") >= F.col("opened_at"))
    first = Window.partitionBy("session_id").orderBy(F.desc(severity_rank(F.col("severity"))), F.desc("observed_at"), "id")
    ranked = own.withColumn("__n", F.row_number().over(first))  # one reading of the signals gives the few and the count of all
    listed = F.sort_array(F.collect_list(F.when(F.col("__n") <= n, F.struct(*SIGNAL_FIELDS))))
    return ranked.groupBy("session_id").agg(listed.alias("signals"), F.greatest(F.count("*") - n, F.lit(0)).alias("left"))


SIGNAL_FIELDS = ("id", "kind", "severity", "source", "event_ids", "observed_at", "freshness", "summary", "payload")


def build_packets(ev: DataFrame, signals: DataFrame, sessions: DataFrame, goals: DataFrame, previous: DataFrame, cursors: DataFrame | None = None, size: int = MAX_EVENTS, max_signals: int = MAX_EVENTS) -> DataFrame:
    """One observation packet for each session with new events.

    The newest ``size`` events beyond the cursor, older ones folded into a counter
    signal; the ``max_signals`` most severe signals of the window, the others counted; explicit
    nulls and empty lists where there is nothing.  Lists are built only from what is
    capped or aggregated already.
    ``sessions`` has session_id, state, workspace, started_at, model; ``previous`` has
    session_id, previous.
    """
    return packets_of(packet_state(E.after_cursor(ev, cursors) if cursors is not None else ev, size), signals, sessions, goals, previous, cursors, max_signals)


def packets_of(state: DataFrame, signals: DataFrame, sessions: DataFrame, goals: DataFrame, previous: DataFrame, cursors: DataFrame | None = None, max_signals: int = MAX_EVENTS) -> DataFrame:
    """Packets of ``packet_state`` rows, however they came about (see ``build_packets``)."""
    listed = F.transform("recent", lambda x: x["e"])
    held = lambda kind: F.size(F.filter("recent", lambda x: x["e"]["kind"] == kind))
    older = F.filter(F.transform(F.sort_array(F.map_entries("kinds")), lambda k: F.struct(k["key"].alias("kind"), (k["value"] - held(k["key"])).alias("n"))), lambda k: k["n"] > 0)
    found = window_signals(signals, state, max_signals)
    out = state.join(found, "session_id", "left").withColumn("older", older)
    kind = found.schema["signals"].dataType

    def counted(subject: str, text: Column, payload: Column) -> Column:
        return F.struct(
            F.sha2(F.concat_ws("\x1f", "session_id", F.lit("other"), F.lit(subject)), 256).alias("id"), F.lit("other").alias("kind"), F.lit("info").alias("severity"), F.lit("system").alias("source"), F.array().cast("array<string>").alias("event_ids"),
            F.col("closed_at").alias("observed_at"), F.lit("current").alias("freshness"), text.alias("summary"), payload.alias("payload"),
        )

    folded = F.aggregate("older", F.lit(0).cast("long"), lambda n, k: n + k["n"])
    fold = F.when(F.size("older") > 0, counted("folded", F.concat(folded, F.lit(" older events")), F.to_json(F.map_from_entries("older"))))
    more = F.when(F.col("left") > 0, counted("signals", F.concat("left", F.lit(" more signals")), F.to_json(F.struct(F.col("left").alias("signals")))))
    every = F.sort_array(F.concat(F.coalesce("signals", F.array().cast(kind)), F.array_compact(F.array(fold, more))))
    out = out.select("session_id", "opened_at", "closed_at", "from_offset", "to_offset", F.element_at("recent", -1)["source_path"].alias("source_path"), listed.alias("events"), every.alias("signals"), F.array_sort(F.array_distinct(F.flatten(F.transform("recent", lambda x: x["r"])))).alias("redactions"))
    out = out.join(sessions, "session_id", "left").join(goals, "session_id", "left").join(previous.select("session_id", "previous"), "session_id", "left")
    empty = F.array().cast("array<string>")
    first = cursors.select("session_id", F.col("source_offset").alias("__cursor")) if cursors is not None else None
    if first is not None:
        out = out.join(first, "session_id", "left")
    from_cursor = F.when(F.col("__cursor").isNotNull(), X.cursor(F.col("source_path"), F.col("__cursor"), F.lit("0"))) if first is not None else F.lit(None).cast("string")
    return out.select(
        F.sha2(F.concat_ws("\x1f", "session_id", F.col("to_offset").cast("string")), 256).alias("packet_id"), "session_id", F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.struct(F.col("session_id").alias("id"), "workspace", "started_at", X.elapsed(F.col("started_at"), F.col("closed_at")).alias("elapsed_seconds"), F.coalesce("state", F.lit("unknown")).alias("state"), "model").alias("session"),
        F.struct(F.coalesce("goal_text", F.lit("")).alias("text"), F.coalesce("acceptance_criteria", empty).alias("acceptance_criteria"), F.coalesce("expected_paths", empty).alias("expected_paths"), F.coalesce("forbidden_paths", empty).alias("forbidden_paths")).alias("goal"),
        F.struct(from_cursor.alias("from_cursor"), X.cursor(F.col("source_path"), F.col("to_offset"), F.lit("0")).alias("to_cursor"), "opened_at", "closed_at").alias("window"),
        F.col("previous").alias("previous_assessment"), "events", "signals", "redactions",
    )


def apply_trust_mode(packets: DataFrame, mode: str, workspace_prefix: str = "/") -> DataFrame:
    """What of a packet leaves the machine.

    local: as it is.  trusted_remote: every text redacted, no absolute path in a column
    or a text.  metadata_only: no text at all that stems from prompts, commands or
    outputs; kinds, counts, times, states, ids and file names stay.
    """
    if mode == "local":
        return packets
    if mode not in ("trusted_remote", "metadata_only"):
        raise ValueError(f"unknown trust mode {mode}")
    bare = mode == "metadata_only"
    bared = lambda c: F.regexp_replace(c, r"(^|[\s\"'=(:,])(?:/[^\s\"'()/,;:]+)+/([^\s\"'()/,;:]*)", "$1$2")  # noqa: E731 - an absolute path as its last part
    safe = lambda c: F.when(c.isNotNull(), F.lit("")) if bare else bared(R.redact(c))
    relative = lambda p: F.when(F.startswith(p, F.lit("/")), X.file_name(p)).otherwise(p)
    paths = lambda c: F.transform(c, relative)
    texts = lambda c: F.array().cast("array<string>") if bare else F.transform(c, safe)
    out = packets.withColumn("events", F.transform("events", lambda e: e.withField("summary", safe(e["summary"])).withField("path", relative(e["path"]))))
    out = out.withColumn("signals", F.transform("signals", lambda s: s.withField("summary", safe(s["summary"])).withField("payload", F.when(s["source"] == "system", s["payload"]).otherwise(safe(s["payload"])))))
    out = out.withColumn("session", F.col("session").withField("workspace", X.file_name(F.col("session.workspace"))))
    goal = F.col("goal").withField("text", safe(F.col("goal.text"))).withField("acceptance_criteria", texts(F.col("goal.acceptance_criteria")))
    goal = goal.withField("expected_paths", paths(F.col("goal.expected_paths"))).withField("forbidden_paths", paths(F.col("goal.forbidden_paths")))
    out = out.withColumn("goal", goal)
    window = F.col("window")
    for c in ("from_cursor", "to_cursor"):
        window = window.withField(c, F.concat(X.file_name(F.regexp_extract(window[c], r"^(.*):(\d+:[^:]*)$", 1)), F.lit(":"), F.regexp_extract(window[c], r"^(.*):(\d+:[^:]*)$", 2)))
    out = out.withColumn("window", window)
    kind = packets.schema["previous_assessment"].dataType
    if isinstance(kind, T.StructType):
        previous = F.col("previous_assessment")
        for f in kind.fields:
            if f.name in ("current_action", "recommended_human_action", "escalation_reason", "summary"):
                previous = previous.withField(f.name, safe(F.col(f"previous_assessment.{f.name}")))
            elif f.name == "concerns":
                previous = previous.withField("concerns", F.transform(F.col("previous_assessment.concerns"), lambda c: c.withField("explanation", safe(c["explanation"]))))
            elif f.name == "evidence":
                previous = previous.withField("evidence", F.transform(F.col("previous_assessment.evidence"), lambda e: e.withField("claim", safe(e["claim"]))))
        out = out.withColumn("previous_assessment", F.when(F.col("previous_assessment").isNotNull(), previous))
    elif isinstance(kind, T.StringType):
        out = out.withColumn("previous_assessment", safe(F.col("previous_assessment")))
    return out


def packet_json(packets: DataFrame) -> DataFrame:
    """Packets as JSON lines with explicit nulls."""
    names = ("schema_version", "session", "goal", "window", "previous_assessment", "events", "signals", "redactions")
    return packets.select("packet_id", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("json"))


Assessor = Callable[[dict], dict]
#: One call of an assessor: how it ended (ok, error or timeout), whether the answer is of the contract's form, and the answer.
ATTEMPT = f"packet_id string, session_id string, assessor string, attempt int, call_status string, latency_ms long, valid boolean, error string, answer struct<{', '.join(f'{n}:{k}' for n, k in (c.split(' ', 1) for c in ASSESSMENT.split(', ')))}>"


def _answer(row: dict, answer: dict, names: list[str]) -> dict:
    """The columns of ASSESSMENT of what an assessor gave."""
    a = {"packet_id": row["packet_id"], "session_id": row["session_id"], "schema_version": SCHEMA_VERSION} | answer
    at = a.get("assessed_at")
    if isinstance(at, str):
        at = datetime.fromisoformat(at)
    a["assessed_at"] = at.replace(tzinfo=timezone.utc) if at is not None and at.tzinfo is None else at
    return {n: a.get(n) for n in names}


def _sent(packets: DataFrame, partitions: int | None) -> DataFrame:
    rows = packet_json(packets).join(packets.select("packet_id", "session_id"), "packet_id")
    return rows.repartition(partitions) if partitions else rows


def assess(packets: DataFrame, assessor: Assessor, partitions: int | None = None) -> DataFrame:
    """Runs a pluggable assessor over packets as a distributed job.

    It gets a packet as a dictionary of plain values (observed content is data,
    never an instruction; it gets no tools) and returns the columns of ASSESSMENT
    that it knows.  Select the packets that are due before this step.  An assessor that
    may be late or fail goes through ``attempts``.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(ASSESSMENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([_answer(row, assessor(json.loads(row["json"])), arrow.names) for row in b.to_pylist()], schema=arrow)

    return _sent(packets, partitions).mapInArrow(run, ASSESSMENT)


class _Late(BaseException):
    """Not an Exception, so that an assessor's own handlers let it pass."""


def call_within(f: Callable[[], object], seconds: float) -> tuple[str, object]:
    """(ok, result), (error, message) or (timeout, None) of a call that is broken off after so many seconds.

    It runs on the main thread of a worker's process, under a timer; a call that does not
    come back to the interpreter (a loop in native code) is late when it ends.
    """

    def late(*_) -> None:
        raise _Late

    before = signal.signal(signal.SIGALRM, late)
    try:
        signal.setitimer(signal.ITIMER_REAL, seconds)
        try:
            return "ok", f()
        except Exception as e:
            return "error", f"{type(e).__name__}: {e}"
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
    except _Late:
        return "timeout", None
    finally:
        signal.signal(signal.SIGALRM, before)


def in_form(a: dict) -> bool:
    """Whether an answer has what every later step reads: known values and a confidence between 0 and 1."""
    number = isinstance(a["confidence"], (int, float)) and 0 <= a["confidence"] <= 1
    return number and a["status"] in STATUSES and a["goal_alignment"] in ALIGNMENTS and isinstance(a["needs_attention"], bool)


#: Calls of an assessor that a task has under way at once: they mostly wait, for an answer or for the deadline.
CALLS = 16
#: Packets that a task hands to its processes before it gives their rows on.
ROWS_AT_ONCE = 2000
#: What the processes of a task call, one row at a time; they have it from the task that they were forked from.
_tried: Callable[[dict], list[dict]] | None = None


def _own(tried: Callable[[dict], list[dict]]) -> None:
    global _tried
    _tried = tried


def _try(row: dict) -> list[dict]:
    return _tried(row)


def attempts(packets: DataFrame, assessor: Assessor, name: str, seconds: float, tries: int = 2, partitions: int | None = None, calls: int = CALLS) -> DataFrame:
    """ATTEMPT rows of a plug-in over packets: a late or failing call is a row, never a failed job.

    A packet is tried at most ``tries`` times, until an answer is in form; the strong
    assessor is not asked again after a timeout.  A task has up to ``calls`` packets under
    way, each in a process of its own, whose main thread has the deadline; so it takes at
    most ``tries`` times ``seconds`` for each ``calls`` of its packets.  ``select_attempt``
    chooses among the rows.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(ATTEMPT))
    names = T.StructType.fromDDL(ASSESSMENT).names

    def tried(row: dict) -> list[dict]:
        rows = []
        for n in range(1, tries + 1):
            began = time.monotonic()
            status, said = call_within(lambda: _answer(row, assessor(json.loads(row["json"])), names), seconds)
            out = {"packet_id": row["packet_id"], "session_id": row["session_id"], "assessor": name, "attempt": n, "call_status": status, "latency_ms": int((time.monotonic() - began) * 1000), "valid": False, "error": said if status == "error" else None, "answer": None}
            if status == "ok":
                try:
                    out |= {"valid": in_form(said), "answer": pa.array([said], arrow.field("answer").type).to_pylist()[0]}
                except (pa.ArrowInvalid, pa.ArrowTypeError, TypeError) as e:  # values of other kinds
                    out |= {"valid": False, "answer": None, "error": f"{type(e).__name__}: {e}"}
            rows.append(out)
            if out["valid"] or (status == "timeout" and name == "strong"):
                break
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ProcessPoolExecutor(calls, multiprocessing.get_context("fork"), _own, (tried,)) as pool:
            for b in batches:
                for k in range(0, b.num_rows, ROWS_AT_ONCE):
                    found = pool.map(_try, b.slice(k, ROWS_AT_ONCE).to_pylist())
                    yield pa.RecordBatch.from_pylist([a for rows in found for a in rows], schema=arrow)

    return _sent(packets, partitions).mapInArrow(run, ATTEMPT)


def rule_status(sessions: DataFrame, signals: DataFrame, markers: DataFrame, ev: DataFrame, *more: Column) -> DataFrame:
    """What rules alone say of each session: session_id, status, goal_alignment, needs_attention, confidence, assessed_by.

    Precedence: ended, waiting, forbidden path, loops, stagnation, between turns,
    progress, any activity.  ``sessions`` has session_id and state.  Of the signals only
    session_id, kind and severity are read, and what ``more``, aggregates of a session's
    signals that come along, names.
    """
    has = lambda kind: F.coalesce(F.bool_or(F.col("kind").isin(*kind)), F.lit(False))
    found = signals.groupBy("session_id").agg(
        has(["forbidden_path"]).alias("forbidden"), has(["repeated_command", "recurring_error"]).alias("looping"), has(["stagnation"]).alias("stalled"), F.coalesce(F.bool_or(F.col("severity") == "critical"), F.lit(False)).alias("critical"), *more
    )
    active = ev.groupBy("session_id").agg(F.count("*").alias("n_events"))
    progressed = markers.groupBy("session_id").agg(F.count("*").alias("n_markers"))
    out = sessions.select("session_id", "state").join(found, "session_id", "left").join(active, "session_id", "left").join(progressed, "session_id", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = (
        F.when(F.col("state").isin("terminal_failed", "terminal_completed", "waiting"), F.col("state")).when(no("forbidden"), "off_scope").when(no("looping"), "looping").when(no("stalled"), "stalled")
        .when(F.col("state") == "between_turns", "between_turns").when(F.col("n_markers") > 0, "progressing").when(F.col("n_events") > 0, "investigating").otherwise("unknown")
    )
    own = {"session_id", "forbidden", "looping", "stalled", "critical"}
    return out.select(
        "session_id", status.alias("status"), F.when(no("forbidden"), "misaligned").otherwise("unknown").alias("goal_alignment"), no("critical").alias("needs_attention"),
        F.lit(1.0).alias("confidence"), F.lit("rules").alias("assessed_by"), *[c for c in found.columns if c not in own],
    )


def rule_assessment(sessions: DataFrame, signals: DataFrame, markers: DataFrame, ev: DataFrame) -> DataFrame:
    """The assessment that rules alone give: what ``rule_status`` says, with concerns and evidence."""
    concern_kind = F.create_map(*[F.lit(x) for kv in {
        "repeated_command": "loop", "recurring_error": "errors", "stagnation": "stagnation", "scope_expansion": "scope", "forbidden_path": "scope", "waiting": "waiting", "turn_failed": "errors",
        "process_failed": "errors", "test_regression": "tests", "context_growth": "resource", "supplemental_finding": "loop", "dependency_unavailable": "infrastructure", "other": "other",
    }.items() for x in kv])
    concern = F.struct("severity", F.element_at(concern_kind, F.col("kind")).alias("kind"), F.col("summary").alias("explanation"), F.array("id").alias("evidence_refs"))
    # the most severe few are chosen before they are gathered
    top = Window.partitionBy("session_id").orderBy(F.desc(severity_rank(F.col("severity"))), "kind", "subject", "id")
    ranked = signals.withColumn("__n", F.row_number().over(top))
    most = F.transform(F.sort_array(F.collect_list(F.when(F.col("__n") <= 8, F.struct("__n", concern.alias("c"))))), lambda x: x["c"])
    out = rule_status(sessions, ranked, markers, ev, most.alias("concerns"))
    return out.select(
        "session_id", "status", "goal_alignment", "needs_attention", F.coalesce("concerns", F.array().cast(out.schema["concerns"].dataType)).alias("concerns"),
        F.array(F.struct(F.lit("system").alias("ref_type"), F.lit("rules").alias("ref_id"), F.lit("assessed by rules").alias("claim"))).alias("evidence"), "confidence", "assessed_by",
    )


def escalation_reasons(stagnation_seconds: int = 1500) -> Column:
    """Why an assessment needs the strong assessor; empty where it does not.

    On columns confidence, goal_alignment, status, has_critical, has_warning_loop,
    stagnation_seconds and requested.
    """
    conflict = (F.col("status") == "progressing") & (F.col("has_critical") | F.col("has_warning_loop"))
    return F.array_compact(
        F.array(
            F.when(F.col("confidence") < MIN_CONFIDENCE, "low_confidence"), F.when(F.col("goal_alignment").isin("possibly_aligned", "misaligned"), "alignment"), F.when(F.col("status").isin("stalled", "looping", "off_scope"), "status"),
            F.when(F.col("has_critical"), "critical_signal"), F.when(conflict, "conflict"), F.when(F.col("stagnation_seconds") > stagnation_seconds, "stagnation"), F.when(F.col("requested"), "requested"),
        )
    )


def needs_escalation(assessments: DataFrame, signals: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Assessments with ``reasons`` and ``escalate``."""
    s = signals.groupBy("session_id").agg(
        F.bool_or(F.col("severity") == "critical").alias("has_critical"), F.bool_or(F.col("kind").isin("repeated_command", "recurring_error", "stagnation")).alias("has_warning_loop"),
        F.max(F.when(F.col("kind") == "stagnation", F.get_json_object("payload", "$.seconds").try_cast("long"))).alias("stagnation_seconds"),
    )
    asked = requests.select("session_id", F.lit(True).alias("requested")).distinct() if requests is not None else assessments.select("session_id", F.lit(False).alias("requested")).distinct()
    out = assessments.join(s, "session_id", "left").join(asked, "session_id", "left").fillna(False, ["has_critical", "has_warning_loop", "requested"])
    return out.withColumn("reasons", escalation_reasons()).withColumn("escalate", F.size("reasons") > 0)


def select_attempt(attempts: DataFrame, key: str = "packet_id") -> DataFrame:
    """The first valid of at most two attempts (key, assessor, attempt, valid, call_status); no row where both fail.

    The routine assessor is tried twice, the strong one again only after an invalid
    answer, not after a timeout.
    """
    timed_out = F.lag("call_status").over(Window.partitionBy(key, "assessor").orderBy("attempt")) == "timeout"
    allowed = (F.col("attempt") == 1) | ((F.col("attempt") == 2) & ~((F.col("assessor") == "strong") & F.coalesce(timed_out, F.lit(False))))
    fine = attempts.withColumn("__ok", allowed & F.col("valid") & (F.col("call_status") == "ok")).where("__ok").drop("__ok")
    return fine.withColumn("__n", F.row_number().over(Window.partitionBy(key, "assessor").orderBy("attempt"))).where("__n = 1").drop("__n")


def reconcile(rules: DataFrame, routine: DataFrame | None, strong: DataFrame | None, signals: DataFrame, sessions: DataFrame) -> DataFrame:
    """The authoritative assessment of each session.

    A valid strong answer goes before a routine one, and that before the rules'.  A
    critical signal forces attention.  An end is taken from the lifecycle alone: an
    answer that claims one without evidence becomes between_turns, and evidence of
    one overrides any answer.
    """
    names = ("status", "goal_alignment", "needs_attention", "confidence", "assessed_by")
    packed = lambda df, n: df.select("session_id", F.struct(*names).alias(n))
    out = packed(rules, "r0")
    for df, n in ((routine, "r1"), (strong, "r2")):
        out = out.join(packed(df, n), "session_id", "left") if df is not None else out.withColumn(n, F.lit(None).cast(out.schema["r0"].dataType))
    critical = signals.where("severity = 'critical'").select("session_id", F.lit(True).alias("critical")).distinct()
    out = out.join(critical, "session_id", "left").join(sessions.select("session_id", "state"), "session_id", "left").withColumn("a", F.coalesce("r2", "r1", "r0"))
    ended = F.col("state").isin("terminal_completed", "terminal_failed")
    status = F.when(ended, F.col("state")).when(F.col("a.status").isin("terminal_completed", "terminal_failed"), "between_turns").otherwise(F.col("a.status"))
    return out.select("session_id", status.alias("status"), "a.goal_alignment", (F.coalesce("critical", F.lit(False)) | F.coalesce("a.needs_attention", F.lit(False))).alias("needs_attention"), "a.confidence", "a.assessed_by")


def assessment_triggers(ev: DataFrame, markers: DataFrame, last: DataFrame, cadence_seconds: int = 600, asof=None) -> DataFrame:
    """(session_id, reason): sessions due for a routine assessment, one row each.

    Ten minutes since the last one (``last``: session_id, assessed_at), a marker or
    a lifecycle change since, or never assessed.
    """
    seen = ev.groupBy("session_id").agg(F.max("event_ts").alias("last_ts"), F.max(F.when(F.col("kind").isin("turn_lifecycle", "process_lifecycle"), F.col("event_ts"))).alias("last_change"))
    out = seen.join(markers.groupBy("session_id").agg(F.max("event_ts").alias("last_marker")), "session_id", "left").join(last.select("session_id", "assessed_at"), "session_id", "left")
    now = F.lit(asof).cast("timestamp") if asof is not None else F.col("last_ts")
    reason = F.when(F.col("assessed_at").isNull(), "first").when(F.col("last_change") > F.col("assessed_at"), "lifecycle").when(F.col("last_marker") > F.col("assessed_at"), "marker").when(X.elapsed(F.col("assessed_at"), now) >= cadence_seconds, "cadence")
    return out.select("session_id", reason.alias("reason")).where("reason is not null")


def compare_assessors(assessments: DataFrame, key: str = "packet_id") -> DataFrame:
    """Status and confidence of the two assessors side by side."""
    return assessments.groupBy(key).pivot("assessed_by", ["routine", "strong"]).agg(F.first("status").alias("status"), F.first("confidence").alias("confidence"))
