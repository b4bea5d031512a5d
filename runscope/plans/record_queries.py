"""Registered queries of packets, checks, stores and exports, as flat rows with their SQL twins.

Imported by ``runscope.plans.queries``, whose helpers and fragments of SQL they use.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runscope.functions import literals
from runscope.functions import redaction as R
from runscope.functions import text as X
from runscope.operators import assess as A
from runscope.operators import evaluate as V
from runscope.operators import events as E
from runscope.operators import metrics as M
from runscope.operators import rules as G
from runscope.operators import status as S
from runscope.operators import validate as D
from runscope.plans.queries import ALL, CHANGES, DEMO, EV, ROUTINE, TOLD, bounds, demo_assessments, demo_told, events, query, raw_lines, routine, signals, stored_events, us
from runscope.schemas import SIGNAL
from runscope.session import materialize, read_table, scratch_path
from runscope.sources import event_store, sinks


def number() -> Column:
    """The number in an event's payload."""
    return F.regexp_extract("summary", "([0-9]+)", 1).cast("int")


LATER = "2024-03-01 00:00:00"


@query(f"WITH {EV} SELECT event_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY event_ts, source_offset) AS position FROM ev")
def replay_positions(spark, d):
    """Where an event stands among its session's rows as they leave the partition in replay order."""
    placed = E.chronological(events(spark, d)).select("event_id", "session_id", F.monotonically_increasing_id().alias("at"))
    return placed.select("event_id", "session_id", F.row_number().over(Window.partitionBy("session_id").orderBy("at")).cast("long").alias("position"))


LIFE = """
life AS (SELECT event_id, session_id, event_ts, source_offset, 'turn_lifecycle' AS kind, CASE k % 4 WHEN 0 THEN 'turn_started' WHEN 1 THEN 'turn_complete' WHEN 2 THEN 'turn_failed' ELSE 'input_requested' END AS phase, NULL::INTEGER AS exit_code FROM ev WHERE kind = 'turn_lifecycle'
  UNION ALL SELECT 'x' || event_id, session_id, event_ts, source_offset, 'process_lifecycle', 'process_exit', k % 3 FROM ev WHERE kind = 'test_result' AND k % 9 = 0)"""
LIFE_STATES = f"""
facts AS (SELECT session_id, arg_max(phase, source_offset) FILTER (kind = 'turn_lifecycle') AS last_phase, max(event_ts) FILTER (phase = 'turn_started') AS last_start, arg_max(exit_code, source_offset) FILTER (kind = 'process_lifecycle') AS exit_code, max(event_ts) FILTER (kind = 'process_lifecycle') AS exit_ts FROM life GROUP BY ALL),
over_ AS (SELECT *, exit_ts IS NOT NULL AND NOT coalesce(last_start > exit_ts, false) AS ended FROM facts),
life_states AS (SELECT session_id, last_phase, CASE WHEN ended AND exit_code <> 0 THEN 'terminal_failed' WHEN ended AND exit_code = 0 AND epoch_us(TIMESTAMP '{LATER}') - epoch_us(exit_ts) >= 300000000 THEN 'terminal_completed' WHEN last_phase = 'input_requested' THEN 'waiting' WHEN last_phase = 'turn_started' THEN 'active_turn' WHEN last_phase IN ('turn_complete', 'turn_failed') THEN 'between_turns' ELSE 'unknown' END AS state FROM over_)"""


def with_processes(spark, d) -> DataFrame:
    """Turns of four phases from the log, process ends from another source that knows fewer columns."""
    ev = events(spark, d)
    phase = F.when(number() % 4 == 0, "turn_started").when(number() % 4 == 1, "turn_complete").when(number() % 4 == 2, "turn_failed").otherwise("input_requested")
    turns = ev.where("kind = 'turn_lifecycle'").withColumn("phase", phase)
    exits = ev.where("kind = 'test_result'").where(number() % 9 == 0).select(
        F.concat(F.lit("x"), "event_id").alias("event_id"), "session_id", "event_ts", "source_path", "source_offset", F.lit("process_lifecycle").alias("kind"), F.lit("process_exit").alias("phase"), (number() % 3).alias("exit_code")
    )
    return E.all_events(turns, exits)


@query(f"WITH {EV},{LIFE} SELECT event_id, kind, phase, CAST(exit_code AS BIGINT) AS exit_code FROM life")
def event_sources(spark, d):
    return with_processes(spark, d).select("event_id", "kind", "phase", F.col("exit_code").cast("long").alias("exit_code"))


@query(f"WITH {EV},{LIFE},{LIFE_STATES} SELECT session_id, state FROM life_states")
def process_states(spark, d):
    return G.lifecycle(with_processes(spark, d), LATER).select("session_id", "state")


@query(f"WITH {EV},{LIFE},{LIFE_STATES} SELECT session_id, 'waiting' AS kind, 'session' AS subject, 'warning' AS severity, 'waiting: input_requested' AS summary FROM life_states WHERE state = 'waiting' UNION ALL SELECT session_id, 'turn_failed', event_id, 'warning', 'a turn failed' FROM life WHERE phase = 'turn_failed' UNION ALL SELECT session_id, 'process_failed', event_id, 'critical', 'process ended with ' || exit_code FROM life WHERE kind = 'process_lifecycle' AND exit_code <> 0")
def lifecycle_signals(spark, d):
    ev = with_processes(spark, d)
    return G.lifecycle_signals(ev, G.lifecycle(ev, LATER)).select("session_id", "kind", "subject", "severity", "summary")


OUTSIDE = "outside AS (SELECT session_id, CASE k % 3 WHEN 0 THEN 'v1' WHEN 1 THEN 'v2' END AS version, k * 1000 AS tokens, event_ts FROM ev WHERE kind = 'error')"


@query(f"WITH {EV},{OUTSIDE} SELECT session_id, 'dependency_unavailable' AS kind, coalesce(version, '') AS subject, 'info' AS severity, 'system' AS source, epoch_us(max(event_ts)) AS at_us FROM outside WHERE version IS NULL OR version <> 'v1' GROUP BY session_id, version UNION ALL SELECT session_id, 'context_growth', 'context', 'critical', 'supplemental', epoch_us(event_ts) FROM outside WHERE version = 'v1' AND tokens >= 50000")
def supplemental_signals(spark, d):
    """Rows of another version say that the source is not usable; large contexts are findings."""
    version = F.when(number() % 3 == 0, "v1").when(number() % 3 == 1, "v2")
    rows = events(spark, d).where("kind = 'error'").select(F.col("session_id").alias("canonical_session_id"), version.alias("schema_version"), (number() * 1000).cast("long").alias("context_tokens"), F.col("event_ts").alias("observed_at"))
    fine, unusable = G.read_supplemental(rows, ("v1",))
    found = G.context_growth_signals(fine.withColumnRenamed("canonical_session_id", "session_id"), 50_000)
    return unusable.unionByName(found).select("session_id", "kind", "subject", "severity", "source", us("observed_at").alias("at_us"))


@query(f"WITH {ALL} SELECT session_id, kind, sha256(session_id || chr(31) || kind || chr(31) || subject) AS id FROM signals")
def signal_ids(spark, d):
    return signals(stored_events(spark, d)).select("session_id", "kind", "id")


@query(f"WITH {EV} SELECT source, arg_max(ok, source_offset) AS available, epoch_us(max(t)) AS last_us FROM (SELECT 'source' || k % 5 AS source, kind <> 'error' AS ok, source_offset, make_timestamp(source_offset) AS t FROM ev) GROUP BY ALL")
def availability(spark, d):
    rows = events(spark, d).select(F.concat(F.lit("source"), number() % 5).alias("source"), (F.col("kind") != "error").alias("available"), F.timestamp_micros("source_offset").alias("ts"))
    return M.availability(rows).select("source", "available", us("last_at").alias("last_us"))


@query(f"WITH {EV}, l AS (SELECT 'log' || k % 7 AS p, max(k) AS late, max(source_offset) + 100 AS size FROM ev GROUP BY ALL), c AS (SELECT 'log' || k % 7 AS p, max(source_offset) AS o FROM ev WHERE k % 2 = 0 AND k % 7 <> 3 GROUP BY ALL) SELECT l.p AS source_path, CAST(late AS BIGINT) AS lag_seconds, size - coalesce(o, 0) AS unread_bytes FROM l LEFT JOIN c USING (p)")
def parser_lag(spark, d):
    """Rows read as many seconds late as their number says; a cursor for all logs but one."""
    ev = events(spark, d).withColumns({"source_path": F.concat(F.lit("log"), number() % 7), "ingest_ts": F.timestamp_seconds(F.unix_seconds("event_ts") + number())}).withColumn("event_ts", F.timestamp_seconds(F.unix_seconds("event_ts")))
    files = ev.groupBy(F.col("source_path").alias("path")).agg((F.max("source_offset") + 100).alias("size"))
    cursors = ev.where((number() % 2 == 0) & (number() % 7 != 3)).groupBy("source_path").agg(F.max("source_offset").alias("source_offset"))
    return M.lag(ev, files, cursors).select("source_path", "lag_seconds", "unread_bytes")


@query(f"WITH {EV},{DEMO},{CHANGES},{TOLD} SELECT count(*) AS n FROM told WHERE event_cursor % 3 = 0")
def deduplicated_notices(spark, d):
    told = demo_told(spark, d)
    return M.deduplicated(told, told.where("event_cursor % 3 = 0").unionByName(told.where("event_cursor % 3 = 0")))


@query(f"WITH {EV},{DEMO},{ROUTINE} SELECT session_id AS packet_id, status AS routine_status, CAST(confidence AS DOUBLE) AS routine_confidence, CASE WHEN c % 5 = 0 THEN 'investigating' END AS strong_status, CASE WHEN c % 5 = 0 THEN 0.9::DOUBLE END AS strong_confidence FROM routine")
def compared_assessors(spark, d):
    first = routine(events(spark, d)).withColumnRenamed("session_id", "packet_id")
    strong = first.where("event_cursor % 5 = 0").withColumns({"status": F.lit("investigating"), "confidence": F.lit(0.9), "assessed_by": F.lit("strong")})
    return A.compare_assessors(first.unionByName(strong))


@query(f"WITH {EV} SELECT DISTINCT session_id, CASE WHEN length(session_id) % 2 = 0 THEN 'trace-' || session_id END AS trace_id FROM ev")
def drilldown(spark, d):
    s = events(spark, d).select("session_id").distinct()
    return S.drilldown(s, s.where(F.length("session_id") % 2 == 0).withColumn("trace_id", F.concat(F.lit("trace-"), "session_id"))).select("session_id", "trace_id")


@query(f"WITH {EV},{DEMO} SELECT 's1' AS session_id, count(*) AS n_events, (SELECT arg_max(status, event_cursor) FROM demo WHERE session_id = 's1') AS status FROM ev WHERE session_id = 's1'")
def session_detail(spark, d):
    ev = events(spark, d)
    a = demo_assessments(ev).drop("needs_attention", "fingerprint").withColumn("assessed_at", F.struct("assessed_at", "event_cursor"))
    return S.session_detail(ev.select("session_id").distinct(), E.session_summary(ev).select("session_id", "n_events"), a, "s1").select("session_id", "n_events", "status")


@query(f"WITH {EV} SELECT event_id FROM ev WHERE source_offset % 4 = 1")
def unstored_events(spark, d):
    """A full scan, read twice, against a store that lacks a quarter."""
    ev = events(spark, d)
    return E.reconcile_ingest(ev.select("event_id").unionByName(ev.select("event_id")), ev.where("source_offset % 4 <> 1"))


@query(f"WITH {EV} SELECT event_id, CAST(batch AS BIGINT) AS batch_id, strftime(event_ts, '%Y-%m-%d') AS day FROM (SELECT *, CASE WHEN source_offset % 2 = 0 THEN 0 ELSE 1 END AS batch FROM ev)")
def stored_once(spark, d):
    """Three batches into a store: half of the events, all of them with some twice, and the second again as a retry."""
    ev, path = events(spark, d), scratch_path(spark, "event_store")
    for batch, rows in ((0, ev.where("source_offset % 2 = 0")), (1, ev.unionByName(ev.where("source_offset % 5 = 0"))), (1, ev.unionByName(ev.where("source_offset % 5 = 0")))):
        sinks.store_events(rows, batch, path)
    out = event_store.read_events(spark, path, spark.read.parquet(f"{path}/events").schema)
    return out.select("event_id", F.col("batch_id").cast("long").alias("batch_id"), F.col("day").cast("string").alias("day"))


@query(f"WITH {EV} SELECT event_id, CAST(CASE WHEN source_offset % 5 >= 3 THEN 4 ELSE -9 END AS BIGINT) AS batch_id, strftime(event_ts, '%Y-%m-%d') AS day FROM ev")
def merged_store(spark, d):
    """Overlapping batches into a store, the first two merged between two of them; the merged ones then come again.

    A day has both or one of the first two (its events are in both), and keeps one merged batch.
    """
    ev, path = events(spark, d), scratch_path(spark, "event_store")
    early = lambda n: ev.where(f"source_offset % 5 < {n + 2}")
    for batch in (0, 1):
        event_store.add(early(batch), batch, path)
    event_store.merge(spark, path, 2, at=1)
    for batch, rows in ((1, early(1)), (4, ev.where("source_offset % 5 > 0")), (4, ev.where("source_offset % 5 > 0"))):
        event_store.add(rows, batch, path)
    out = event_store.read_events(spark, path, spark.read.parquet(f"{path}/events").schema)
    return out.select("event_id", F.col("batch_id").cast("long").alias("batch_id"), F.col("day").cast("string").alias("day"))


@query(f"WITH {ALL} SELECT strftime(observed_at, '%Y-%m-%d') AS day, kind, count(*) AS n FROM signals GROUP BY ALL")
def written_signals(spark, d):
    """A table written twice by one writer holds its rows once."""
    sig = materialize(signals(stored_events(spark, d)), "signals").withColumn("day", F.to_date("observed_at"))
    path = scratch_path(spark, "signal_table")
    for _ in range(2):
        sinks.write_table(sig, path, "first")
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day"), "kind").agg(F.count("*").alias("n"))


@query("SELECT event_id AS source_offset, strlen(line) AS payload_bytes, sha256(line) AS payload_sha256, false AS holds_body FROM (SELECT event_id, '{\"type\":\"' || event_type || '\",\"timestamp\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '\",\"payload\":{\"text\":\"' || replace(props, '\"', chr(39)) || '\",\"session_id\":\"s' || user_id || '\"}}' AS line FROM events WHERE event_id % 10 <> 0)")
def payload_marks(spark, d):
    """Of a record's body an event keeps hash and length, and no column holds it."""
    ev = E.normalize(raw_lines(spark, d))
    body = F.contains(F.to_json(F.struct(*[c for c in ev.columns if c != "summary"])), F.lit("payload\\\":{"))
    return ev.select("source_offset", "payload_bytes", "payload_sha256", body.alias("holds_body"))


@query("SELECT conv_id, turn, len(list_distinct(string_split(coalesce(text, ''), ' '))) = len(string_split(coalesce(text, ''), ' ')) AS all_differ FROM conversations")
def unique_words(spark, d):
    return read_table(spark, d, "conversations").select("conv_id", "turn", X.is_unique(F.split(F.coalesce("text", F.lit("")), " ")).alias("all_differ"))


def demo_packets(spark, d) -> DataFrame:
    ev = stored_events(spark, d, whole=True)
    first = ev.groupBy("session_id").agg(F.min("event_ts").alias("started_at")).withColumns({"workspace": F.lit("/home/w/proj"), "model": F.lit(None).cast("string")})
    states = G.lifecycle(ev).select("session_id", "state").join(first, "session_id")
    previous = S.latest(demo_assessments(ev), order="event_cursor").select("session_id", F.struct("status", "assessed_at").alias("previous"))
    return A.build_packets(ev, signals(ev), states, bounds(ev), previous, size=10)


PACKETS = f"""
c AS (SELECT session_id, count(*) AS n, max(source_offset) AS last_offset, epoch_us(min(event_ts)) AS opened_us, epoch_us(max(event_ts)) AS closed_us FROM ev GROUP BY ALL),
g AS (SELECT session_id, count(*) AS n_signals FROM signals GROUP BY ALL),
kept AS (SELECT session_id, string_agg(event_id, ',' ORDER BY event_ts, source_offset) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_ts DESC, source_offset DESC) AS r FROM ev) WHERE r <= 10 GROUP BY ALL),
{DEMO},
newest AS (SELECT session_id, arg_max(status, event_cursor) AS previous FROM demo GROUP BY ALL),
packets AS (SELECT session_id, n, last_offset, opened_us, closed_us, ids, coalesce(n_signals, 0) + CASE WHEN n > 10 THEN 1 ELSE 0 END AS n_signals, greatest(n - 10, 0) AS n_folded, previous, sha256(session_id || chr(31) || last_offset) AS packet_id FROM c JOIN kept USING (session_id) LEFT JOIN g USING (session_id) LEFT JOIN newest USING (session_id))"""


@query(f"WITH {ALL},{PACKETS} SELECT packet_id, session_id, '1.0' AS schema_version, ids AS event_ids, n_signals, 'events/' || substr(session_id, 2) || ':' || last_offset || ':0' AS to_cursor, opened_us, closed_us, (closed_us - opened_us) // 1000000 AS elapsed_seconds, previous, 'src,docs' AS expected FROM packets")
def packet_rows(spark, d):
    """Packets as flat rows: the newest events in order, signals with the folded rest, window, cursor, goal and previous status."""
    p = demo_packets(spark, d)
    return p.select(
        "packet_id", "session_id", "schema_version", F.array_join(F.transform("events", lambda e: e["id"]), ",").alias("event_ids"), F.size("signals").cast("long").alias("n_signals"), "window.to_cursor",
        us("window.opened_at").alias("opened_us"), us("window.closed_at").alias("closed_us"), "session.elapsed_seconds", F.col("previous_assessment.status").alias("previous"), F.array_join("goal.expected_paths", ",").alias("expected"),
    )


@query(f"WITH {ALL},{PACKETS} SELECT session_id, concat_ws(',', CASE WHEN last_offset % 3 = 0 THEN 'schema_version' END, CASE WHEN last_offset % 5 = 0 THEN 'window.order' END, CASE WHEN last_offset % 7 = 0 THEN 'events' END) AS observation, concat_ws(',', CASE WHEN last_offset % 5 = 0 THEN 'window.order' END, CASE WHEN last_offset % 5 = 0 THEN 'events.window' END) AS semantic FROM packets WHERE last_offset % 3 = 0 OR last_offset % 5 = 0 OR last_offset % 7 = 0")
def packet_checks(spark, d):
    """Packets with faults put in by their last offset, and what the checks say of each field and across fields."""
    p = demo_packets(spark, d).withColumn("o", X.parse_cursor(F.col("window.to_cursor"))["offset"])
    p = p.withColumn("schema_version", F.when(F.col("o") % 3 == 0, "2").otherwise(F.col("schema_version")))
    p = p.withColumn("window", F.when(F.col("o") % 5 == 0, F.col("window").withField("opened_at", F.expr("window.closed_at + INTERVAL 1 DAY"))).otherwise(F.col("window")))
    p = p.withColumn("events", F.when(F.col("o") % 7 == 0, F.transform("events", lambda e: e.withField("kind", F.lit("odd")))).otherwise(F.col("events")))
    seen = D.validate_observations(p).withColumnRenamed("violations", "observation")
    # folded and older signals cite events that a packet of ten does not hold: references are checked elsewhere
    both = D.validate_semantics(seen.withColumn("signals", F.transform("signals", lambda s: s.withField("event_ids", F.array().cast("array<string>")))))
    return both.where("o % 3 = 0 or o % 5 = 0 or o % 7 = 0").select("session_id", F.array_join("observation", ",").alias("observation"), F.array_join("violations", ",").alias("semantic"))


@query(f"WITH {ALL},{PACKETS}, m AS (SELECT unnest(['local', 'trusted_remote', 'metadata_only']) AS mode) SELECT mode, session_id, CASE WHEN mode = 'local' THEN '/home/w/proj' ELSE 'proj' END AS workspace, CASE WHEN mode = 'metadata_only' THEN 0 ELSE least(n, 10) END AS n_texts, CASE WHEN mode = 'metadata_only' THEN 0 ELSE n_signals END AS n_signal_texts, CASE WHEN mode = 'metadata_only' THEN '' ELSE 'demo' END AS goal, CASE WHEN mode = 'local' THEN 'events/' || substr(session_id, 2) ELSE substr(session_id, 2) END || ':' || last_offset || ':0' AS to_cursor FROM packets, m")
def trust_modes(spark, d):
    """What is left of a packet in each mode."""
    p = demo_packets(spark, d)
    texts = lambda c: F.size(F.filter(F.transform(c, lambda e: e["summary"]), lambda t: t != "")).cast("long")
    out = None
    for mode in ("local", "trusted_remote", "metadata_only"):
        one = A.apply_trust_mode(p, mode).select(F.lit(mode).alias("mode"), "session_id", "session.workspace", texts("events").alias("n_texts"), texts("signals").alias("n_signal_texts"), F.col("goal.text").alias("goal"), "window.to_cursor")
        out = one if out is None else out.unionByName(one)
    return out


def demo_answers(spark, d) -> DataFrame:
    """Test results as assessor answers, some of them beyond the contract."""
    return events(spark, d).where("kind = 'test_result'").select(
        "event_id", F.col("event_id").alias("packet_id"), F.when(number() % 11 == 0, "2.0").otherwise("1.0").alias("schema_version"), F.when(number() % 7 == 0, "odd").otherwise("progressing").alias("status"),
        F.when(number() % 5 == 0, "").otherwise("running tests").alias("current_action"), F.lit("aligned").alias("goal_alignment"),
        F.when(number() % 13 == 0, F.array().cast("array<struct<ref_type:string,ref_id:string,claim:string>>")).otherwise(F.array(F.struct(F.lit("event").alias("ref_type"), F.col("event_id").alias("ref_id"), F.lit("a claim").alias("claim")))).alias("evidence"),
        F.when(number() % 3 == 0, F.array("event_id", "event_id")).otherwise(F.array("event_id")).alias("basis_ids"), F.array().cast("array<struct<severity:string,kind:string,explanation:string,evidence_refs:array<string>>>").alias("concerns"),
        F.lit(False).alias("needs_attention"), F.lit(None).cast("string").alias("recommended_human_action"), ((number() % 20) / 16.0).alias("confidence"), F.lit("routine").alias("assessed_by"), F.lit(None).cast("string").alias("escalation_reason"), F.col("event_ts").alias("assessed_at"),
    )


@query(f"WITH {EV}, v AS (SELECT event_id, concat_ws(',', CASE WHEN k % 11 = 0 THEN 'schema_version' END, CASE WHEN k % 7 = 0 THEN 'status' END, CASE WHEN k % 5 = 0 THEN 'current_action' END, CASE WHEN k % 13 = 0 THEN 'evidence.count' END, CASE WHEN k % 3 = 0 THEN 'basis_ids' END, CASE WHEN k % 20 > 16 THEN 'confidence' END) AS violations FROM ev WHERE kind = 'test_result') SELECT event_id, violations FROM v WHERE violations <> ''")
def answer_checks(spark, d):
    return D.validate_assessments(demo_answers(spark, d)).where(F.size("violations") > 0).select("event_id", F.array_join("violations", ",").alias("violations"))


CITED = "cited AS (SELECT event_id, k % 4 <> 1 AS fine FROM ev WHERE kind = 'test_result')"


def demo_citations(spark, d) -> DataFrame:
    """(n, n_valid, rate): answers against packets of one event each; of a quarter the packet holds another event."""
    a = demo_answers(spark, d)
    held = events(spark, d).where("kind = 'test_result'").select(F.col("event_id").alias("packet_id"), F.array(F.struct(F.when(number() % 4 == 1, "another").otherwise(F.col("event_id")).alias("id"))).alias("events"))
    return D.citation_validity(a, held.withColumn("signals", F.array().cast("array<struct<id:string>>")))


@query(f"WITH {EV},{CITED} SELECT count(*) AS n, count(*) FILTER (fine) AS n_valid, count(*) FILTER (fine) / count(*) AS rate FROM cited")
def citations(spark, d):
    return demo_citations(spark, d)


@query(f"WITH {EV},{CITED}, {DEMO},{ROUTINE}, r AS (SELECT count(*) FILTER (NOT fine) AS bad FROM cited), t AS (SELECT avg(CASE WHEN status = 'investigating' THEN 1.0 ELSE 0.0 END) AS first, avg(CASE WHEN c % 5 = 0 OR status = 'investigating' THEN 1.0 ELSE 0.0 END) AS second FROM routine) SELECT 'unsupported_citations' AS gate, CAST(bad AS DOUBLE) AS value, 0.0::DOUBLE AS threshold, bad <= 0 AS pass FROM r UNION ALL SELECT 'strong_gain', round(second - first, 9), 0.1, second - first >= 0.1 FROM t")
def measured_gates(spark, d):
    """The gates of citations and of the strong assessor's gain, both from what was measured: labels say that every session is investigating."""
    first = routine(events(spark, d))
    right = lambda df: F.avg((df["status"] == "investigating").cast("double"))
    second = first.withColumn("status", F.when(F.col("event_cursor") % 5 == 0, "investigating").otherwise(F.col("status")))
    gain = first.agg(right(first).alias("first")).crossJoin(second.agg(right(second).alias("second")))  # one row each
    cited = demo_citations(spark, d).select((F.col("n") - F.col("n_valid")).alias("unsupported_citations"))
    row = cited.crossJoin(gain).select("unsupported_citations", F.lit(None).cast("double").alias("anomaly_recall"), F.lit(None).cast("double").alias("false_attention_rate"), F.round(F.col("second") - F.col("first"), 9).alias("strong_gain"))
    return V.release_gates(row).where("gate in ('unsupported_citations', 'strong_gain')")


@query("SELECT 'doc' || doc_id AS path, sha256(text || '!') AS sha256 FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT 'gone' || doc_id, sha256(text) FROM documents WHERE doc_id % 50 = 1")
def changed_manifest(spark, d):
    """A frozen manifest with entries that have changed and entries that are gone."""
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    path = F.concat(F.lit("doc"), "doc_id").alias("path")
    frozen = V.manifest(docs.select(path, F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("content")))
    gone = V.manifest(docs.where("doc_id % 50 = 1").select(F.concat(F.lit("gone"), "doc_id").alias("path"), F.col("text").cast("binary").alias("content")))
    return V.check_manifest(frozen.unionByName(gone), docs.select(path, F.col("text").cast("binary").alias("content")))


@query(f"WITH {EV} SELECT event_id, substr(sha256('salt' || split_part(path, '/', 1)), 1, 12) || '/' || substr(sha256('salt' || split_part(path, '/', 2)), 1, 12) AS path, substr(sha256('saltevents'), 1, 12) || '/' || substr(sha256('salt' || substr(session_id, 2)), 1, 12) AS source_path FROM ev WHERE length(session_id) % 2 = 1")
def exported_corpus(spark, d):
    ev = events(spark, d)
    s = ev.select("session_id").distinct()
    provenance = s.select("session_id", F.lit("owner").alias("authority"), F.when(F.length("session_id") % 2 == 1, "upload").alias("source"), F.lit(True).alias("consent"))
    return V.export_corpus(ev, provenance, "salt").select("event_id", "path", "source_path")


@query(f"WITH {EV}, t AS (SELECT event_id AS packet_id, k % 3 AS o FROM ev WHERE kind = 'command_result') SELECT packet_id, 'routine' AS assessor, CAST(CASE WHEN o = 0 THEN 1 ELSE 2 END AS BIGINT) AS attempt FROM t UNION ALL SELECT packet_id, 'strong', CAST(CASE WHEN o = 0 THEN 1 ELSE 2 END AS BIGINT) FROM t WHERE o <> 2")
def attempts_after_timeouts(spark, d):
    """A first try that is right, wrong or late; the strong assessor is not asked again after a timeout."""
    t = events(spark, d).where("kind = 'command_result'").select(F.col("event_id").alias("packet_id"), (number() % 3).alias("o"), F.explode(F.array(F.lit("routine"), F.lit("strong"))).alias("assessor"))
    first = t.select("packet_id", "assessor", F.lit(1).alias("attempt"), (F.col("o") == 0).alias("valid"), F.when(F.col("o") == 2, "timeout").otherwise("ok").alias("call_status"))
    second = t.select("packet_id", "assessor", F.lit(2).alias("attempt"), F.lit(True).alias("valid"), F.lit("ok").alias("call_status"))
    return A.select_attempt(first.unionByName(second)).select("packet_id", "assessor", F.col("attempt").cast("long").alias("attempt"))


@query(f"WITH {ALL}, l AS (SELECT s.session_id, s.state, coalesce(bool_or(severity = 'critical'), false) AS needs_attention, s.last_ts FROM states s LEFT JOIN signals USING (session_id) GROUP BY s.session_id, s.state, s.last_ts) SELECT session_id, state, needs_attention, epoch_us(last_ts) AS last_us FROM l ORDER BY needs_attention DESC, last_ts DESC NULLS LAST, session_id LIMIT 20 OFFSET 20")
def session_page(spark, d):
    """The second page of twenty sessions, behind the key that the first one ends with."""
    ev = stored_events(spark, d)
    listed = materialize(S.list_sessions(G.lifecycle(ev), G.attention(signals(ev))), "listed_sessions")
    first = S.session_page(listed, 20).collect()
    after = tuple(first[-1][c] for c in ("needs_attention", "last_ts", "session_id")) if first else None
    return S.session_page(listed, 20, after).select("session_id", "state", "needs_attention", us("last_ts").alias("last_us"))


def marked_assessor(packet: dict) -> dict:
    """A deterministic plug-in: late, failing or wrong on marked sessions."""
    n = int(packet["session"]["id"][1:])
    if n % 50 == 0:
        time.sleep(600)
    if n % 7 == 1:
        raise ValueError("no answer")
    return {"status": "progressing", "goal_alignment": "aligned", "needs_attention": False, "confidence": 2.0 if n % 7 == 2 else 0.9, "assessed_by": "routine"}


@query(f"WITH {EV}, s AS (SELECT DISTINCT session_id, CAST(substr(session_id, 2) AS INTEGER) AS n FROM ev), o AS (SELECT session_id, assessor, CASE WHEN n % 50 = 0 THEN 'timeout' WHEN n % 7 = 1 THEN 'error' ELSE 'ok' END AS call_status, n % 50 <> 0 AND n % 7 NOT IN (1, 2) AS valid FROM s, (VALUES ('routine'), ('strong')) v(assessor)) SELECT session_id, assessor, CAST(attempt AS BIGINT) AS attempt, call_status, valid, valid AS chosen, CASE WHEN valid THEN CAST(0.9 AS DOUBLE) END AS confidence FROM o, (VALUES (1), (2)) t(attempt) WHERE attempt = 1 OR (NOT valid AND NOT (assessor = 'strong' AND call_status = 'timeout'))")
def failing_assessors(spark, d):
    """Attempts of two assessors that are late, fail or are wrong on some packets, and which of them is chosen."""
    ev = events(spark, d)
    first = ev.groupBy("session_id").agg(F.min("event_ts").alias("started_at")).withColumns({"workspace": F.lit("/w"), "model": F.lit(None).cast("string"), "state": F.lit("unknown")})
    none = first.select("session_id", F.lit(None).cast("struct<status:string>").alias("previous"))
    packets = materialize(A.build_packets(ev, spark.createDataFrame([], SIGNAL), first, bounds(ev), none, size=3), "packets")
    tries = None
    for name in ("routine", "strong"):
        own = A.attempts(packets, marked_assessor, name, seconds=0.5, partitions=spark.sparkContext.defaultParallelism)
        tries = own if tries is None else tries.unionByName(own)
    tries = materialize(tries, "attempts")
    chosen = A.select_attempt(tries).select("packet_id", "assessor", "attempt", F.lit(True).alias("chosen"))
    out = tries.join(chosen, ["packet_id", "assessor", "attempt"], "left")
    return out.select("session_id", "assessor", F.col("attempt").cast("long").alias("attempt"), "call_status", "valid", F.coalesce("chosen", F.lit(False)).alias("chosen"), F.when(F.col("valid"), F.col("answer.confidence")).alias("confidence"))


@query("WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{8,}')) AS secret FROM benchmark) SELECT doc_id, secret FROM documents, w WHERE contains(text, secret)")
def seeded_literals(spark, d):
    """Every long word of the benchmark that a document holds anywhere, all words searched at once."""
    words = read_table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{8,}"), F.lit(0))).alias("secret")).distinct()
    return literals.holding(read_table(spark, d, "documents").select("doc_id", "text"), words, columns=["text"]).select("doc_id", "secret")


@query("WITH b AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM benchmark), p AS (SELECT string_agg(w, '|' ORDER BY length(w) DESC, w) AS names FROM b WHERE length(w) BETWEEN 5 AND 6), q AS (SELECT string_agg(w, '|' ORDER BY length(w) DESC, w) AS prefixes FROM b WHERE length(w) >= 8) SELECT doc_id, sha256(regexp_replace(regexp_replace(text, prefixes, '[REDACTED:path_prefix]', 'g'), '\\b(' || names || ')\\b', '[REDACTED:username]', 'g')) AS redacted_sha256 FROM documents, p, q")
def configured_literals(spark, d):
    """Long words of the benchmark stand for path prefixes, which may be parts of words; then short ones for user names, which may not."""
    words = read_table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    none = words.limit(0)
    docs = R.redact_configured(read_table(spark, d, "documents").select("doc_id", "text"), "text", words.where("length(w) >= 8"), none)
    docs = R.redact_configured(docs, "text", none, words.where("length(w) between 5 and 6"))
    return docs.select("doc_id", F.sha2("text", 256).alias("redacted_sha256"))


@query(f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_ts DESC, source_offset DESC) AS n FROM ev), k AS (SELECT session_id, string_agg(kind || '=' || c, ',' ORDER BY kind) AS kinds FROM (SELECT session_id, kind, count(*) AS c FROM ev GROUP BY ALL) GROUP BY ALL), l AS (SELECT session_id, string_agg(event_id, ',' ORDER BY n DESC) AS recent FROM r WHERE n <= 10 GROUP BY ALL), s AS (SELECT session_id, min(source_offset) AS from_offset, max(source_offset) AS to_offset, epoch_us(min(event_ts)) AS opened_us FROM ev GROUP BY ALL) SELECT session_id, from_offset, to_offset, opened_us, recent, kinds FROM s JOIN l USING (session_id) JOIN k USING (session_id)")
def merged_packet_states(spark, d):
    """States of three stretches of time, stored and merged one after the other: those of all events."""
    ev = events(spark, d)
    day, state = F.dayofmonth("event_ts"), None
    for low, high in ((0, 10), (10, 20), (20, 99)):
        new = A.packet_state(ev.where((day > low) & (day <= high)), 10)
        state = materialize(A.merge_states(state, new, 10) if state else new, "packet_states")
    kinds = F.array_join(F.transform(F.sort_array(F.map_entries("kinds")), lambda k: F.concat(k["key"], F.lit("="), k["value"].cast("string"))), ",")
    return state.select("session_id", "from_offset", "to_offset", us("opened_at").alias("opened_us"), F.array_join(F.transform("recent", lambda x: x["e"]["id"]), ",").alias("recent"), kinds.alias("kinds"))


@query("SELECT 'd' || doc_id AS session_id, CASE WHEN quality = 1 THEN 'progressing' ELSE 'stalled' END AS status, toxic = 1 AS needs_attention FROM labels")
def stored_labels(spark, d):
    """Human labels from JSON lines as a labelling tool leaves them."""
    path = scratch_path(spark, "labels.json")
    made = read_table(spark, d, "labels").select(F.concat(F.lit("d"), "doc_id").alias("session_id"), F.when(F.col("quality") == 1, "progressing").otherwise("stalled").alias("status"), (F.col("toxic") == 1).alias("needs_attention"))
    made.write.json(path)
    return V.read_labels(spark, path).select("session_id", "status", "needs_attention")


@query(f"WITH {EV} SELECT event_id AS packet_id, session_id, CASE WHEN k % 2 = 0 THEN 'progressing' ELSE 'stalled' END AS status, k / 100 AS confidence FROM ev WHERE kind = 'command_result'")
def replayed_answers(spark, d):
    """Stored answers of a model, half of them JSON lines, half Parquet."""
    made = events(spark, d).where("kind = 'command_result'").select(F.col("event_id").alias("packet_id"), "session_id", F.when(number() % 2 == 0, "progressing").otherwise("stalled").alias("status"), (number() / 100).alias("confidence"), "source_offset")
    lines, table = scratch_path(spark, "answers.json"), scratch_path(spark, "answers")
    made.where("source_offset % 2 = 0").drop("source_offset").write.json(lines)
    made.where("source_offset % 2 = 1").drop("source_offset").write.parquet(table)
    schema = "packet_id string, session_id string, status string, confidence double"
    return V.read_model_outputs(spark, lines, schema).unionByName(V.read_model_outputs(spark, table, schema))


@query(f"WITH {EV} SELECT c.session_id, 'c' || c.k AS call_id, c.event_id AS command_id, r.event_id AS result_id, CAST(r.exit_code AS BIGINT) AS exit_code, epoch_us(c.event_ts) AS started_us, epoch_us(r.event_ts) AS ended_us FROM ev c LEFT JOIN ev r ON r.kind = 'command_result' AND r.session_id = c.session_id AND r.k = c.k WHERE c.kind = 'test_result'")
def paired_by_call(spark, d):
    """Test runs stand for commands and clicks for results, their numbers for call ids; a call may have no result or several."""
    ev = events(spark, d).where("kind in ('test_result', 'command_result')").withColumn("call_id", F.concat(F.lit("c"), number()))
    ev = ev.withColumn("kind", F.when(F.col("kind") == "test_result", "command").otherwise(F.col("kind")))
    return E.pair_commands(ev).select("session_id", "call_id", "command_id", "result_id", F.col("exit_code").cast("long").alias("exit_code"), us("started").alias("started_us"), us("ended").alias("ended_us"))


@query(f"WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_ts DESC, source_offset DESC) AS r FROM ev), c AS (SELECT session_id, unnest(CASE k % 3 WHEN 0 THEN ['bearer'] WHEN 1 THEN ['cookie', 'api_key'] ELSE ['none'] END) AS class FROM n WHERE r <= 3) SELECT session_id, coalesce(string_agg(DISTINCT class, ',' ORDER BY class) FILTER (class <> 'none'), '') AS redactions FROM c GROUP BY ALL")
def packet_redactions(spark, d):
    """The classes redacted in a packet's events, each once, never a value."""
    classes = F.when(number() % 3 == 0, F.array(F.lit("bearer"))).when(number() % 3 == 1, F.array(F.lit("cookie"), F.lit("api_key")))
    ev = events(spark, d).withColumn("redactions", classes)
    first = ev.groupBy("session_id").agg(F.min("event_ts").alias("started_at")).withColumns({"workspace": F.lit("/w"), "model": F.lit(None).cast("string"), "state": F.lit("unknown")})
    none = first.select("session_id", F.lit(None).cast("struct<status:string>").alias("previous"))
    p = A.build_packets(ev, spark.createDataFrame([], SIGNAL), first, bounds(ev), none, size=3)
    return p.select("session_id", F.array_join("redactions", ",").alias("redactions"))


@query(f"WITH {ALL}, r AS (SELECT session_id, kind || '=' || subject AS c, row_number() OVER (PARTITION BY session_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, kind, subject) AS n FROM signals) SELECT session_id, string_agg(c, ',' ORDER BY n) AS concerns FROM r WHERE n <= 3 GROUP BY ALL")
def capped_concerns(spark, d):
    """The three most severe of each session's concerns, equals in a fixed order."""
    sig = signals(stored_events(spark, d)).select("session_id", F.struct("severity", "kind", F.col("subject").alias("explanation")).alias("c"))
    few = sig.groupBy("session_id").agg(F.collect_list("c").alias("all")).withColumn("top", A.cap_arrays(F.col("all"), 3))
    return few.select("session_id", F.array_join(F.transform("top", lambda c: F.concat(c["kind"], F.lit("="), c["explanation"])), ",").alias("concerns"))


#: JSON of a packet of the two newest events, put together from texts: every null is written, older events are a counter.
PACKET_TEXT = r"""
n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_ts DESC, source_offset DESC) AS r FROM ev),
spans AS (SELECT session_id, strftime(min(event_ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS opened, strftime(max(event_ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS closed, (epoch_us(max(event_ts)) - epoch_us(min(event_ts))) // 1000000 AS elapsed, max(source_offset) AS off FROM ev GROUP BY ALL),
es AS (SELECT session_id, string_agg('{"id":"' || event_id || '","timestamp":"' || strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%gZ') || '","kind":"' || kind || '","summary":"' || source_type || ' ' || replace(props, '"', '\"') || '","path":' || coalesce('"' || path || '"', 'null') || ',"exit_code":' || coalesce(CAST(exit_code AS VARCHAR), 'null') || ',"source_type":"' || source_type || '"}', ',' ORDER BY r DESC) AS events FROM n WHERE r <= 2 GROUP BY ALL),
older AS (SELECT session_id, sum(c)::BIGINT AS folded, '{' || string_agg('\"' || kind || '\":' || c, ',' ORDER BY kind) || '}' AS payload FROM (SELECT session_id, kind, count(*) AS c FROM n WHERE r > 2 GROUP BY ALL) GROUP BY ALL)"""


@query(f"""WITH {EV},{PACKET_TEXT} SELECT session_id, '{{"schema_version":"1.0","session":{{"id":"' || session_id || '","workspace":"/w","started_at":"' || opened || '","elapsed_seconds":' || elapsed || ',"state":"unknown","model":null}},"goal":{{"text":"demo","acceptance_criteria":[],"expected_paths":["src","docs"],"forbidden_paths":["secrets"]}},"window":{{"from_cursor":null,"to_cursor":"events/' || substr(session_id, 2) || ':' || off || ':0","opened_at":"' || opened || '","closed_at":"' || closed || '"}},"previous_assessment":null,"events":[' || events || '],"signals":[' || coalesce('{{"id":"' || sha256(session_id || chr(31) || 'other' || chr(31) || 'folded') || '","kind":"other","severity":"info","source":"system","event_ids":[],"observed_at":"' || closed || '","freshness":"current","summary":"' || folded || ' older events","payload":"' || payload || '"}}', '') || '],"redactions":[]}}' AS json FROM spans JOIN es USING (session_id) LEFT JOIN older USING (session_id)""")
def packet_text(spark, d):
    """Packets as JSON texts of the contract's form, character by character."""
    ev = events(spark, d)
    first = ev.groupBy("session_id").agg(F.min("event_ts").alias("started_at")).withColumns({"workspace": F.lit("/w"), "model": F.lit(None).cast("string"), "state": F.lit("unknown")})
    none = first.select("session_id", F.lit(None).cast("struct<status:string>").alias("previous"))
    p = A.build_packets(ev, spark.createDataFrame([], SIGNAL), first, bounds(ev), none, size=2)
    return A.packet_json(p).join(p.select("packet_id", "session_id"), "packet_id").select("session_id", "json")


@query(f"WITH {EV} SELECT event_id, CASE WHEN k % 5 = 4 THEN NULL WHEN k % 2 = 0 THEN epoch_us(event_ts) ELSE epoch_us(event_ts) // 100000 * 100000 END AS parsed_us FROM ev")
def offset_times(spark, d):
    """Times of day in several zones with fractions of six digits or one are read as what they stand for; without a zone they are none."""
    ev = events(spark, d).withColumn("k", number())
    minutes = F.element_at(F.array(*[F.lit(m) for m in (0, 120, -330, 0, 0)]), F.col("k") % 5 + 1)
    zone = F.element_at(F.array(*[F.lit(z) for z in ("Z", "+02:00", "-05:30", "z", "")]), F.col("k") % 5 + 1)
    micros = F.lpad((us("event_ts") % 1_000_000).cast("string"), 6, "0")
    text = F.concat(F.date_format(F.col("event_ts") + F.make_interval(mins=minutes), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.when(F.col("k") % 2 == 0, micros).otherwise(F.substring(micros, 1, 1)), zone)
    return ev.select("event_id", F.unix_micros(X.parse_time(text)).alias("parsed_us"))
