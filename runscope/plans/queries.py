"""Registered queries over the given tables, each with its twin in SQL where one exists.

``events`` is projected to normalised session events; times leave as microseconds
since the epoch.  Thresholds are in hours here, as the table's gaps are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runscope.functions import redaction as R
from runscope.functions import text as X
from runscope.operators import assess as A
from runscope.operators import evaluate as V
from runscope.operators import events as E
from runscope.operators import metrics as M
from runscope.operators import notify as N
from runscope.operators import rules as G
from runscope.operators import segments as GS
from runscope.operators import status as S
from runscope.operators import validate as D
from runscope.plans.layout import by_session, state_of
from runscope.session import materialize, read_table, scratch_path
from runscope.sources.projection import EXPECTED, FORBIDDEN, project_events
from runscope.streaming import processors as P

DAY = 86_400
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EV = """
k0 AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
ev AS (SELECT CAST(event_id AS VARCHAR) AS event_id, 's' || user_id AS session_id, ts AS event_ts, event_id AS source_offset, event_type AS source_type, props, value, k,
  CASE event_type WHEN 'click' THEN 'command_result' WHEN 'error' THEN 'error' WHEN 'view' THEN 'file_changed' WHEN 'purchase' THEN 'test_result' WHEN 'signup' THEN 'turn_lifecycle' ELSE 'unknown' END AS kind,
  CASE WHEN event_type = 'view' THEN CASE k % 10 WHEN 0 THEN 'secrets' WHEN 1 THEN 'infra' WHEN 2 THEN 'docs' ELSE 'src' END || '/f' || k || '.py' END AS path,
  CASE WHEN event_type = 'click' THEN CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END END AS exit_code,
  CASE WHEN event_type = 'signup' THEN CASE WHEN k % 2 = 0 THEN 'turn_started' ELSE 'turn_complete' END END AS phase,
  CASE WHEN event_type = 'click' THEN 'cmd_' || (k % 3) END AS command_norm, CASE WHEN event_type = 'error' THEN 'err_' || (k % 4) END AS error_fp,
  CASE WHEN event_type = 'purchase' THEN 't' || (k % 2) END AS test_target, CASE WHEN event_type = 'purchase' THEN k % 7 END AS tests_failed
  FROM k0)"""
MARKERS = """
trend AS (SELECT *, lag(tests_failed) OVER (PARTITION BY session_id, test_target ORDER BY event_ts, source_offset) AS prev_failed FROM ev WHERE kind = 'test_result'),
fixed AS (SELECT * FROM (SELECT *, lag(exit_code) OVER (PARTITION BY session_id, command_norm ORDER BY event_ts, source_offset) AS prev_exit FROM ev WHERE kind = 'command_result') WHERE exit_code = 0 AND prev_exit <> 0),
newfile AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, path ORDER BY event_ts, source_offset) AS n FROM ev WHERE kind = 'file_changed') WHERE n = 1),
newtarget AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, test_target ORDER BY event_ts, source_offset) AS n FROM ev WHERE kind = 'test_result') WHERE n = 1),
markers AS (SELECT session_id, event_id, event_ts, source_offset, 'new_file' AS marker FROM newfile UNION ALL SELECT session_id, event_id, event_ts, source_offset, 'new_test_target' FROM newtarget
  UNION ALL SELECT session_id, event_id, event_ts, source_offset, 'improved_test' FROM trend WHERE tests_failed < prev_failed UNION ALL SELECT session_id, event_id, event_ts, source_offset, 'fixed_command' FROM fixed
  UNION ALL SELECT session_id, event_id, event_ts, source_offset, 'milestone' FROM ev WHERE phase = 'turn_complete')"""
REPEATED = """
epochs AS (SELECT *, sum(CASE WHEN kind = 'file_changed' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY event_ts, source_offset) AS epoch FROM ev),
outcomes AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(exit_code) OVER w IS NOT DISTINCT FROM exit_code THEN 0 ELSE 1 END AS changed FROM epochs WHERE kind = 'command_result' WINDOW w AS (PARTITION BY session_id, command_norm, epoch ORDER BY event_ts, source_offset)),
islands AS (SELECT *, sum(changed) OVER (PARTITION BY session_id, command_norm, epoch ORDER BY event_ts, source_offset) AS island FROM outcomes),
repeated AS (SELECT session_id, command_norm, epoch, island, count(*) AS n, min(source_offset) AS first_event, max(source_offset) AS last_event, max(event_ts) AS last_ts FROM islands GROUP BY ALL HAVING count(*) >= 3)"""
RECURRING = "recurring AS (SELECT session_id, error_fp, count(*) AS n, min(source_offset) AS first_event, max(source_offset) AS last_event, max(event_ts) AS last_ts FROM ev WHERE kind = 'error' GROUP BY ALL HAVING count(*) >= 3)"
GAPS = """
ends AS (SELECT session_id, min(event_ts) AS a, max(event_ts) AS b FROM ev GROUP BY ALL),
points AS (SELECT DISTINCT * FROM (SELECT session_id, event_ts FROM markers UNION ALL SELECT session_id, a FROM ends UNION ALL SELECT session_id, b FROM ends)),
gaps AS (SELECT * FROM (SELECT session_id, event_ts AS gap_start, lead(event_ts) OVER (PARTITION BY session_id ORDER BY event_ts) AS gap_end FROM points) WHERE (epoch_us(gap_end) - epoch_us(gap_start)) // 1000000 >= 86400)"""
STATES = """
phases AS (SELECT session_id, max(event_ts) AS last_ts, arg_max(phase, source_offset) FILTER (kind = 'turn_lifecycle') AS last_phase FROM ev GROUP BY ALL),
states AS (SELECT session_id, last_ts, CASE WHEN last_phase = 'turn_started' THEN 'active_turn' WHEN last_phase = 'turn_complete' THEN 'between_turns' ELSE 'unknown' END AS state FROM phases)"""
SIGNALS = """
signals AS (SELECT session_id, 'repeated_command' AS kind, command_norm || ':' || epoch || ':' || island AS subject, 'warning' AS severity, last_ts AS observed_at FROM repeated
  UNION ALL SELECT session_id, 'recurring_error', error_fp, 'warning', last_ts FROM recurring
  UNION ALL SELECT session_id, 'test_regression', event_id, 'warning', event_ts FROM trend WHERE tests_failed > prev_failed
  UNION ALL SELECT session_id, 'forbidden_path', path, 'critical', max(event_ts) FROM ev WHERE path LIKE 'secrets/%' GROUP BY session_id, path
  UNION ALL SELECT session_id, 'scope_expansion', path, 'warning', max(event_ts) FROM ev WHERE path LIKE 'infra/%' GROUP BY session_id, path
  UNION ALL SELECT session_id, 'stagnation', CAST(epoch_us(gap_start) // 1000000 AS VARCHAR), 'warning', gap_end FROM gaps)"""
ALL = ",".join([EV, MARKERS, REPEATED, RECURRING, GAPS, STATES, SIGNALS])
RULED = """
per AS (SELECT session_id, bool_or(kind = 'forbidden_path') AS forbidden, bool_or(kind IN ('repeated_command', 'recurring_error')) AS looping, bool_or(kind = 'stagnation') AS stalled, bool_or(severity = 'critical') AS critical, count(*) AS n_signals FROM signals GROUP BY ALL),
ruled AS (SELECT s.session_id, s.state, CASE WHEN forbidden THEN 'off_scope' WHEN looping THEN 'looping' WHEN stalled THEN 'stalled' WHEN state = 'between_turns' THEN 'between_turns' WHEN s.session_id IN (SELECT session_id FROM markers) THEN 'progressing' ELSE 'investigating' END AS status,
  CASE WHEN forbidden THEN 'misaligned' ELSE 'unknown' END AS goal_alignment, coalesce(critical, false) AS needs_attention, least(8, coalesce(n_signals, 0)) AS n_concerns FROM states s LEFT JOIN per USING (session_id))"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def us(c: str):
    return F.unix_micros(c)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_events(read_table(spark, sf_dir, "events"))


def stored_events(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """For queries of many rules: one scan and one shuffle serve all of them, until the event files change.

    The columns are those that rules read; all of them if ``whole``, for packets.
    """
    ev = events(spark, sf_dir)
    return by_session(ev if whole else ev.select(*E.RULED), store=state_of(read_table(spark, sf_dir, "events")))


def bounds(ev: DataFrame) -> DataFrame:
    """The same path bounds for every session."""
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    return ev.select("session_id").distinct().withColumns({"goal_text": F.lit("demo"), "expected_paths": lit(EXPECTED), "forbidden_paths": lit(FORBIDDEN), "acceptance_criteria": F.array().cast("array<string>")})


def signals(ev: DataFrame) -> DataFrame:
    return G.all_signals(ev, bounds(ev), DAY)


def found(ev: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signals, times of progress markers, states of sessions), each written once for a query that uses them more than once.

    The signals have these columns, and what makes up the others is not computed.
    """
    markers = materialize(E.progress_markers(ev).select("session_id", "event_ts"), "markers")
    states = materialize(G.lifecycle(ev), "states")
    return materialize(G.all_signals(ev, bounds(ev), DAY, markers=markers, states=states).select(*columns), "signals"), markers, states


#: The columns of signals that the status of a session follows from, and those that its concerns are made of.
JUDGED, EXPLAINED = ("session_id", "kind", "severity"), ("id", "subject", "summary")


@query(f"WITH {EV} SELECT event_id, session_id, kind, source_type, path, CAST(exit_code AS BIGINT) AS exit_code, phase, command_norm, error_fp, test_target, CAST(tests_failed AS BIGINT) AS tests_failed, epoch_us(event_ts) AS at_us, strftime(event_ts, '%Y-%m-%d') AS day FROM ev")
def normalize_events(spark, d):
    long = [F.col(c).cast("long").alias(c) for c in ("exit_code", "tests_failed")]
    return events(spark, d).select("event_id", "session_id", "kind", "source_type", "path", *long, "phase", "command_norm", "error_fp", "test_target", us("event_ts").alias("at_us"), F.col("day").cast("string").alias("day"))


@query(f"WITH {EV} SELECT event_id, sha256(session_id || chr(31) || source_offset || chr(31) || source_type || chr(31) || sha256(props)) AS stable_id, sha256(props) AS payload_sha256, CAST(strlen(props) AS BIGINT) AS payload_bytes FROM ev")
def event_ids(spark, d):
    ev = events(spark, d)
    return ev.select("event_id", X.event_id(*[F.col(c) for c in ("session_id", "source_offset", "source_type", "payload_sha256")]).alias("stable_id"), "payload_sha256", "payload_bytes")


def raw_lines(spark, d) -> DataFrame:
    """Raw records of the event table; a tenth of them damaged."""
    line = F.concat(F.lit('{"type":"'), "event_type", F.lit('","timestamp":"'), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('","payload":{"text":"'), F.replace("props", F.lit('"'), F.lit("'")), F.lit('","session_id":"s'), "user_id", F.lit('"}}'))
    damaged = F.col("event_id") % 10 == 0
    return read_table(spark, d, "events").select(F.concat(F.lit("logs/"), "user_id").alias("source_path"), F.col("event_id").alias("source_offset"), F.when(damaged, F.substring(line, 1, 30)).otherwise(line).alias("line"))


@query("SELECT 'logs/' || user_id AS source_path, event_id AS source_offset, sha256(substr('{\"type\":\"' || event_type || '\",\"timestamp\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), 1, 30)) AS line_sha256, CAST(30 AS BIGINT) AS line_bytes FROM events WHERE event_id % 10 = 0")
def quarantine(spark, d):
    return E.quarantine(raw_lines(spark, d))[1]


@query("SELECT CASE event_type WHEN 'click' THEN 'command_result' WHEN 'error' THEN 'error' WHEN 'view' THEN 'file_changed' ELSE 'unknown' END AS kind, event_type AS source_type, 's' || user_id AS session_id, replace(props, '\"', chr(39)) AS summary, epoch_us(date_trunc('second', ts)) AS at_us FROM events WHERE event_id % 10 <> 0")
def normalize_raw(spark, d):
    ev = E.normalize(raw_lines(spark, d), {"click": "command_result", "error": "error", "view": "file_changed"})
    return ev.select("kind", "source_type", "session_id", "summary", us("event_ts").alias("at_us"))


@query("SELECT event_type AS source_type, count(*) AS n FROM events WHERE event_id % 10 <> 0 AND event_type NOT IN ('click', 'error', 'view') GROUP BY ALL")
def unknown_types(spark, d):
    return E.unknown_types(E.normalize(raw_lines(spark, d), {"click": "command_result", "error": "error", "view": "file_changed"}))


@query(f"WITH {EV} SELECT session_id, count(*) AS n_events, epoch_us(min(event_ts)) AS first_us, epoch_us(max(event_ts)) AS last_us, (epoch_us(max(event_ts)) - epoch_us(min(event_ts))) // 1000000 AS elapsed_seconds, count(*) FILTER (kind = 'error') AS n_error, count(*) FILTER (kind = 'file_changed') AS n_file_changed FROM ev GROUP BY ALL")
def session_summary(spark, d):
    return E.session_summary(events(spark, d)).select("session_id", "n_events", us("first_ts").alias("first_us"), us("last_ts").alias("last_us"), "elapsed_seconds", "n_error", "n_file_changed")


@query(f"WITH {EV},{REPEATED} SELECT session_id, command_norm, CAST(epoch AS BIGINT) AS epoch, CAST(island AS BIGINT) AS island, n, CAST(first_event AS VARCHAR) AS first_event, CAST(last_event AS VARCHAR) AS last_event FROM repeated")
def repeated_command(spark, d):
    return E.repeated_command(events(spark, d)).select("session_id", "command_norm", "epoch", "island", "n", "first_event", "last_event")


@query(f"WITH {EV},{RECURRING} SELECT session_id, error_fp, n, CAST(first_event AS VARCHAR) AS first_event, CAST(last_event AS VARCHAR) AS last_event FROM recurring")
def recurring_error(spark, d):
    return E.recurring_error(events(spark, d)).select("session_id", "error_fp", "n", "first_event", "last_event")


@query(f"WITH {EV},{MARKERS} SELECT event_id, session_id, test_target, CAST(tests_failed AS BIGINT) AS tests_failed, CASE WHEN prev_failed IS NULL THEN 'unknown' WHEN tests_failed > prev_failed THEN 'worsening' WHEN tests_failed < prev_failed THEN 'improving' ELSE 'stable' END AS trend FROM trend")
def test_trend(spark, d):
    return E.test_trend(events(spark, d)).select("event_id", "session_id", "test_target", F.col("tests_failed").cast("long").alias("tests_failed"), "trend")


@query(f"WITH {EV},{MARKERS} SELECT session_id, event_id, marker FROM markers")
def progress_markers(spark, d):
    return E.progress_markers(stored_events(spark, d)).select("session_id", "event_id", "marker")


@query(f"WITH {EV},{MARKERS}, m AS (SELECT DISTINCT event_id, true AS m FROM markers), l AS (SELECT ev.*, last_value(CASE WHEN m THEN event_ts END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY event_ts, source_offset ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_progress FROM ev LEFT JOIN m USING (event_id)) SELECT event_id, session_id, epoch_us(last_progress) AS last_us, (epoch_us(event_ts) - epoch_us(last_progress)) // 1000000 AS seconds FROM l")
def since_progress(spark, d):
    ev = stored_events(spark, d)
    return E.since_progress(ev, E.progress_markers(ev)).select("event_id", "session_id", us("last_progress").alias("last_us"), "seconds")


@query(f"WITH {EV},{MARKERS},{GAPS} SELECT session_id, epoch_us(gap_start) AS start_us, epoch_us(gap_end) AS end_us FROM gaps")
def stagnation(spark, d):
    ev = stored_events(spark, d)
    gaps = E.suppress_active(E.stagnation_gaps(ev, E.progress_markers(ev), DAY), E.pair_commands(ev))
    return gaps.select("session_id", us("gap_start").alias("start_us"), us("gap_end").alias("end_us"))


@query(f"WITH {EV},{MARKERS},{GAPS}, busy AS (SELECT session_id, event_ts AS started, event_ts + INTERVAL 12 HOUR AS until FROM ev WHERE kind = 'error' AND k >= 50) SELECT session_id, epoch_us(gap_start) AS start_us, epoch_us(gap_end) AS end_us FROM gaps g WHERE NOT EXISTS (SELECT 1 FROM busy b WHERE b.session_id = g.session_id AND b.started < g.gap_end AND b.until > g.gap_start)")
def suppressed_stagnation(spark, d):
    """Errors of the upper half stand for commands without a result, which count for twelve hours."""
    ev = stored_events(spark, d)
    k = F.regexp_extract("summary", "([0-9]+)", 1).cast("int")
    commands = ev.where("kind = 'error'").where(k >= 50).select("session_id", F.col("event_ts").alias("started"), F.lit(None).cast("timestamp").alias("ended"))
    gaps = E.suppress_active(E.stagnation_gaps(ev, E.progress_markers(ev), DAY), commands, DAY // 2)
    return gaps.select("session_id", us("gap_start").alias("start_us"), us("gap_end").alias("end_us"))


@query(f"WITH {EV} SELECT event_id, session_id, path, path LIKE 'secrets/%' AS forbidden, NOT (path LIKE 'src/%' OR path LIKE 'docs/%') AS unexpected FROM ev WHERE kind = 'file_changed'")
def path_scope(spark, d):
    ev = events(spark, d)
    return G.path_scope(ev, bounds(ev)).select("event_id", "session_id", "path", "forbidden", "unexpected")


@query(f"WITH {EV},{STATES} SELECT session_id, state, epoch_us(last_ts) AS last_us FROM states")
def lifecycle(spark, d):
    return G.lifecycle(events(spark, d)).select("session_id", "state", us("last_ts").alias("last_us"))


@query(f"WITH {EV}, t AS (SELECT *, sum(CASE WHEN phase = 'turn_started' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY event_ts, source_offset) AS turn_no FROM ev) SELECT event_id, session_id, CAST(turn_no AS BIGINT) AS turn_no, row_number() OVER (PARTITION BY session_id, turn_no ORDER BY event_ts, source_offset) AS ordinal FROM t")
def turns(spark, d):
    return E.turns(events(spark, d)).select("event_id", "session_id", "turn_no", F.col("ordinal").cast("long").alias("ordinal"))


@query(f"WITH {EV}, r AS (SELECT *, CASE WHEN kind = 'test_result' THEN 'command' ELSE kind END AS role FROM ev WHERE kind IN ('test_result', 'command_result')), n AS (SELECT *, lead(role) OVER w AS next_role, lead(event_id) OVER w AS next_id, lead(exit_code) OVER w AS next_exit FROM r WINDOW w AS (PARTITION BY session_id ORDER BY event_ts, source_offset)) SELECT session_id, event_id AS command_id, CASE WHEN next_role = 'command_result' THEN next_id END AS result_id, CASE WHEN next_role = 'command_result' THEN CAST(next_exit AS BIGINT) END AS exit_code FROM n WHERE role = 'command'")
def paired_commands(spark, d):
    """Test runs stand for commands here, clicks for results."""
    ev = events(spark, d).withColumn("kind", F.when(F.col("kind") == "test_result", "command").otherwise(F.col("kind")))
    return E.pair_commands(ev).select("session_id", "command_id", "result_id", F.col("exit_code").cast("long").alias("exit_code"))


@query(f"WITH {ALL} SELECT session_id, kind, subject, severity, epoch_us(observed_at) AS at_us FROM signals")
def all_signals(spark, d):
    return signals(stored_events(spark, d)).select("session_id", "kind", "subject", "severity", us("observed_at").alias("at_us"))


@query(f"WITH {ALL} SELECT session_id, CASE max(CASE severity WHEN 'critical' THEN 2 ELSE 1 END) WHEN 2 THEN 'critical' ELSE 'warning' END AS max_severity, count(*) AS n_signals, bool_or(severity = 'critical') AS needs_attention FROM signals GROUP BY ALL")
def attention(spark, d):
    return G.attention(signals(stored_events(spark, d)))


@query(f"WITH {EV},{RECURRING}, s AS (SELECT session_id, error_fp, 'local_rule' AS source, 1 AS rank, last_ts, 'local' AS txt FROM recurring UNION ALL SELECT session_id, error_fp, 'supplemental', 2, last_ts + INTERVAL 1 HOUR, 'outside' FROM recurring WHERE error_fp IN ('err_0', 'err_1')) SELECT session_id, error_fp AS subject, CASE max(rank) WHEN 2 THEN 'critical' ELSE 'warning' END AS severity, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, 'local' AS summary, epoch_us(max(last_ts)) AS at_us FROM s GROUP BY ALL")
def merged_signals(spark, d):
    """Local findings and stale outside ones of half of them."""
    local = G.recurring_error_signals(events(spark, d)).withColumn("summary", F.lit("local"))
    hour = F.expr("observed_at + INTERVAL 1 HOUR")
    outside = local.where("subject in ('err_0', 'err_1')").withColumns({"source": F.lit("supplemental"), "severity": F.lit("critical"), "freshness": F.lit("stale"), "observed_at": hour, "summary": F.lit("outside")})
    m = G.merge_signals(local.unionByName(outside))
    return m.select("session_id", "subject", "severity", F.array_join("sources", ",").alias("sources"), "summary", us("observed_at").alias("at_us"))


@query(f"WITH {EV},{RECURRING} SELECT session_id, error_fp AS subject, CASE WHEN (epoch_us(TIMESTAMP '2024-01-30 00:00:00') - epoch_us(last_ts)) / 1000000 <= 86400 THEN 'current' ELSE 'stale' END AS freshness FROM recurring")
def freshness(spark, d):
    return G.freshness(G.recurring_error_signals(events(spark, d)), "2024-01-30 00:00:00", DAY).select("session_id", "subject", "freshness")


@query(f"WITH {EV} SELECT * FROM (SELECT session_id, event_id, kind, row_number() OVER (PARTITION BY session_id ORDER BY event_ts DESC, source_offset DESC) AS recency FROM ev) WHERE recency <= 10")
def packet_events(spark, d):
    return E.cap_events(events(spark, d), 10).select("session_id", "event_id", "kind", F.col("recency").cast("long").alias("recency"))


@query(f"WITH {EV} SELECT session_id, kind, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_ts DESC, source_offset DESC) AS recency FROM ev) WHERE recency > 10 GROUP BY ALL")
def overflow_counters(spark, d):
    return E.fold_overflow(events(spark, d), 10)


def demo_assessments(ev: DataFrame) -> DataFrame:
    """Test results as assessments: 0 failures progressing, 1 or 2 investigating, 3 or 4 stalled, more looping."""
    t = ev.where("kind = 'test_result'")
    f = F.col("tests_failed")
    status = F.when(f == 0, "progressing").when(f <= 2, "investigating").when(f <= 4, "stalled").otherwise("looping")
    return t.select("session_id", status.alias("status"), (f >= 5).alias("needs_attention"), F.col("test_target").alias("fingerprint"), F.col("event_ts").alias("assessed_at"), F.col("source_offset").alias("event_cursor"))


DEMO = "demo AS (SELECT session_id, CASE WHEN tests_failed = 0 THEN 'progressing' WHEN tests_failed <= 2 THEN 'investigating' WHEN tests_failed <= 4 THEN 'stalled' ELSE 'looping' END AS status, tests_failed >= 5 AS needs_attention, test_target AS fingerprint, event_ts AS assessed_at, source_offset AS event_cursor FROM ev WHERE kind = 'test_result')"
CHANGES = "lagged AS (SELECT *, lag(status) OVER w AS prev_status, lag(needs_attention) OVER w AS prev_needs_attention, lag(fingerprint) OVER w AS prev_fingerprint FROM demo WINDOW w AS (PARTITION BY session_id ORDER BY assessed_at, event_cursor)), changes AS (SELECT * FROM lagged WHERE NOT (status IS NOT DISTINCT FROM prev_status AND needs_attention IS NOT DISTINCT FROM prev_needs_attention AND fingerprint IS NOT DISTINCT FROM prev_fingerprint))"
TOLD = "told AS (SELECT * FROM (SELECT *, CASE WHEN needs_attention AND NOT coalesce(prev_needs_attention, false) THEN 'attention' WHEN status IN ('stalled', 'looping') AND status IS DISTINCT FROM prev_status THEN 'status' WHEN status IS NOT DISTINCT FROM prev_status AND fingerprint IS DISTINCT FROM prev_fingerprint AND (needs_attention OR status IN ('stalled', 'looping')) THEN 'warning_changed' END AS reason FROM changes) WHERE reason IS NOT NULL)"
ORDERED = ("assessed_at", "event_cursor")


def demo_told(spark, d) -> DataFrame:
    return N.keyed(N.notifications(N.transitions(demo_assessments(events(spark, d)), ORDERED)))


@query(f"WITH {EV},{DEMO}, w AS (SELECT session_id, date_trunc('day', event_ts) AS opened_at FROM ev GROUP BY ALL) SELECT session_id, epoch_us(opened_at) AS opened_us, a.status, a.event_cursor FROM w ASOF LEFT JOIN (SELECT session_id AS s, status, event_cursor, assessed_at FROM demo) a ON w.session_id = a.s AND w.opened_at >= a.assessed_at")
def previous_assessment(spark, d):
    ev = events(spark, d)
    windows = ev.select("session_id", F.date_trunc("day", "event_ts").alias("opened_at")).distinct().withColumn("window_id", us("opened_at"))
    return A.previous_assessment(windows, demo_assessments(ev)).select("session_id", us("opened_at").alias("opened_us"), "previous.status", "previous.event_cursor")


@query(f"WITH {EV},{DEMO},{CHANGES} SELECT session_id, event_cursor, status, prev_status, needs_attention FROM changes")
def transitions(spark, d):
    return N.transitions(demo_assessments(events(spark, d)), ORDERED).select("session_id", "event_cursor", "status", "prev_status", "needs_attention")


@query(f"WITH {EV},{DEMO},{CHANGES},{TOLD} SELECT session_id, reason, session_id || '+' || status || '+' || fingerprint || '+' || event_cursor AS dedupe_key FROM told")
def notifications(spark, d):
    return demo_told(spark, d).select("session_id", "reason", "dedupe_key")


@query(f"WITH {EV},{DEMO},{CHANGES},{TOLD} SELECT session_id, session_id || '+' || status || '+' || fingerprint || '+' || event_cursor AS dedupe_key FROM told WHERE event_cursor % 3 <> 0")
def undelivered(spark, d):
    told = demo_told(spark, d)
    return N.undelivered(told.unionByName(told), told.where("event_cursor % 3 = 0")).select("session_id", "dedupe_key")


@query(f"WITH {EV},{DEMO},{CHANGES},{TOLD} SELECT session_id, event_cursor, '*' || status || '* after 2 min' || chr(10) || 'Action: run ' || replace(fingerprint, '.', '') || chr(10) || 'Alignment: unknown' || chr(10) || 'Concerns: tests' || chr(10) || 'Tests: \\-' || chr(10) || 'Files: a\\.py, b\\-c' || chr(10) || 'Session: ' || session_id AS text FROM told")
def rendered(spark, d):
    told = demo_told(spark, d).withColumns({"elapsed_seconds": F.lit(150), "current_action": F.concat(F.lit("run "), "fingerprint"), "goal_alignment": F.lit("unknown"), "concerns": F.array(F.lit("tests")), "latest_test": F.lit(None).cast("string"), "paths": F.array(F.lit("src/a.py"), F.lit("/w/b-c"))})
    return N.render(told).select("session_id", "event_cursor", "text")


NOW = "2024-01-20 00:00:00"


def demo_deliveries(ev: DataFrame) -> DataFrame:
    k = F.col("source_offset")
    return ev.where("kind = 'error'").select(
        F.concat("session_id", F.lit("+"), "error_fp").alias("dedupe_key"), "session_id", F.when(k % 4 == 0, "sent").when(k % 4 == 1, "pending").when(k % 4 == 2, "failed_transient").otherwise("failed_permanent").alias("status"),
        (k % 12).cast("int").alias("attempt"), F.col("event_ts").alias("last_at"), F.when(k % 2 == 0, (k % 100 * 100).cast("int")).alias("retry_after_s"),
    )


DELIVERIES = "deliveries AS (SELECT session_id || '+' || error_fp AS dedupe_key, session_id, CASE source_offset % 4 WHEN 0 THEN 'sent' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed_transient' ELSE 'failed_permanent' END AS status, source_offset % 12 AS attempt, event_ts AS last_at, CASE WHEN source_offset % 2 = 0 THEN source_offset % 100 * 100 END AS retry_after_s FROM ev WHERE kind = 'error'), newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY attempt DESC, last_at DESC, status DESC) AS n FROM deliveries) WHERE n = 1)"


@query(f"WITH {EV},{DELIVERIES}, w AS (SELECT *, CASE WHEN status = 'failed_transient' THEN CAST(greatest(coalesce(retry_after_s, 0), least(3600, 30 * pow(2, attempt))) AS DOUBLE) ELSE 0.0 END AS wait_seconds FROM newest) SELECT dedupe_key, status, CAST(attempt AS BIGINT) AS attempt, wait_seconds FROM w WHERE status IN ('pending', 'failed_transient') AND attempt < 10 AND epoch_us(last_at) // 1000000 + wait_seconds <= epoch_us(TIMESTAMP '{NOW}') // 1000000")
def due_retries(spark, d):
    return N.due_retries(demo_deliveries(events(spark, d)), NOW).select("dedupe_key", "status", F.col("attempt").cast("long").alias("attempt"), "wait_seconds")


@query(f"WITH {ALL},{RULED} SELECT session_id, status, goal_alignment, needs_attention, CAST(n_concerns AS BIGINT) AS n_concerns FROM ruled")
def rule_assessment(spark, d):
    ev = stored_events(spark, d)
    sig, marks, states = found(ev, *JUDGED, *EXPLAINED)
    a = A.rule_assessment(states, sig, marks, ev)
    return a.select("session_id", "status", "goal_alignment", "needs_attention", F.size("concerns").cast("long").alias("n_concerns"))


def routine(ev: DataFrame) -> DataFrame:
    """The newest demo assessment of each session as a routine answer."""
    a = S.latest(demo_assessments(ev), order="event_cursor")
    return a.withColumns({"goal_alignment": F.when(F.col("event_cursor") % 3 == 0, "possibly_aligned").otherwise("aligned"), "confidence": (F.col("event_cursor") % 100) / 100.0, "assessed_by": F.lit("routine")})


ROUTINE = "routine AS (SELECT session_id, arg_max(status, event_cursor) AS status, arg_max(needs_attention, event_cursor) AS needs_attention, max(event_cursor) AS c, CASE WHEN max(event_cursor) % 3 = 0 THEN 'possibly_aligned' ELSE 'aligned' END AS goal_alignment, (max(event_cursor) % 100) / 100.0 AS confidence FROM demo GROUP BY ALL)"


@query(f"WITH {ALL},{DEMO},{ROUTINE}, s AS (SELECT session_id, bool_or(severity = 'critical') AS crit, bool_or(kind IN ('repeated_command', 'recurring_error', 'stagnation')) AS warn, bool_or(kind = 'stagnation') AS stag FROM signals GROUP BY ALL) SELECT session_id, concat_ws(',', CASE WHEN confidence < 0.72 THEN 'low_confidence' END, CASE WHEN goal_alignment = 'possibly_aligned' THEN 'alignment' END, CASE WHEN status IN ('stalled', 'looping') THEN 'status' END, CASE WHEN crit THEN 'critical_signal' END, CASE WHEN status = 'progressing' AND (crit OR warn) THEN 'conflict' END, CASE WHEN stag THEN 'stagnation' END) AS reasons FROM routine LEFT JOIN s USING (session_id)")
def escalations(spark, d):
    ev = stored_events(spark, d)
    return A.needs_escalation(routine(ev), signals(ev)).select("session_id", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {ALL},{RULED},{DEMO},{ROUTINE}, strong AS (SELECT * FROM routine WHERE c % 5 = 0) SELECT r.session_id, coalesce(CASE WHEN s.session_id IS NOT NULL THEN 'investigating' END, a.status, r.status) AS status, CASE WHEN s.session_id IS NOT NULL THEN 'strong' WHEN a.session_id IS NOT NULL THEN 'routine' ELSE 'rules' END AS assessed_by, (r.needs_attention OR coalesce(CASE WHEN s.session_id IS NOT NULL THEN false END, a.needs_attention, r.needs_attention)) AS needs_attention FROM ruled r LEFT JOIN routine a USING (session_id) LEFT JOIN strong s USING (session_id)")
def reconciled(spark, d):
    ev = stored_events(spark, d)
    (sig, marks, states), first = found(ev, *JUDGED), routine(ev)
    strong = first.where("event_cursor % 5 = 0").withColumns({"status": F.lit("investigating"), "needs_attention": F.lit(False), "assessed_by": F.lit("strong")})
    out = A.reconcile(A.rule_status(states, sig, marks, ev), first, strong, sig, states)
    return out.select("session_id", "status", "assessed_by", "needs_attention")


@query(f"WITH {EV}, t AS (SELECT session_id || ':' || event_id AS packet_id, exit_code = 0 AS valid FROM ev WHERE kind = 'command_result'), x AS (SELECT packet_id, 'routine' AS assessor, 1 AS attempt, valid FROM t UNION ALL SELECT packet_id, 'routine', 2, true FROM t) SELECT packet_id, CAST(min(attempt) AS BIGINT) AS attempt FROM x WHERE valid GROUP BY ALL")
def selected_attempts(spark, d):
    t = events(spark, d).where("kind = 'command_result'").select(F.concat("session_id", F.lit(":"), "event_id").alias("packet_id"), (F.col("exit_code") == 0).alias("valid"))
    tries = t.withColumn("attempt", F.lit(1)).unionByName(t.select("packet_id", F.lit(True).alias("valid"), F.lit(2).alias("attempt"))).withColumns({"assessor": F.lit("routine"), "call_status": F.lit("ok")})
    return A.select_attempt(tries).select("packet_id", F.col("attempt").cast("long").alias("attempt"))


@query(f"WITH {EV},{MARKERS},{DEMO}, l AS (SELECT session_id, min(assessed_at) AS a FROM demo GROUP BY ALL), e AS (SELECT session_id, max(event_ts) AS last_ts, max(event_ts) FILTER (kind = 'turn_lifecycle') AS c FROM ev GROUP BY ALL), m AS (SELECT session_id, max(event_ts) AS m FROM markers GROUP BY ALL) SELECT * FROM (SELECT e.session_id, CASE WHEN a IS NULL THEN 'first' WHEN c > a THEN 'lifecycle' WHEN m > a THEN 'marker' WHEN epoch_us(last_ts) - epoch_us(a) >= 600000000 THEN 'cadence' END AS reason FROM e LEFT JOIN m USING (session_id) LEFT JOIN l USING (session_id)) WHERE reason IS NOT NULL")
def assessment_triggers(spark, d):
    ev = events(spark, d)
    last = demo_assessments(ev).groupBy("session_id").agg(F.min("assessed_at").alias("assessed_at"))
    return A.assessment_triggers(ev, E.progress_markers(ev), last)


@query(f"WITH {EV} SELECT session_id, epoch_us(time_bucket(INTERVAL 1 DAY, event_ts)) AS start_us, count(*) AS n_events, count(*) FILTER (kind = 'error') AS n_errors FROM ev GROUP BY ALL")
def activity_windows(spark, d):
    return E.activity(events(spark, d), "1 day").select("session_id", us("window_start").alias("start_us"), "n_events", "n_errors")


@query(f"WITH {EV}, g AS (SELECT *, CASE WHEN event_ts - lag(event_ts) OVER w < INTERVAL 24 HOUR THEN 0 ELSE 1 END AS starts FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY event_ts)), i AS (SELECT *, sum(starts) OVER (PARTITION BY session_id ORDER BY event_ts) AS i FROM g) SELECT session_id, epoch_us(min(event_ts)) AS started_us, epoch_us(max(event_ts) + INTERVAL 24 HOUR) AS ended_us, count(*) AS n_events FROM i GROUP BY session_id, i")
def idle_sessions(spark, d):
    return E.idle_sessions(events(spark, d), "24 hours").select("session_id", us("started").alias("started_us"), us("ended").alias("ended_us"), "n_events")


@query(f"WITH {EV} SELECT event_id, (epoch_us(nxt) - epoch_us(event_ts)) // 1000000 AS gap_seconds FROM (SELECT *, lead(event_ts) OVER (PARTITION BY session_id ORDER BY event_ts, source_offset) AS nxt FROM ev) WHERE (epoch_us(nxt) - epoch_us(event_ts)) // 1000000 > 43200")
def quiet_gaps(spark, d):
    return E.quiet_gaps(events(spark, d), DAY // 2).select("event_id", "gap_seconds")


@query(f"WITH {EV} SELECT event_id, count(*) FILTER (kind = 'error') OVER (PARTITION BY session_id ORDER BY event_ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n_recent FROM ev")
def error_rate(spark, d):
    return E.rate(events(spark, d), "error", DAY).select("event_id", "n_recent")


@query(f"WITH {EV} SELECT event_id FROM (SELECT event_id, event_ts, lag(event_ts) OVER (PARTITION BY session_id ORDER BY k, source_offset) AS p FROM ev) WHERE event_ts < p")
def monotonic_violations(spark, d):
    """Offsets by the payload's number, so that there are violations to find."""
    k = F.regexp_extract("summary", "([0-9]+)", 1).cast("long")
    return E.check_monotonic(events(spark, d).withColumn("source_offset", k * 100_000_000 + F.col("source_offset"))).select("event_id")


@query(f"WITH {EV} SELECT session_id, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM ev WHERE kind = 'file_changed' GROUP BY ALL")
def changed_files(spark, d):
    return E.changed_files(events(spark, d)).select("session_id", F.array_join("paths", ",").alias("paths"))


@query(f"WITH {EV}, m AS (SELECT max(event_ts) - INTERVAL 10 DAY AS m FROM ev) SELECT DISTINCT session_id, path FROM ev, m WHERE event_ts > m AND path IS NOT NULL AND (session_id, path) NOT IN (SELECT (session_id, path) FROM ev, m WHERE event_ts <= m AND path IS NOT NULL)")
def new_paths(spark, d):
    ev = events(spark, d)
    ev = ev.crossJoin(F.broadcast(ev.agg(F.expr("max(event_ts) - INTERVAL 10 DAY").alias("m"))))  # one row
    return E.new_paths(ev.where("event_ts > m"), ev.where("event_ts <= m"))


@query(f"WITH {EV} SELECT event_id FROM ev WHERE source_offset % 3 = 0")
def new_events(spark, d):
    """A replay of everything against a store that lacks a third."""
    ev = events(spark, d)
    return E.new_events(E.dedupe(ev.unionByName(ev)), ev.where("source_offset % 3 <> 0")).select("event_id")


@query(f"WITH {EV}, c AS (SELECT session_id, median(source_offset) AS c FROM ev WHERE session_id <> 's1' GROUP BY ALL) SELECT ev.event_id FROM ev LEFT JOIN c USING (session_id) WHERE source_offset > coalesce(c, -1)")
def after_cursor(spark, d):
    ev = events(spark, d)
    cursors = ev.where("session_id <> 's1'").groupBy("session_id").agg(F.expr("percentile(source_offset, 0.5)").alias("source_offset"))
    return E.after_cursor(ev, cursors).select("event_id")


@query(f"WITH {EV} SELECT event_id, kind FROM ev WHERE session_id = 's1' AND source_offset > 100 ORDER BY source_offset LIMIT 20")
def events_page(spark, d):
    """A page is twenty rows by its nature."""
    return E.events_page(events(spark, d), "s1", 100, 20).select("event_id", "kind")


@query(f"WITH {ALL} SELECT s.session_id, s.state, coalesce(bool_or(severity = 'critical'), false) AS needs_attention, epoch_us(s.last_ts) AS last_us FROM states s LEFT JOIN signals USING (session_id) GROUP BY s.session_id, s.state, s.last_ts")
def list_sessions(spark, d):
    ev = stored_events(spark, d)
    return S.list_sessions(S.active_sessions(G.lifecycle(ev)).unionByName(G.lifecycle(ev).where("state = 'unknown'")), G.attention(signals(ev))).select("session_id", "state", "needs_attention", us("last_ts").alias("last_us"))


@query(f"WITH {EV},{DEMO} SELECT session_id, arg_max(status, event_cursor) AS status, max(event_cursor) AS event_cursor FROM demo GROUP BY ALL")
def current_assessment(spark, d):
    return S.latest(demo_assessments(events(spark, d)), order="event_cursor").select("session_id", "status", "event_cursor")


@query(f"WITH {EV}, r AS (SELECT 'r' || (source_offset // 2) AS idempotency_key, session_id, event_ts AS requested_at, 1.0 AS cost FROM ev WHERE kind = 'turn_lifecycle'), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY requested_at, session_id) AS n FROM r) WHERE n = 1), p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY requested_at, idempotency_key) AS nth FROM o), c AS (SELECT *, sum(cost) OVER (ORDER BY requested_at, idempotency_key ROWS UNBOUNDED PRECEDING) AS spent FROM p WHERE nth <= 5) SELECT p.idempotency_key, coalesce(c.spent <= 300, false) AS admitted FROM p LEFT JOIN c USING (idempotency_key)")
def request_budget(spark, d):
    r = events(spark, d).where("kind = 'turn_lifecycle'").select(F.concat(F.lit("r"), F.floor(F.col("source_offset") / 2)).alias("idempotency_key"), "session_id", F.col("event_ts").alias("requested_at"), F.lit(1.0).alias("cost"))
    return S.admit_requests(r, 5, 300.0).select("idempotency_key", "admitted")


@query(f"WITH {EV},{DEMO},{CHANGES} SELECT event_cursor AS change_id, session_id, status FROM changes WHERE event_cursor > 2000")
def changes_after(spark, d):
    feed = N.transitions(demo_assessments(events(spark, d)), ORDERED).withColumnRenamed("event_cursor", "change_id")
    return S.changes_after(feed, 2000).select("change_id", "session_id", "status")


@query("SELECT 'c' || conv_id AS session_id, arg_min(text, turn) FILTER (role = 'user') AS goal_text FROM conversations GROUP BY ALL HAVING count(*) FILTER (role = 'user') > 0")
def goals(spark, d):
    m = read_table(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("session_id"), "role", "text", F.col("turn").alias("seq"))
    return E.session_goal(m).select("session_id", "goal_text")


@query("WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM conversations WHERE role = 'assistant'), p AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM t) SELECT conv_id, turn FROM p WHERE p IS NULL OR coalesce(len(list_intersect(t, p)) / nullif(len(list_distinct(list_concat(t, p))), 0), 1.0) < 0.8")
def material_change(spark, d):
    c = read_table(spark, d, "conversations").where("role = 'assistant'")
    ev = c.select(F.lit("reasoning").alias("kind"), F.concat(F.lit("c"), "conv_id").alias("session_id"), "conv_id", "turn", F.col("text").alias("summary"), F.timestamp_seconds("turn").alias("event_ts"), F.lit("").alias("source_path"), F.col("turn").alias("source_offset"))
    return E.hypothesis_changes(ev).select("conv_id", "turn")


def documents(spark, d) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", "text", "source")


# Written by hand for the twins, apart from the table that is under test.
_ORACLE = {
    "private_key": r"(?s)-----BEGIN [A-Z ]*(?:PRIVATE KEY|CERTIFICATE)-----.*?(?:-----END [A-Z ]*(?:PRIVATE KEY|CERTIFICATE)-----|$)",
    "bearer": r"(?i)(?:authorization:[ ]*)?(?:bearer|basic)[ ]+[a-z0-9._~+/=\-]{8,}",
    "cookie": r"(?i)(?:set-)?cookie:[ ]*[^\n]+",
    "oauth": r"(?i)((?:access|refresh|id)_token[\"']?[ ]*[=:][ ]*[\"']?)[a-z0-9._~+/\-]{8,}",
    "env_secret": r"(?i)([a-z0-9_]*(?:SECRET|TOKEN|PASSWORD|PASSWD|API_?KEY|PRIVATE_KEY)[a-z0-9_]*[\"']?[ ]*=[ ]*[\"']?)[^ \n\"']+",
    "api_key": r"A(?:KI|SI)A[A-Z0-9]{16}|gh[oprsu]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_\-]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}|eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+",
}
_quote = lambda t: t.replace("'", "''")
_CLASS_SQL = ", ".join("CASE WHEN length(text) > 4000 THEN 'oversized_output' END" if n == "oversized_output" else f"CASE WHEN regexp_matches(text, '{_quote(_ORACLE[n])}') THEN '{n}' END" for n in sorted([*_ORACLE, "oversized_output"]))
_REDACT_SQL = "text"
for _n, _p in _ORACLE.items():
    _REDACT_SQL = f"regexp_replace({_REDACT_SQL}, '{_quote(_p)}', '{chr(92) + '1' if _n in ('oauth', 'env_secret') else ''}[REDACTED:{_n}]', 'g')"


@query(f"SELECT doc_id, concat_ws(',', {_CLASS_SQL}) AS classes FROM documents")
def redaction_classes(spark, d):
    return documents(spark, d).select("doc_id", F.array_join(R.classes(F.col("text"), limit=4000), ",").alias("classes"))


@query(f"SELECT doc_id, sha256({_REDACT_SQL}) AS redacted_sha256 FROM documents")
def redacted_text(spark, d):
    return documents(spark, d).select("doc_id", F.sha2(R.redact(F.col("text")), 256).alias("redacted_sha256"))


@query(f"""WITH r AS (SELECT doc_id, 'before' AS stage, text FROM documents UNION ALL SELECT doc_id, 'after', {_REDACT_SQL} FROM documents) SELECT doc_id, stage, secret FROM r, (SELECT unnest(['AKIA'] || list_transform(string_split('0123456789abcdef', ''), lambda x: 'token = "' || x)) AS secret) WHERE contains(text, secret)""")
def leak_scan(spark, d):
    """Seeds in the texts before and after redaction; no key is left behind it."""
    seeds = spark.createDataFrame([("AKIA",), *((f'token = "{x}',) for x in "0123456789abcdef")], "secret string")
    docs = documents(spark, d)
    both = docs.withColumn("stage", F.lit("before")).unionByName(docs.withColumns({"stage": F.lit("after"), "text": R.redact(F.col("text"))}))
    return R.leak_scan(both, "text", seeds).select("doc_id", "stage", "secret")


@query("SELECT doc_id, substr(text, 1, 200) AS bounded, CASE WHEN length(text) > 120 THEN substr(text, 1, 80) || chr(10) || '[...]' || chr(10) || right(text, 40) ELSE text END AS ends FROM documents")
def bounded_summary(spark, d):
    return documents(spark, d).select("doc_id", X.bound(F.col("text"), 200).alias("bounded"), X.head_tail(F.col("text"), 80, 40).alias("ends"))


_NORM = "trim(regexp_replace(regexp_replace(regexp_replace({}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}(\\.[0-9]+)?)?(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?', '<time>', 'g'), '(/var)?/tmp/[^ \\t\\n\"'']*', '<tmp>', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"


@query(f"WITH c AS (SELECT event_id, 'run /tmp/x' || value || '  at ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' 0xAF' || event_id || ' in /usr/lib/x.py ' || event_type AS cmd FROM (SELECT *, CAST(event_id % 7 AS VARCHAR) AS v FROM events) e), n AS (SELECT event_id, {_NORM.format('cmd')} AS c FROM c) SELECT event_id, c AS command_norm, sha256(regexp_replace(regexp_replace(regexp_replace(lower(c), '0x[0-9a-f]+', '<hex>', 'g'), '/[a-z0-9._-]+(/[a-z0-9._-]+)+', '<path>', 'g'), '[0-9]+', '<n>', 'g')) AS error_fp FROM n")
def normalized_texts(spark, d):
    cmd = F.concat(F.lit("run /tmp/x"), F.col("value").cast("string"), F.lit("  at "), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" 0xAF"), F.col("event_id").cast("string"), F.lit(" in /usr/lib/x.py "), "event_type")
    return read_table(spark, d, "events").select("event_id", X.normalize_command(cmd).alias("command_norm"), X.error_fingerprint(cmd).alias("error_fp"))


@query(f"WITH {EV} SELECT event_id, CASE k % 4 WHEN 0 THEN 'f' || k WHEN 1 THEN 'a/f' || k WHEN 2 THEN '/etc/f' || k ELSE 'f' || k END AS path, substr(sha256('salt' || 'f' || k), 1, 12) AS pseudonym FROM ev")
def paths(spark, d):
    k = F.regexp_extract("summary", "([0-9]+)", 1).cast("int")
    name = F.concat(F.lit("f"), k)
    raw = F.when(k % 4 == 0, F.concat(F.lit("/w/./x/../"), name)).when(k % 4 == 1, F.concat(F.lit("/w/a//b/../"), name)).when(k % 4 == 2, F.concat(F.lit("/etc/"), name)).otherwise(F.concat(F.lit("../"), name))
    return events(spark, d).select("event_id", X.canonical_path(raw, F.lit("/w")).alias("path"), X.pseudonymize(name, "salt").alias("pseudonym"))


@query(f"WITH {EV} SELECT event_id, CASE k % 4 WHEN 0 THEN 'pytest' WHEN 1 THEN 'cargo' WHEN 2 THEN 'vitest' ELSE 'generic' END AS runner, CAST(CASE k % 4 WHEN 3 THEN CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END ELSE k END AS BIGINT) AS passed, CAST(CASE k % 4 WHEN 3 THEN CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END ELSE k % 7 END AS BIGINT) AS failed FROM ev")
def test_counts(spark, d):
    k = F.regexp_extract("summary", "([0-9]+)", 1).cast("int")
    f, p = (k % 7).cast("string"), k.cast("string")
    out = F.when(k % 4 == 0, F.concat(F.lit("== "), f, F.lit(" failed, "), p, F.lit(" passed in 1.2s =="))).when(k % 4 == 1, F.concat(F.lit("test result: FAILED. "), p, F.lit(" passed; "), f, F.lit(" failed; 0 ignored"))).when(k % 4 == 2, F.concat(F.lit("Tests  "), f, F.lit(" failed | "), p, F.lit(" passed (9)"))).otherwise("no counts")
    c = X.test_counts(out, F.when(k % 5 == 0, 0).otherwise(1))
    return events(spark, d).select("event_id", c["runner"].alias("runner"), c["passed"].cast("long").alias("passed"), c["failed"].cast("long").alias("failed"))


@query(f"WITH {EV} SELECT event_id, 'a:b/' || session_id AS path, source_offset AS offset_, 'm' || k AS mark, epoch_us(date_trunc('second', event_ts)) AS parsed_us FROM ev")
def cursors(spark, d):
    ev = events(spark, d)
    k = F.regexp_extract("summary", "([0-9]+)", 1)
    c = X.parse_cursor(X.cursor(F.concat(F.lit("a:b/"), "session_id"), F.col("source_offset"), F.concat(F.lit("m"), k)))
    time = X.parse_time(F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return ev.select("event_id", c["path"].alias("path"), c["offset"].alias("offset_"), c["mark"].alias("mark"), F.unix_micros(time).alias("parsed_us"))


@query("SELECT doc_id, regexp_replace(text, '([_*\\[\\]()~`>#+=|{}.!\\\\-])', '\\\\\\1', 'g') AS escaped FROM documents")
def escaped_markup(spark, d):
    return documents(spark, d).select("doc_id", X.escape_markup(F.col("text")).alias("escaped"))


@query(f"WITH {EV}, c AS (SELECT session_id, string_agg(CASE WHEN error_fp = 'err_0' THEN 'errors|critical|' ELSE 'errors|warning|' END || error_fp || ',' || 'x', chr(10) ORDER BY CASE WHEN error_fp = 'err_0' THEN 'errors|critical|' ELSE 'errors|warning|' END || error_fp || ',' || 'x') AS c FROM (SELECT DISTINCT session_id, error_fp FROM ev WHERE kind = 'error') GROUP BY ALL) SELECT session_id, sha256(c) AS fingerprint FROM c")
def concern_fingerprints(spark, d):
    """Two wordings of the same concerns; the fingerprint takes no notice."""
    e = events(spark, d).where("kind = 'error'").select("session_id", "error_fp").distinct()
    c = F.struct(F.when(F.col("error_fp") == "err_0", "critical").otherwise("warning").alias("severity"), F.lit("errors").alias("kind"), F.concat(F.lit("wording of "), "session_id").alias("explanation"), F.array(F.lit("x"), F.col("error_fp")).alias("evidence_refs"))
    return e.groupBy("session_id").agg(F.collect_list(c).alias("concerns")).select("session_id", X.concern_fingerprint(F.col("concerns")).alias("fingerprint"))


def demo_joined(spark, d) -> DataFrame:
    """Labels against a simple prediction from the text: status by quality, attention by toxicity."""
    labels = read_table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("session_id"), F.when(F.col("quality") == 1, "progressing").otherwise("stalled").alias("status"), (F.col("toxic") == 1).alias("needs_attention"), F.when(F.col("quality") == 1, "healthy").otherwise("stalled").alias("outcome_class"), (F.col("doc_id") % 2 == 0).alias("factual"))
    marks = F.rlike("text", F.lit("[|#$%&!]{2}|[|]"))
    predicted = documents(spark, d).select(F.col("doc_id").cast("string").alias("session_id"), F.when(marks, "stalled").otherwise("progressing").alias("status"), F.contains("text", F.lit("idiot")).alias("needs_attention"), marks.alias("escalated"))
    return V.eval_join(predicted, labels)[0]


JOINED = "j AS (SELECT l.doc_id, CASE WHEN quality = 1 THEN 'progressing' ELSE 'stalled' END AS label_status, toxic = 1 AS y, CASE WHEN regexp_matches(text, '[|#$%&!]{2}|[|]') THEN 'stalled' ELSE 'progressing' END AS status, contains(text, 'idiot') AS p FROM labels l JOIN documents d USING (doc_id))"
F1 = "f AS (SELECT c, 2 * count(*) FILTER (status = c AND label_status = c) / (2 * count(*) FILTER (status = c AND label_status = c) + count(*) FILTER (status = c AND label_status <> c) + count(*) FILTER (status <> c AND label_status = c)) AS f1 FROM j, (VALUES ('progressing'), ('stalled')) v(c) GROUP BY c)"


@query(f"WITH {JOINED} SELECT label_status, status, count(*) AS n FROM j GROUP BY ALL")
def confusion(spark, d):
    return V.confusion(demo_joined(spark, d))


@query(f"WITH {JOINED},{F1} SELECT count(*) AS n_classes, round(avg(f1), 9) AS macro_f1 FROM f")
def macro_f1(spark, d):
    return V.macro_f1(demo_joined(spark, d)).select("n_classes", F.round("macro_f1", 9).alias("macro_f1"))


@query(f"WITH {JOINED}, c AS (SELECT count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND y) AS fn, count(*) FILTER (NOT p AND NOT y) AS tn FROM j) SELECT tp, fp, fn, tn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM c")
def attention_metrics(spark, d):
    return V.attention_metrics(demo_joined(spark, d))


@query(f"WITH {JOINED} SELECT count(*) FILTER (NOT y AND status = 'stalled') / count(*) FILTER (NOT y) AS false_escalation_rate, count(*) FILTER (label_status = 'progressing' AND p) / count(*) FILTER (label_status = 'progressing') AS false_attention_rate, count(*) FILTER (doc_id % 2 = 0) / count(*) AS factuality FROM j")
def false_rates(spark, d):
    j = demo_joined(spark, d)
    return V.false_rates(j).crossJoin(V.factuality(j).select("factuality"))  # one row each


@query(f"WITH {JOINED}, m AS (SELECT count(*) FILTER (p AND y) / count(*) FILTER (y) AS recall, count(*) FILTER (label_status = 'progressing' AND p) / count(*) FILTER (label_status = 'progressing') AS far FROM j) SELECT 'unsupported_citations' AS gate, 0.0::DOUBLE AS value, 0.0::DOUBLE AS threshold, true AS pass UNION ALL SELECT 'anomaly_recall', recall, 0.9, recall >= 0.9 FROM m UNION ALL SELECT 'false_attention_rate', far, 0.15, far <= 0.15 FROM m UNION ALL SELECT 'strong_gain', NULL, 0.1, false")
def release_gates(spark, d):
    j = demo_joined(spark, d)
    row = V.attention_metrics(j).crossJoin(V.false_rates(j)).select(F.lit(0.0).alias("unsupported_citations"), F.col("recall").alias("anomaly_recall"), "false_attention_rate", F.lit(None).cast("double").alias("strong_gain"))
    return V.release_gates(row)


@query("SELECT coalesce(t.c, h.c) AS outcome_class, coalesce(n, 0) AS n, CAST(coalesce(target, 0) AS BIGINT) AS target, greatest(CAST(coalesce(target, 0) AS BIGINT) - coalesce(n, 0), 0) AS missing FROM (VALUES ('healthy', 100), ('looping', 5)) t(c, target) FULL JOIN (SELECT CASE WHEN quality = 1 THEN 'healthy' ELSE 'stalled' END AS c, count(*) AS n FROM labels GROUP BY ALL) h ON t.c = h.c")
def class_distribution(spark, d):
    labels = read_table(spark, d, "labels").select(F.when(F.col("quality") == 1, "healthy").otherwise("stalled").alias("outcome_class"))
    return V.class_distribution(labels, spark.createDataFrame([("healthy", 100), ("looping", 5)], "outcome_class string, target long"))


@query("SELECT doc_id FROM labels ORDER BY sha256(CAST(doc_id AS VARCHAR)) LIMIT 5")
def smoke_sample(spark, d):
    """The smoke subset is five rows by its nature."""
    return V.smoke(read_table(spark, d, "labels"), 5, "doc_id").select("doc_id")


def demo_calls(ev: DataFrame) -> DataFrame:
    k = F.regexp_extract("summary", "([0-9]+)", 1).cast("long")
    return ev.where("kind in ('error', 'test_result')").select(F.when(F.col("kind") == "error", "routine").otherwise("strong").alias("assessor"), F.when(k % 10 == 0, "timeout").otherwise("ok").alias("call_status"), (k * 37 % 101 * 10).alias("latency_ms"), (k * 13).alias("input_tokens"))


CALLS = "calls AS (SELECT CASE WHEN kind = 'error' THEN 'routine' ELSE 'strong' END AS assessor, CASE WHEN k % 10 = 0 THEN 'timeout' ELSE 'ok' END AS call_status, CAST(k AS BIGINT) * 37 % 101 * 10 AS latency_ms, CAST(k AS BIGINT) * 13 AS input_tokens FROM ev WHERE kind IN ('error', 'test_result'))"


@query(f"WITH {EV},{CALLS} SELECT assessor, count(*) AS n, count(*) FILTER (call_status <> 'ok') AS n_failed, round(avg(latency_ms), 6) AS avg_latency_ms, quantile_cont(latency_ms, 0.5) AS p50_latency_ms, CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM calls GROUP BY ALL")
def call_stats(spark, d):
    return V.call_stats(demo_calls(events(spark, d)), exact=True).select("assessor", "n", "n_failed", F.round("avg_latency_ms", 6).alias("avg_latency_ms"), "p50_latency_ms", "input_tokens")


@query(f"WITH {EV},{CALLS} SELECT assessor, CASE WHEN latency_ms < 0 THEN 0 WHEN latency_ms >= 1000 THEN 11 ELSE latency_ms // 100 + 1 END AS bucket, count(*) AS n FROM calls GROUP BY ALL")
def latency_histogram(spark, d):
    return M.latency_histogram(demo_calls(events(spark, d)), 0, 1000, 10)


@query(f"WITH {EV},{CALLS},{DELIVERIES},{DEMO},{ROUTINE}, m AS (SELECT 'sessions_observed' AS metric, CAST(count(DISTINCT session_id) AS DOUBLE) AS value FROM ev UNION ALL SELECT 'events_ingested', count(*) FROM ev UNION ALL SELECT 'events_rejected', count(*) FROM events WHERE event_id % 10 = 0 UNION ALL SELECT 'unknown_event_types', 0 UNION ALL SELECT 'model_calls', count(*) FROM calls UNION ALL SELECT 'model_failures', count(*) FROM calls WHERE call_status <> 'ok' UNION ALL SELECT 'escalation_rate', avg(CASE WHEN confidence < 0.5 THEN 1.0 ELSE 0.0 END) FROM routine UNION ALL SELECT 'input_tokens_avg', avg(input_tokens) FROM calls UNION ALL SELECT 'notifications_sent', count(*) FROM deliveries WHERE status = 'sent' UNION ALL SELECT 'notifications_failed', count(*) FROM deliveries WHERE status LIKE 'failed%') SELECT metric, round(value, 6) AS value FROM m")
def counters(spark, d):
    ev = events(spark, d)
    escalated = routine(ev).select((F.col("confidence") < 0.5).alias("escalate"))
    return M.counters(ev, E.quarantine(raw_lines(spark, d))[1], demo_calls(ev), escalated, demo_deliveries(ev)).select("metric", F.round("value", 6).alias("value"))


@query(f"WITH {EV}, s AS (SELECT session_id, count(*) AS n FROM ev GROUP BY ALL), x AS (SELECT session_id AS c, CASE WHEN k % 2 = 0 THEN 'v1' ELSE 'v2' END AS v, k AS tokens FROM ev WHERE kind = 'error' AND error_fp = 'err_0' AND k >= 90), o AS (SELECT c, min(v) AS v, min(tokens) AS tokens FROM x GROUP BY c HAVING count(*) = 1) SELECT s.session_id, CAST(o.tokens AS BIGINT) AS context_tokens, CASE WHEN o.c IS NOT NULL THEN 'canonical_id/' || o.v END AS correlation FROM s LEFT JOIN o ON s.session_id = o.c")
def correlated(spark, d):
    """Outside metrics of some sessions; two rows of a session are ambiguous."""
    ev = events(spark, d)
    k = F.regexp_extract("summary", "([0-9]+)", 1).cast("long")
    extra = ev.where("error_fp = 'err_0'").where(k >= 90).select(F.col("session_id").alias("canonical_session_id"), F.when(k % 2 == 0, "v1").otherwise("v2").alias("schema_version"), k.alias("context_tokens"))
    return G.correlate(ev.select("session_id").distinct(), extra).select("session_id", "context_tokens", "correlation")


@query(f"WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_ts DESC, source_offset DESC) AS r FROM ev) SELECT 'p' || session_id AS packet_id, event_id AS ref FROM n WHERE r = 11 OR r = 12")
def unresolved_refs(spark, d):
    """Assessments that cite the twelve newest events of packets that hold ten."""
    ev = events(spark, d)
    key = F.concat(F.lit("p"), "session_id").alias("packet_id")
    packets = E.cap_events(ev, 10).groupBy(key).agg(F.collect_list(F.struct(F.col("event_id").alias("id"))).alias("events")).withColumn("signals", F.array().cast("array<struct<id:string>>"))
    cited = E.cap_events(ev, 12).groupBy(key).agg(F.collect_list("event_id").alias("basis_ids")).withColumns({"concerns": F.array().cast("array<struct<evidence_refs:array<string>>>"), "evidence": F.array(F.struct(F.lit("system").alias("ref_type"), F.lit("x").alias("ref_id")))})
    return D.unresolved_refs(cited, packets)


@query(f"WITH {EV} SELECT event_id, concat_ws(',', CASE WHEN k % 11 = 0 THEN 'kind' END, CASE WHEN k % 13 = 0 THEN 'summary' END) AS violations FROM ev WHERE k % 11 = 0 OR k % 13 = 0")
def validated_events(spark, d):
    ev = events(spark, d)
    k = F.regexp_extract("summary", "([0-9]+)", 1).cast("int")
    bad = ev.select("event_id", "event_ts", F.when(k % 11 == 0, "odd").otherwise(F.col("kind")).alias("kind"), F.when(k % 13 == 0, F.repeat(F.lit("x"), 4001)).otherwise(F.col("summary")).alias("summary"))
    return D.validate_events(bad).where(F.size("violations") > 0).select("event_id", F.array_join("violations", ",").alias("violations"))


@query(f"WITH {EV} SELECT session_id, 'terminal_completed' AS status, (epoch_us(max(event_ts)) - epoch_us(min(event_ts))) // 1000000 AS elapsed_seconds, string_agg(DISTINCT path, ',' ORDER BY path) AS files, count(*) FILTER (kind = 'test_result') AS n_tests, CAST(arg_max(tests_failed, source_offset) FILTER (kind = 'test_result') AS BIGINT) AS last_failed FROM ev GROUP BY session_id HAVING max(source_offset) % 2 = 0")
def final_report(spark, d):
    ev = events(spark, d)
    ended = ev.groupBy("session_id").agg(F.max("source_offset").alias("o"), F.max("event_ts").alias("assessed_at")).where("o % 2 = 0").select("session_id", "assessed_at", F.lit("terminal_completed").alias("status"))
    return N.final_report(ev, ended).select("session_id", "status", "elapsed_seconds", F.array_join("files", ",").alias("files"), "n_tests", F.col("last_failed").cast("long").alias("last_failed"))


@query(f"WITH {EV} SELECT event_id FROM ev WHERE CAST(event_ts AS DATE) > DATE '2024-01-20' - INTERVAL 7 DAY")
def retention(spark, d):
    return E.apply_retention(events(spark, d), "2024-01-20", 7).select("event_id")


@query(f"WITH {ALL},{RULED}, lm AS (SELECT session_id, max(event_ts) AS m FROM markers GROUP BY ALL) SELECT r.session_id, r.state, r.status, coalesce(n_signals, 0) AS n_signals, CASE WHEN critical THEN 'critical' WHEN n_signals > 0 THEN 'warning' END AS max_severity, r.needs_attention, epoch_us(m) AS last_progress_us FROM ruled r LEFT JOIN per USING (session_id) LEFT JOIN lm USING (session_id)")
def session_health(spark, d):
    """The flagship: one row for each session."""
    ev = stored_events(spark, d)
    sig, marks, states = found(ev, *JUDGED)
    status = A.rule_status(states, sig, marks, ev).select("session_id", "status", "needs_attention")
    last = marks.groupBy("session_id").agg(us_max("event_ts").alias("last_progress_us"))
    out = states.join(status, "session_id").join(G.attention(sig).select("session_id", "n_signals", "max_severity"), "session_id", "left").join(last, "session_id", "left")
    return out.select("session_id", "state", "status", F.coalesce("n_signals", F.lit(0).cast("long")).alias("n_signals"), "max_severity", "needs_attention", "last_progress_us")


def us_max(c: str):
    return F.unix_micros(F.max(c))


def replayed(spark: SparkSession, d: str) -> DataFrame:
    """The event table as a stream of files."""
    schema = read_table(spark, d, "events").schema
    return project_events(spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]"))  # a pattern may name a file as well as a folder


def run_stream(spark: SparkSession, out: DataFrame, mode: str = "append") -> DataFrame:
    """Drives a stream to the end of its input and gives what it wrote to the shared folder."""
    path = scratch_path(spark, "stream")
    if mode == "complete":
        started = out.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/out"))
    else:
        started = out.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out")
    started.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@query(f"WITH {EV} SELECT session_id, epoch_us(time_bucket(INTERVAL 1 DAY, event_ts)) AS start_us, count(*) AS n_events, count(*) FILTER (kind = 'error') AS n_errors FROM ev GROUP BY ALL")
def stream_activity(spark, d):
    return run_stream(spark, E.activity(replayed(spark, d), "1 day"), "complete").select("session_id", us("window_start").alias("start_us"), "n_events", "n_errors")


@query("SELECT CAST(event_id AS VARCHAR) AS event_id FROM events")
def stream_dedupe(spark, d):
    """Every event comes twice and leaves once."""
    ev = replayed(spark, d)
    return run_stream(spark, P.dedupe_stream(ev.unionByName(replayed(spark, d))).select("event_id"))


@query(f"WITH {EV},{REPEATED},{RECURRING} SELECT session_id, 'repeated_command' AS kind, command_norm AS subject, CAST(3 AS BIGINT) AS n FROM repeated UNION ALL SELECT session_id, 'recurring_error', error_fp, 3 FROM recurring")
def stream_repetition(spark, d):
    """A row whenever a run reaches three: as many as the batch rules find."""
    return run_stream(spark, P.apply(replayed(spark, d), P.Repetition(3))).select("session_id", "kind", "subject", "n")


@query(f"WITH {EV},{STATES} SELECT session_id, state FROM states WHERE state <> 'unknown'")
def stream_lifecycle(spark, d):
    """The last state that the stream gave each session."""
    out = run_stream(spark, P.apply(replayed(spark, d), P.Lifecycle()))
    return out.groupBy("session_id").agg(F.max_by("state", "at").alias("state"))


def in_slices(spark: SparkSession, d: str, n: int = 4) -> DataFrame:
    """The event table as a stream of micro-batches in the order of time: ``n`` stretches with about as many events, one written after the other.

    Within a stretch a session has one file, so that its events come in order however
    files are dealt to batches.
    """
    ev, path = events(spark, d), scratch_path(spark, "slices")
    cuts = ev.agg(F.percentile_approx(us("event_ts"), [k / n for k in range(1, n)])).first()[0] or []
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        at = us("event_ts")
        part = ev.where((at >= low if low is not None else F.lit(True)) & (at < high if high is not None else F.lit(True)))
        part.repartition(files, "session_id").write.mode("append").parquet(path)
    return spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", files).parquet(path)


@query(f"WITH {EV}, ends AS (SELECT session_id, min(event_ts) AS a, max(event_ts) AS b FROM ev GROUP BY ALL), points AS (SELECT DISTINCT session_id, event_ts FROM (SELECT session_id, event_ts FROM ev WHERE kind = 'file_changed' UNION ALL SELECT session_id, a FROM ends)), nexts AS (SELECT *, lead(event_ts) OVER (PARTITION BY session_id ORDER BY event_ts) AS n FROM points), mark AS (SELECT max(event_ts) - INTERVAL 10 DAY AS w FROM ev) SELECT session_id, epoch_us(event_ts) // 1000 * 1000 AS start_us, epoch_us(event_ts) // 1000 * 1000 + 86400000000 AS at_us FROM nexts JOIN ends USING (session_id), mark WHERE coalesce(n, b) - event_ts >= INTERVAL 1 DAY OR (n IS NULL AND event_ts + INTERVAL 1 DAY <= w)")
def stream_stagnation(spark, d):
    """One row for each stretch of a day without a file change, over several micro-batches: those of the batch, and open ones that the watermark ends.  The state keeps milliseconds."""
    out = run_stream(spark, P.apply(in_slices(spark, d), P.Stagnation(DAY, 0), "10 days"))
    return out.select("session_id", us("last_progress").alias("start_us"), us("at").alias("at_us"))


#: Rows of a segment in the queries below: a fraction of a session, so that sessions of these tables are cut.
FEW = 20


def cut_events(spark: SparkSession, d: str) -> DataFrame:
    """The events, as far as rules read them, with every session of more than FEW in segments, written once for the rules that follow."""
    return materialize(GS.segmented(events(spark, d).select(*E.RULED), FEW), "segments")


@query(SQL["turns"])
def segmented_turns(spark, d):
    return E.turns(cut_events(spark, d)).select("event_id", "session_id", "turn_no", F.col("ordinal").cast("long").alias("ordinal"))


@query(SQL["repeated_command"])
def segmented_repetition(spark, d):
    return E.repeated_command(cut_events(spark, d)).select("session_id", "command_norm", "epoch", "island", "n", "first_event", "last_event")


@query(SQL["progress_markers"])
def segmented_markers(spark, d):
    return E.progress_markers(cut_events(spark, d)).select("session_id", "event_id", "marker")


@query(SQL["since_progress"])
def segmented_progress(spark, d):
    ev = cut_events(spark, d)
    return E.since_progress(ev, E.progress_markers(ev)).select("event_id", "session_id", us("last_progress").alias("last_us"), "seconds")


@query(SQL["suppressed_stagnation"])
def segmented_stagnation(spark, d):
    """The sweep of ``suppressed_stagnation`` over segments of points, gaps and commands."""
    ev = cut_events(spark, d)
    k = F.regexp_extract("summary", "([0-9]+)", 1).cast("int")
    commands = ev.where("kind = 'error'").where(k >= 50).select("session_id", F.col("event_ts").alias("started"), F.lit(None).cast("timestamp").alias("ended"))
    gaps = E.suppress_active(E.stagnation_gaps(ev, E.progress_markers(ev), DAY, segment_rows=FEW), commands, DAY // 2, segment_rows=FEW)
    return gaps.select("session_id", us("gap_start").alias("start_us"), us("gap_end").alias("end_us"))


@query()
def packets(spark, d):
    """Whole observation packets as JSON; lists of structs are checked by tests."""
    ev = stored_events(spark, d, whole=True)
    first = ev.groupBy("session_id").agg(F.min("event_ts").alias("started_at")).withColumns({"workspace": F.lit("/w"), "model": F.lit(None).cast("string")})
    states = G.lifecycle(ev).select("session_id", "state").join(first, "session_id")
    a = demo_assessments(ev)
    previous = S.latest(a, order="event_cursor").select("session_id", F.struct("status", "assessed_at").alias("previous"))
    return A.packet_json(A.build_packets(ev, signals(ev), states, bounds(ev), previous, size=10))


from runscope.plans import record_queries as _records  # noqa: E402, F401 - they register themselves
