import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runscope.operators import events as E
from runscope.operators import segments as G
from runscope.schemas import EVENT

T0 = datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def ev(spark):
    r = random.Random(4)
    rows = []
    for k in range(1500):
        session = "hot" if k % 3 else f"s{k % 4}"
        kind = r.choice(["command_result", "command_result", "file_changed", "test_result", "error", "reasoning", "turn_lifecycle", "command"])
        row = {f.name: None for f in EVENT} | {"event_id": str(k), "session_id": session, "event_ts": T0 + timedelta(seconds=r.choice([7, 7, 60]) * r.randrange(900)), "source_path": "p", "source_offset": k, "kind": kind}
        row |= {"command_norm": r.choice(["make", "ls", None]), "exit_code": r.choice([0, 1, 1, None])} if kind == "command_result" else {}
        row |= {"path": r.choice("abcdefgh")} if kind == "file_changed" and r.random() < 0.2 else {}
        row |= {"test_target": r.choice(["t", "u", None]), "tests_failed": r.choice([0, 1, 2, None]), "tests_passed": r.choice([3, 4, None])} if kind == "test_result" else {}
        row |= {"summary": r.choice(["a b c", "a b d", "x y"])} if kind == "reasoning" else {}
        row |= {"phase": r.choice(["turn_started", "turn_complete"])} if kind == "turn_lifecycle" and r.random() < 0.2 else {}
        rows.append(tuple(row[f.name] for f in EVENT))
    return spark.createDataFrame(rows, EVENT).cache()


@pytest.fixture(scope="module")
def cut(ev):
    out = G.segmented(ev, 60).cache()
    per = {r["session_id"]: r["n"] for r in out.groupBy("session_id").agg(F.count_distinct(G.SEGMENT).alias("n")).collect()}
    assert per["hot"] > 10 and out.groupBy("session_id", G.SEGMENT).count().agg(F.max("count")).first()[0] <= 150
    assert out.count() == ev.count()
    return out


def rows(df):
    names = sorted(c for c in df.columns if c not in (G.SEGMENT, G.HOT))
    return sorted((tuple(r[c] for c in names) for r in df.select(*names).collect()), key=str)


@pytest.mark.parametrize("rule", [E.turns, E.repeated_command, E.test_trend, E.fixed_commands, E.hypothesis_changes, E.new_files, E.progress_markers])
def test_rules_over_segments_give_the_rows_of_the_windows(ev, cut, rule):
    want = rows(rule(ev))
    assert rows(rule(cut)) == want and want


def test_time_since_progress_over_segments(ev, cut):
    few = E.progress_markers(ev).where("marker = 'milestone'")  # so that whole segments have none
    few_cut = E.progress_markers(cut).where("marker = 'milestone'")
    assert rows(E.since_progress(cut, few_cut)) == rows(E.since_progress(ev, few))


def test_gaps_and_the_sweep_over_segments(ev, cut):
    marks = ev.where("kind = 'file_changed'")
    plain = E.stagnation_gaps(ev, marks, 30)
    assert rows(E.stagnation_gaps(ev, marks, 30, segment_rows=20)) == rows(plain)
    commands = ev.where("kind = 'command' and source_offset % 5 = 0").select("session_id", F.col("event_ts").alias("started"), F.when(F.col("source_offset") % 2 == 0, F.col("event_ts") + F.expr("interval 40 seconds")).alias("ended"))
    limit = 100
    spans = [(r["session_id"], r["started"], min(r["ended"] or r["started"] + timedelta(seconds=limit), r["started"] + timedelta(seconds=limit))) for r in commands.collect()]
    want = sorted((r["session_id"], r["gap_start"], r["gap_end"], r["seconds"]) for r in plain.collect() if not any(s == r["session_id"] and a < r["gap_end"] and b > r["gap_start"] for s, a, b in spans))
    for size in (None, 30):
        got = E.suppress_active(plain, commands, limit, segment_rows=size)
        assert sorted((r["session_id"], r["gap_start"], r["gap_end"], r["seconds"]) for r in got.collect()) == want
    assert 0 < len(want) < plain.count()
    plan = E.suppress_active(plain, commands, limit)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == plain._jdf.queryExecution().executedPlan().toString().count("Join")  # no join of gaps and commands


def test_one_session_runs_in_as_many_tasks_as_segments(spark):
    one = spark.range(20_000).select(F.lit("only").alias("session_id"), F.timestamp_seconds(F.col("id")).alias("event_ts"), F.lit("p").alias("source_path"), F.col("id").alias("source_offset"), F.lit("file_changed").alias("kind"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = G.segmented(one, 500)
        summed = G.running(cut, "n", F.lit(1)).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
        assert len(summed) >= 10 and max(r["count"] for r in summed) < 6000
        assert G.running(cut, "n", F.lit(1)).where(F.col("n") != F.col("source_offset") + 1).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_what_is_cut_is_computed_once(ev, cut, monkeypatch):
    """Cutting reads its rows three times: it must find files there, not the rules behind them."""
    seen, own = [], G.segmented
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(G, "segmented", lambda rows, *a, **k: seen.append(plan(rows)) or own(rows, *a, **k))
    commands = ev.where("kind = 'error'").select("session_id", F.col("event_ts").alias("started"), F.lit(None).cast("timestamp").alias("ended"))
    gaps = E.stagnation_gaps(cut, E.progress_markers(cut), 30, segment_rows=20)
    got = E.suppress_active(gaps, commands, 10, segment_rows=20)
    assert len(seen) == 2 and not any(w in p for p in seen for w in ("Window", "Exchange", "Union"))
    plain = E.suppress_active(E.stagnation_gaps(ev, E.progress_markers(ev), 30), commands, 10)
    assert rows(got) == rows(plain) and got.count()


def test_cut_events_hold_what_rules_read_and_no_more(spark):
    from runscope.plans import queries as Q

    assert set(Q.cut_events(spark, "/root/testdata/sf0.001").columns) == {*E.RULED, *G.columns(G.segmented(Q.events(spark, "/root/testdata/sf0.001"), 20))}
