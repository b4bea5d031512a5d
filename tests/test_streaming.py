import json
import os
from datetime import datetime, timedelta

import pytest

from runscope.operators import events as E
from runscope.operators import rules
from runscope.schemas import EVENT
from runscope.sources import session_log, sinks
from runscope.streaming import processors as P

T0 = datetime(2026, 1, 1)


def record(minute, kind, **payload):
    return json.dumps({"timestamp": (T0 + timedelta(minutes=minute)).strftime("%Y-%m-%dT%H:%M:%SZ"), "type": kind, "payload": {"session_id": "a", **payload}}) + "\n"


def event(minute, kind, session="a", **more):
    row = {f.name: None for f in EVENT} | {"event_id": f"{session}{minute}{kind}", "session_id": session, "event_ts": T0 + timedelta(minutes=minute), "source_path": "p", "source_offset": minute, "kind": kind} | more
    return tuple(row[f.name] for f in EVENT)


def stream(spark, tmp_path, name, make, batches):
    """Runs ``make(stream of events)`` over the batches, one available-now run each on one checkpoint."""
    src, out, ckpt = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "ckpt"))
    for rows in batches:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(src)
        q = make(spark.readStream.schema(EVENT).parquet(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    return spark.read.parquet(out).collect()


def unbroken_stream(spark, tmp_path, name, make, batches):
    """The same batches in one run that is never stopped."""
    src, out, ckpt = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "ckpt"))
    os.makedirs(src)
    q = make(spark.readStream.schema(EVENT).parquet(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(src)
            q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.parquet(out).collect()


@pytest.fixture
def few(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_tail_reads_each_complete_line_once(few, tmp_path):
    spark = few
    log = tmp_path / "logs/2026/01/01/rollout-a.jsonl"
    os.makedirs(log.parent)
    (log.parent / "other.txt").write_text("no log\n")
    store, ckpt = str(tmp_path / "store"), str(tmp_path / "ckpt")

    def run():
        q = sinks.ingest(session_log.tail(spark, str(tmp_path / "logs"), str(tmp_path / "state")), store, ckpt).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted(r["source_type"] for r in spark.read.parquet(f"{store}/events").collect())

    log.write_text(record(0, "turn_started") + "not json\n" + record(1, "future_thing", text="x")[:20])
    assert run() == ["turn_started"]
    log.write_text(record(0, "turn_started") + "not json\n" + record(1, "future_thing", text="x") + record(2, "error", message="boom 12"))
    assert run() == ["error", "future_thing", "turn_started"]
    assert run() == ["error", "future_thing", "turn_started"]
    log.write_text(record(0, "turn_started") + record(5, "process_exit", exit_code=0))  # replaced by another file
    assert run() == ["error", "future_thing", "process_exit", "turn_started"]
    assert spark.read.parquet(f"{store}/quarantine").select("line_bytes").distinct().collect()[0][0] == 8
    assert spark.read.parquet(f"{store}/events").where("kind = 'unknown'").count() == 1


def test_batch_reading_and_discovery(spark, tmp_path):
    log = tmp_path / "2026/01/02/rollout-b.jsonl"
    os.makedirs(log.parent)
    log.write_text(record(0, "session_meta", id="b", workspace="/w", model="m") + record(1, "turn_started") + '{"partial')
    assert session_log.read_complete_lines(spark, str(tmp_path)).count() == 2
    found = session_log.discover_sessions(spark, str(tmp_path)).collect()
    assert [str(r["day"]) for r in found] == ["2026-01-02"]
    assert session_log.discover_sessions(spark, str(tmp_path / "missing")).count() == 0
    fine, rejected = session_log.admit_files(session_log.discover_sessions(spark, str(tmp_path)), 10, str(tmp_path))
    assert (fine.count(), rejected.count()) == (0, 1)
    meta = session_log.session_meta(session_log.read_complete_lines(spark, str(tmp_path))).collect()
    assert [(r["session_id"], r["workspace"], r["model"], r["state"]) for r in meta] == [("b", "/w", "m", "unknown")]


def test_lifecycle_stream_and_batch_agree(few, tmp_path):
    turn = lambda m, p, s="a": event(m, "turn_lifecycle", s, phase=p)
    rows = [turn(0, "turn_started"), turn(1, "turn_complete"), event(2, "message", summary="done", role="assistant"), event(3, "process_lifecycle", exit_code=0, phase="process_exit"), turn(0, "turn_started", "b"), event(4, "process_lifecycle", "b", exit_code=2, phase="process_exit")]
    rows += [turn(0, "turn_started", "c"), turn(5, "turn_complete", "c"), turn(6, "input_requested", "d")]
    got = stream(few, tmp_path, "life", lambda s: P.apply(s, P.Lifecycle(300), "0 seconds"), [rows, [turn(60, "turn_started", "z")], [turn(90, "turn_started", "z2")]])
    last = {}
    for r in sorted(got, key=lambda r: r["at"]):
        last[r["session_id"]] = r["state"]
    batch = {r["session_id"]: r["state"] for r in rules.lifecycle(few.createDataFrame(rows, EVENT), "2026-01-01 01:00:00").collect()}
    assert batch == {"a": "terminal_completed", "b": "terminal_failed", "c": "between_turns", "d": "waiting"}
    assert {k: last[k] for k in batch} == batch
    early = {r["session_id"]: r["state"] for r in rules.lifecycle(few.createDataFrame(rows, EVENT), "2026-01-01 00:04:00").collect()}
    assert early["a"] == "between_turns"


def test_stagnation_and_cadence_streams(few, tmp_path):
    rows = [event(0, "file_changed"), event(1, "command"), event(0, "file_changed", "b"), event(2, "message", "b")]
    later = [[event(200, "message", "z")], [event(260, "message", "z")]]
    got = stream(few, tmp_path, "stall", lambda s: P.apply(s, P.Stagnation(1500, 3600), "0 seconds"), [rows, *later])
    at = {r["session_id"]: (r["at"] - T0).total_seconds() / 60 for r in got}
    assert (at["a"], at["b"]) == (61, 25)  # the command of a counts as running for an hour
    got = stream(few, tmp_path, "cadence", lambda s: P.apply(s, P.Cadence(600), "0 seconds"), [rows, [event(5, "file_changed", "b")], *later])
    reasons = [(r["reason"]) for r in sorted(got, key=lambda r: r["at"]) if r["session_id"] == "b"]
    assert reasons[:3] == ["first", "marker", "cadence"]


def state_of(spark, tmp_path, name, variable="state"):
    """What the state store of a stream holds, read with the state data source: (session, value fields)."""
    rows = spark.read.format("statestore").option("path", str(tmp_path / f"{name}-ckpt")).option("stateVarName", variable).load().collect()
    flat = lambda x: tuple(flat(y) if hasattr(y, "asDict") else y for y in x)
    return sorted((r["key"][0], *[flat(r[c]) if hasattr(r[c], "asDict") else r[c] for c in r.asDict() if c not in ("key", "partition_id", "expiration_timestamp", "value_expiration_timestamp")]) for r in rows)


def test_a_gap_is_reported_once_however_its_events_are_cut_into_batches(few, tmp_path):
    marks = [event(0, "file_changed")]
    batches = [marks, *[[event(m, "message")] for m in range(40, 155, 15)]]  # 8 batches within one gap
    make = lambda s: P.apply(s, P.Stagnation(1500, 3600), "0 seconds")
    got = unbroken_stream(few, tmp_path, "one", make, batches)
    assert [(r["session_id"], r["last_progress"], r["at"]) for r in got] == [("a", T0, T0 + timedelta(minutes=25))]
    ends = [[event(160, "file_changed"), event(170, "file_changed"), event(240, "message"), event(241, "file_changed")], [event(300, "message")]]
    whole = stream(few, tmp_path, "whole", make, [[r for b in [*batches, *ends] for r in b]])
    cut = unbroken_stream(few, tmp_path, "cut", make, [*batches[::4], ends[0][:2], ends[0][2:], ends[1]])
    assert sorted(whole) == sorted(cut) and len(whole) == 3
    rows = [r for b in [*batches, *ends] for r in b]
    ev = few.createDataFrame(rows, EVENT)
    gaps = E.stagnation_gaps(ev, ev.where("kind = 'file_changed'"), 1500).select("gap_start").collect()
    assert sorted(r["gap_start"] for r in gaps) == sorted(r["last_progress"] for r in whole)


def test_idle_sessions_keep_no_state_after_a_week(few, tmp_path):
    rows = [event(0, "file_changed"), event(1, "command", "b"), event(0, "turn_lifecycle", "c", phase="turn_started"), event(3, "command_result", "d", command_norm="make", exit_code=1)]
    days = lambda n: n * 1440
    beats = [[event(days(n), "file_changed", "z")] for n in (1, 9, 18)]
    for name, make, variable in (("s", lambda: P.Stagnation(1500, 3600), "state"), ("c", lambda: P.Cadence(600, quiet=3), "state"), ("l", lambda: P.Lifecycle(300), "state"), ("r", lambda: P.Repetition(3), "epoch")):
        over = lambda s, make=make: P.apply(s, make(), "0 seconds")
        unbroken_stream(few, tmp_path, f"{name}7", over, [rows, beats[0]])
        assert {"a", "b", "c", "d"} <= {r[0] for r in state_of(few, tmp_path, f"{name}7", variable)}, name
        unbroken_stream(few, tmp_path, f"{name}8", over, [rows, *beats])
        assert {r[0] for r in state_of(few, tmp_path, f"{name}8", variable)} <= {"z"}, name


def test_repetition_stream_across_a_restart(few, tmp_path):
    c = lambda m, code=1: event(m, "command_result", command_norm="make", exit_code=code)
    batches = [[c(0), c(1)], [c(2), event(3, "file_changed"), c(4), c(5)], [c(6, 0), c(7), c(8), c(9)], [event(m, "error", error_fp="e") for m in (10, 11, 12)]]
    got = stream(few, tmp_path, "repeat", lambda s: P.apply(s, P.Repetition(3)), batches)
    assert sorted((r["kind"], (r["at"] - T0).total_seconds() / 60) for r in got) == [("recurring_error", 12), ("repeated_command", 2), ("repeated_command", 9)]
    batch = E.repeated_command(few.createDataFrame([x for b in batches for x in b], EVENT)).collect()
    assert len(batch) == 2


def test_dedupe_stream(few, tmp_path):
    rows = [event(0, "message"), event(1, "message")]
    got = stream(few, tmp_path, "dedupe", lambda s: P.dedupe_stream(s).select("event_id"), [rows, rows, [event(2, "message"), event(0, "message")]])
    assert len(got) == 3


def test_streams_end_with_their_sessions(few, tmp_path):
    rows = [event(0, "turn_lifecycle", phase="turn_started"), event(1, "file_changed"), event(2, "process_lifecycle", exit_code=0, phase="process_exit"), event(0, "turn_lifecycle", "b", phase="turn_started")]
    later = [[event(m, "message", f"z{m}")] for m in (200, 400, 600)]
    got = stream(few, tmp_path, "cad", lambda s: P.apply(s, P.Cadence(600, quiet=3), "0 seconds"), [rows, *later])
    by = lambda s: [(r["reason"], (r["at"] - T0).total_seconds() / 60) for r in sorted(got, key=lambda r: r["at"]) if r["session_id"] == s]
    assert by("a") == [("first", 0)]  # ended: no cadence
    assert by("b") == [("first", 0), ("cadence", 10), ("cadence", 20), ("cadence", 30)]  # without events: a few, not for ever
    got = stream(few, tmp_path, "stall2", lambda s: P.apply(s, P.Stagnation(1500, 3600), "0 seconds"), [rows, *later])
    assert {r["session_id"] for r in got} & {"a", "b"} == {"b"}


def test_replay_of_two_hours_with_restarts_doubles_nothing(few, tmp_path):
    rows = [event(m, kind, session, phase="turn_started" if kind == "turn_lifecycle" else None, command_norm="make", error_fp="e", exit_code=1 if kind == "command_result" else None)
            for session in ("a", "b") for m in range(0, 120, 4) for kind in (("turn_lifecycle",) if m == 0 else ("command_result",) if m % 20 else ("file_changed",) if m % 40 else ("error",))]
    rows.sort(key=lambda r: r[2])
    tail = [[event(400, "message", "z")], [event(800, "message", "z")]]
    batches = [rows[:20], rows[20:], *tail]
    for name, make in {"l": lambda: P.Lifecycle(300), "s": lambda: P.Stagnation(600, 900), "r": lambda: P.Repetition(3), "c": lambda: P.Cadence(600)}.items():
        over = lambda s, make=make: P.apply(s, make(), "0 seconds")
        parts = stream(few, tmp_path, f"{name}3", over, batches)
        assert len(set(map(tuple, parts))) == len(parts)
        unbroken = unbroken_stream(few, tmp_path, f"{name}0", over, batches)
        assert sorted(map(tuple, unbroken)) == sorted(map(tuple, parts))
        for variable in ("epoch", "counts") if name == "r" else ("state",):
            assert state_of(few, tmp_path, f"{name}3", variable) == state_of(few, tmp_path, f"{name}0", variable) != []
        if name in "lrs":  # what does not hang on the cut of batches is the same
            whole = stream(few, tmp_path, f"{name}1", over, [rows, *tail])
            assert sorted(map(tuple, whole)) == sorted(map(tuple, parts))


def test_events_and_metadata_of_a_log_share_one_session(few, tmp_path):
    spark = few
    log = tmp_path / "logs/2026/01/01/rollout-x.jsonl"
    os.makedirs(log.parent)
    bare = lambda m, kind, **payload: json.dumps({"timestamp": (T0 + timedelta(minutes=m)).strftime("%Y-%m-%dT%H:%M:%SZ"), "type": kind, "payload": payload}) + "\n"
    log.write_text(bare(0, "session_meta", id="real-id", workspace="/w") + bare(1, "turn_started"))
    store, ckpt = str(tmp_path / "store"), str(tmp_path / "ckpt")

    def run():
        q = sinks.ingest(session_log.tail(spark, str(tmp_path / "logs"), str(tmp_path / "state")), store, ckpt).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    run()
    with open(log, "a") as f:
        f.write(bare(2, "turn_complete") + bare(3, "odd_type", text="y"))
    run()  # the metadata record was in an earlier batch
    raw = session_log.read_complete_lines(spark, str(tmp_path / "logs"))
    assert {r["session_id"] for r in spark.read.parquet(f"{store}/events").collect()} == {"real-id"}
    assert {r["session_id"] for r in E.normalize(raw, logs=E.log_sessions(raw)).collect()} == {"real-id"} == {r["session_id"] for r in session_log.session_meta(raw).collect()}
    assert {r["source_type"] for r in spark.read.parquet(f"{store}/unknown_types").collect()} == {"session_meta", "odd_type"}


def test_lines_of_split_files_have_their_byte_offsets(spark, tmp_path):
    lines = [f'{{"n": {k}, "t": "{"é" * (k % 97)}"}}' for k in range(3000)] + ["", "last"]
    folder = tmp_path / "2026/01/02"
    os.makedirs(folder)
    for name, end in (("a", "\n"), ("b", "")):
        (folder / f"rollout-{name}.jsonl").write_bytes(("\n".join(lines) + end).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = session_log.read_complete_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want, at = [], 0
    for x in lines:
        want += [(at, x)] if x else []
        at += len(x.encode()) + 1
    for name, rows in (("a", want), ("b", want[:-1])):  # the last line of b has no end yet
        assert sorted((r["source_offset"], r["line"]) for r in got if r["source_path"].endswith(f"rollout-{name}.jsonl")) == rows


def reading(tmp_path, **options):
    return session_log.SessionLogReader({"path": str(tmp_path / "logs"), "statepath": str(tmp_path / "state"), **{k: str(v) for k, v in options.items()}})


def read_on(reader, start):
    """The next batch: (its end, (offset, line) of its rows, its cells)."""
    end = reader.latestOffset()
    cells = reader.partitions(start, end)
    return end, [(x["source_offset"], x["line"]) for c in cells for b in reader.read(c) for x in b.to_pylist()], cells


def test_every_batch_is_bounded_the_first_after_a_restart_too(tmp_path):
    (tmp_path / "logs").mkdir()
    path = tmp_path / "logs/rollout-a.jsonl"
    path.write_text("".join(f"line {k}\n" for k in range(100)))
    reader, seen = reading(tmp_path, maxbytespertrigger=100, cellbytes=64), []
    start = reader.initialOffset()
    for k in range(14):
        if k % 3 == 2:
            reader = reading(tmp_path, maxbytespertrigger=100, cellbytes=64)  # knows no start from Spark
        start, rows, _ = read_on(reader, start)
        assert sum(len(x[1]) + 1 for x in rows) <= 100
        seen += rows
    assert [x[1] for x in seen] == [f"line {k}" for k in range(100)] and len({x[0] for x in seen}) == 100
    path.write_text("x" * 500 + "\n" + "unfinished")
    assert [x[1] for x in read_on(reading(tmp_path, maxbytespertrigger=100, cellbytes=64), start)[1]] == ["x" * 500]


def test_a_large_log_is_many_tasks_whose_lines_are_those_of_the_file(tmp_path):
    (tmp_path / "logs").mkdir()
    lines = [f"{k} {'é' * (k % 97)}" for k in range(2000)] + ["y" * 5000, "", "z"]
    (tmp_path / "logs/rollout-a.jsonl").write_bytes("\n".join(lines).encode() + b"\n")
    want, at = [], 0
    for x in lines:
        want += [(at, x)] if x else []
        at += len(x.encode()) + 1
    for size in (1000, 4096, 1 << 20):
        reader = reading(tmp_path / ".", cellbytes=size, statepath=str(tmp_path / f"state{size}"))
        _, rows, cells = read_on(reader, reader.initialOffset())
        assert rows == want and len(cells) == -(-at // size)


def test_a_change_anywhere_is_found_and_only_its_cells_are_read_again(tmp_path):
    (tmp_path / "logs").mkdir()
    path = tmp_path / "logs/rollout-a.jsonl"
    lines = [f"line {k:04d}" for k in range(200)]  # ten bytes each
    write = lambda: path.write_text("\n".join(lines) + "\n")
    write()
    reader = reading(tmp_path, cellbytes=200)
    start, rows, _ = read_on(reader, reader.initialOffset())
    assert len(rows) == 200
    lines += ["line 0200", "line 0201"]
    write()
    start, rows, _ = read_on(reader, start)
    assert rows == [(2000, "line 0200"), (2010, "line 0201")]
    lines[57] = "LINE 0057"  # far from any end; the size is the same
    write()
    os.utime(path, ns=(1, reader._files(start)[str(path)][2] + 1))
    start, rows, _ = read_on(reading(tmp_path, cellbytes=200), start)
    assert [x[1] for x in rows] == lines[40:60]
    lines[10:12] = ["a longer line that moves all others"]
    write()
    start, rows, _ = read_on(reading(tmp_path, cellbytes=200), start)
    assert [x[1] for x in rows] == [x for x in lines if rows[0][0] <= sum(len(y) + 1 for y in lines[: lines.index(x)])] and "a longer line that moves all others" in [x[1] for x in rows]
    del lines[100:]
    write()  # cut off
    start, rows, _ = read_on(reading(tmp_path, cellbytes=200), start)
    assert len(rows) <= 20 and read_on(reading(tmp_path, cellbytes=200), start)[1] == []
    lines += ["grown again"]
    write()
    assert [x[1] for x in read_on(reading(tmp_path, cellbytes=200), start)[1]][-1] == "grown again"


def test_an_offset_names_what_changed_since_a_snapshot(tmp_path, monkeypatch):
    monkeypatch.setattr(session_log, "CHANGED", 20)
    (tmp_path / "logs").mkdir()
    names = [tmp_path / f"logs/rollout-{k}.jsonl" for k in range(300)]
    for n in names:
        n.write_text("one\n")
    reader = reading(tmp_path)
    start, rows, _ = read_on(reader, reader.initialOffset())
    assert len(rows) == 300 and start == {"snapshot": 1, "files": {}}
    for n in names[:10]:
        with open(n, "a") as f:
            f.write("two\n")
    end, rows, cells = read_on(reading(tmp_path), start)
    assert len(end["files"]) == 10 and end["snapshot"] == 1 and len(cells) == 10 and {x[1] for x in rows} == {"two"}
    assert read_on(reading(tmp_path), end)[0] == end  # nothing new: the same offset
    for n in names[10:25]:
        n.write_text("")
    over, rows, _ = read_on(reading(tmp_path), end)
    assert over == {"snapshot": 2, "files": {}} and rows == []
    for k in range(6):
        for n in names[:25]:
            with open(n, "a") as f:
                f.write(f"{k}\n")
        over, rows, _ = read_on(reading(tmp_path), over)
        assert len(rows) == 25
        reading(tmp_path).commit(over)
    assert len(list((tmp_path / "state/snapshots").iterdir())) <= session_log.SNAPSHOTS
    with pytest.raises(ValueError, match="not in"):
        reading(tmp_path).partitions({"snapshot": 1, "files": {}}, over)


def test_late_rows_reach_the_store_once(few, tmp_path):
    spark = few
    log = tmp_path / "logs/2026/01/01/rollout-a.jsonl"
    os.makedirs(log.parent)
    store, ckpt = str(tmp_path / "store"), str(tmp_path / "ckpt")

    def run(*lines):
        with open(log, "a") as f:
            f.writelines(lines)
        q = sinks.ingest(session_log.tail(spark, str(tmp_path / "logs"), str(tmp_path / "state")), store, ckpt).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    run(record(0, "turn_started"), record(5000, "turn_complete"))
    run(record(1, "error", message="late"), record(5001, "error", message="new"))  # three days behind the newest
    late = P.dedupe_stream(spark.readStream.schema(EVENT).parquet(f"{store}/events"), "1 hour")  # by the watermark alone it might be lost
    assert late.isStreaming
    got = spark.read.parquet(f"{store}/events").collect()
    assert sorted((r["event_ts"] - T0).total_seconds() / 60 for r in got) == [0, 1, 5000, 5001] and len({r["day"] for r in got}) == 2


def test_processors_read_few_columns_and_call_the_store_little(few, tmp_path):
    few.createDataFrame([event(0, "message")], EVENT).write.parquet(str(tmp_path / "in"))
    source = few.readStream.schema(few.createDataFrame([], EVENT).schema).parquet(str(tmp_path / "in"))
    for made in (P.Lifecycle(), P.Stagnation(), P.Repetition(), P.Cadence()):
        plan = P.apply(source, made)._jdf.queryExecution().analyzed().toString()
        child = next(x for x in plan.splitlines() if "Project" in x and "session_id" in x)
        assert "kind" in child and "payload_sha256" not in child and "summary" not in child
    calls = []

    class Store:
        def __getattr__(self, name):
            return lambda *a: calls.append(name) or {"exists": False, "get": None, "containsKey": False, "getValue": None}.get(name)

        def getValueState(self, *a):
            return self

        getMapState = getValueState

    for made, most in ((P.Repetition(3), 4), (P.Lifecycle(), 3), (P.Stagnation(), 3), (P.Cadence(), 3)):
        made.init(Store())
        calls.clear()
        rows = [dict(zip(few.createDataFrame([], EVENT).columns, event(m, "command_result", command_norm="make", exit_code=1), strict=True)) for m in range(50)]
        list(made.handleInputRows(("a",), iter(rows), None))
        assert len(calls) <= most, (made, calls)
