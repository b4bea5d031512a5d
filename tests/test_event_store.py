from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runscope.sources import event_store as S
from runscope.sources import sinks

SCHEMA = "event_id string, day date, summary string"
D1, D2 = date(2026, 1, 1), date(2026, 1, 2)


def rows(spark, ids, day=D1):
    return spark.createDataFrame([(i, day, "x" * 20) for i in ids], SCHEMA)


def stored(spark, store):
    return sorted(r["event_id"] for r in S.read_events(spark, store, f"{SCHEMA}, batch_id long").collect())


def parts(spark, store):
    return sorted((r["batch_id"] for r in S.read_all(spark, store, "filters", S.FILTERS).select("day", "batch_id").distinct().collect()), reverse=True)


@pytest.fixture
def few(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_filters_hit_every_id_that_is_there_and_few_others(few):
    spark = few
    own = spark.range(20_000).select(F.col("id").cast("string").alias("event_id"), F.lit(D1).alias("day"), (F.col("id") % 2).alias("batch_id"))
    more = spark.range(3).select(F.col("id").cast("string").alias("event_id"), F.lit(None).cast("date").alias("day"), F.lit(7).cast("long").alias("batch_id"))
    filters = S.filters_of(own.unionByName(more)).cache()
    assert filters.where("batch_id = 0").select("size").distinct().collect()[0][0] == 4
    asked = lambda ids, day=D1: sorted(tuple(r) for r in S.hit(rows(spark, ids, day), filters).select("batch_id").collect())
    assert asked(["10"]) in ([(0,)], [(0,), (1,)]) and asked(["10", "11"]) == [(0,), (1,)]
    assert asked(["1"], None) == [(7,)] and asked(["10"], D2) == []
    sure = S.hit(own.select("event_id", "day"), filters)
    assert sure.count() == 2
    hits = sum(bool(asked([f"other{k}"])) for k in range(12))
    assert hits <= 6  # a tenth or so each


def test_batches_of_a_day_stay_bounded_and_events_stay_once(few, tmp_path):
    spark, store = few, f"file://{tmp_path}/store"
    want = set()
    for b in range(9):
        ids = {f"e{b}", f"e{b + 1}", "hot"}  # each batch repeats an id of the one before
        want |= ids
        S.add(rows(spark, [*ids, *ids]), b, store)
        if b in (3, 6):
            replaced = S.merge(spark, store, b, at=3)
            assert len(replaced) == 3
        assert stored(spark, store) == sorted(want)
    assert parts(spark, store) == [8, 7, 6, -(2 * 8 + 1), -(5 * 8 + 1)]
    S.add(rows(spark, ["e4", "e5", "hot"]), 4, store)  # a batch that is within a merged one comes again
    S.add(rows(spark, ["e8", "e9", "hot"]), 8, store)
    assert stored(spark, store) == sorted(want)
    S.merge(spark, store, 9, at=3)
    assert [S.tier(p) for p in parts(spark, store)] == [1, 1, 1]
    S.merge(spark, store, 9, at=3)
    assert parts(spark, store) == [-(8 * 8 + 2)] and stored(spark, store) == sorted(want)
    assert S.read_all(spark, store, "merged", S.MERGED).select("batch_id").distinct().count() == 1  # marks of replaced batches are gone
    S.add(rows(spark, ["e0", "n1"], D1).unionByName(rows(spark, ["n2"], D2)).unionByName(rows(spark, ["n3"], None)), 9, store)
    S.add(rows(spark, ["n1", "n4"], D1).unionByName(rows(spark, ["n3"], None)), 10, store)
    assert stored(spark, store) == sorted([*want, "n1", "n2", "n3", "n4"])


@pytest.mark.parametrize("step", ["write_partitions", "_index", "mark", "remove"])
def test_a_merge_that_breaks_off_anywhere_loses_and_doubles_nothing(few, tmp_path, monkeypatch, step):
    spark, store = few, f"file://{tmp_path}/store"
    for b in range(3):
        S.add(rows(spark, [f"e{b}", "hot"]), b, store)
    want = ["e0", "e1", "e2", "hot"]
    own = S.write_partitions

    def broken(*a):
        if step != "mark" or a[1].endswith("/merged"):
            raise OSError("lost")
        own(*a)

    with monkeypatch.context() as m:
        m.setattr(S, "write_partitions" if step == "mark" else step, broken)
        with pytest.raises(OSError, match="lost"):
            S.merge(spark, store, 3, at=3)
    assert stored(spark, store) == want  # readers in between
    S.add(rows(spark, ["e1", "e3"]), 3, store)
    assert stored(spark, store) == [*want[:3], "e3", "hot"]
    S.merge(spark, store, 3, at=3)
    S.merge(spark, store, 3, at=3)
    assert parts(spark, store) == [3, -(2 * 8 + 1)] and stored(spark, store) == [*want[:3], "e3", "hot"]
    left = spark.read.schema(f"{SCHEMA}, batch_id long").parquet(f"{store}/events")
    assert sorted(r["event_id"] for r in left.collect()) == [*want[:3], "e3", "hot"]


def test_a_batch_opens_only_id_files_whose_filter_hits(few, tmp_path, monkeypatch):
    spark, store = few, f"file://{tmp_path}/store"
    for b in range(4):
        S.add(rows(spark, [f"b{b}-{k}" for k in range(50)]), b, store)
    opened, read = [], S.read_days
    monkeypatch.setattr(S, "read_days", lambda sp, st, table, schema, days: (opened.append((table, days)), read(sp, st, table, schema, days))[1])
    seen, new = [], S.E.new_events
    monkeypatch.setattr(S.E, "new_events", lambda incoming, known: (seen.append(known.select("batch_id").distinct().collect()), new(incoming, known))[1])
    S.add(rows(spark, ["b2-7", "fresh"]), 4, store)
    assert [r[0] for r in seen[0]] == [2]  # of four batches one
    assert ("ids", [D1]) in opened and S.read_events(spark, store, f"{SCHEMA}, batch_id long").count() == 201


def test_the_stream_merges_as_it_goes(few, tmp_path, monkeypatch):
    spark, store = few, f"file://{tmp_path}/store"
    monkeypatch.setattr(sinks, "MERGE_EVERY", 2)
    calls = []
    monkeypatch.setattr(S, "merge", lambda sp, st, before: calls.append(before))
    for b in range(4):
        sinks.store_events(rows(spark, [str(b)], (datetime(2026, 1, 1) + timedelta(days=b)).date()), b, store)
    assert calls == [1, 3]


def test_a_batch_is_told_apart_by_ids_and_its_whole_events_are_not_kept(few, tmp_path, monkeypatch):
    spark, store = few, f"file://{tmp_path}/store"
    kept, own = [], type(rows(spark, ["a"])).persist
    monkeypatch.setattr(type(rows(spark, ["a"])), "persist", lambda df, *a: kept.append(set(df.columns)) or own(df, *a))
    S.add(rows(spark, ["a", "b", "b"]), 0, store)
    for _ in range(2):
        S.add(rows(spark, ["b", "c", "c"]).unionByName(rows(spark, ["d"], None)), 1, store)
    assert kept == [{"day", "event_id"}] * 3 and stored(spark, store) == ["a", "b", "c", "d"]
    got = S.read_events(spark, store, f"{SCHEMA}, batch_id long")
    assert {(r["event_id"], r["batch_id"], r["summary"]) for r in got.collect()} == {("a", 0, "x" * 20), ("b", 0, "x" * 20), ("c", 1, "x" * 20), ("d", 1, "x" * 20)}


def test_duplicates_go_without_an_aggregate_of_all_columns(spark):
    from runscope.operators import events as E

    ev = rows(spark, ["a", "a", "b"]).unionByName(spark.createDataFrame([(None, D1, "n"), (None, D1, "n")], SCHEMA))
    out = E.dedupe(ev)
    assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(str(r["event_id"]) for r in out.collect()) == ["None", "a", "b"] and out.columns == ev.columns
