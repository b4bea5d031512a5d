import os
import subprocess
import sys
import threading

import pytest

from runscope.plans import layout
from runscope.session import exists, materialize, scratch, scratch_path

APPLICATION = """
import sys
from pyspark.sql import SparkSession
from runscope.plans.layout import by_session, PREFIX
here, keep = sys.argv[1], sys.argv[2] or None
conf = {"spark.master": "local[2]", "spark.sql.shuffle.partitions": "3", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": f"{here}/warehouse", "spark.checkpoint.dir": f"file://{here}/shared",
        "spark.hadoop.javax.jdo.option.ConnectionURL": f"jdbc:derby:{here}/metastore;create=true", "spark.driver.extraJavaOptions": f"-Dderby.system.home={here}"}
spark = SparkSession.builder.config(map=conf).enableHiveSupport().getOrCreate()
ev = spark.range(100).selectExpr("concat('s', id % 7) as session_id", "id as event_id")
left = [t.name for t in spark.catalog.listTables() if t.name.startswith(PREFIX)]
table = by_session(ev, store="same", keep=keep)
again = by_session(ev, store="same", keep=keep)
plan = table.groupBy("session_id").count()._jdf.queryExecution().executedPlan().toString()
print("SAID", len(left), table.count(), again.count(), table.selectExpr("sum(event_id)").first()[0], plan.count("Exchange"), len({f.rpartition("/")[0] for f in table.inputFiles()} | {f.rpartition("/")[0] for f in again.inputFiles()}), sorted(table.inputFiles())[0])
if len(sys.argv) > 3:
    spark.stop()  # before what is to be done at exit
"""


def application(here, keep="", *stop):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", APPLICATION, str(here), keep, *stop], env=os.environ | {"PYTHONPATH": root}, cwd=here, capture_output=True, text=True, timeout=300)
    said = [x for x in done.stdout.splitlines() if x.startswith("SAID")]
    assert said, done.stderr[-2000:]
    return said[0].split()[1:]


def test_two_applications_over_one_metastore_read_the_same_rows(tmp_path):
    runs = [application(tmp_path), application(tmp_path, "", "stop"), application(tmp_path)]
    assert [r[:6] for r in runs[:2]] == [["0", "100", "100", "4950", "0", "1"]] * 2  # nothing is left in the catalogue
    assert runs[2][1:6] == ["100", "100", "4950", "0", "1"]  # what a stopped session leaves does no harm
    assert len({r[6] for r in runs}) == 3


def test_files_that_are_kept_serve_the_next_application(tmp_path):
    keep = f"file://{tmp_path}/kept"
    one, two = application(tmp_path, keep), application(tmp_path, keep)
    assert one == two and two[0] == "0" and two[4] == "0" and "/kept/" in two[6]


def test_an_entry_without_files_is_written_anew(spark):
    ev = spark.range(50).selectExpr("concat('s', id % 3) as session_id", "id as event_id")
    table = layout.by_session(ev, store="gone")
    name = next(t.name for t in spark.catalog.listTables() if t.name.startswith(layout.PREFIX) and layout._location(spark, t.name) in table.inputFiles()[0].replace("file:///", "file:/"))
    where = spark._jvm.org.apache.hadoop.fs.Path(layout._location(spark, name))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    assert name in layout.drop_stale(spark)
    assert layout.by_session(ev, store="gone").count() == 50
    assert layout.by_session(ev.withColumn("more", ev["event_id"]), store="gone").columns[-1] == "more"  # another projection, another table


def test_scratch_leaves_the_tables_of_other_threads(spark):
    made, inside, go = {}, threading.Event(), threading.Event()

    def other():
        inside.wait(60)
        made["other"] = materialize(spark.range(5), "other")
        go.set()

    t = threading.Thread(target=other)
    t.start()
    with scratch(spark) as keep_outer:
        with scratch(spark) as keep:
            inside.set()
            go.wait(60)
            gone, kept = materialize(spark.range(3), "gone"), materialize(spark.range(4), "kept")
            keep(kept)
        assert kept.count() == 4 and not exists(spark, gone.inputFiles()[0])
        keep_outer(spark.range(1))
    t.join(60)
    assert made["other"].count() == 5
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        kept.count()  # it passed to the outer scope, which did not keep it
    assert "/runscope-" in scratch_path(spark, "x")


def test_files_of_a_written_table_follow_from_its_days(spark, tmp_path):
    from runscope.sources import sinks

    rows = spark.range(0, 4000, 1, 16).selectExpr("id", "date_add(date'2024-01-01', cast(id % 5 as int)) as day")
    for _ in range(2):
        sinks.write_table(rows, str(tmp_path / "t"), "first")
    assert len(list((tmp_path / "t").glob("day=*/batch_id=first/*.parquet"))) == 5 and spark.read.parquet(str(tmp_path / "t")).count() == 4000


@pytest.mark.parametrize("name", ["session_health", "reconciled"])
def test_a_query_writes_of_signals_markers_and_states_what_it_reads(spark, monkeypatch, name):
    from runscope.operators import events as E
    from runscope.operators import rules as G
    from runscope.plans import queries as Q

    seen, own, scans, life = {}, Q.materialize, [], G.lifecycle
    monkeypatch.setattr(Q, "materialize", lambda df, n: seen.update({n: df.columns}) or own(df, n))
    monkeypatch.setattr(G, "lifecycle", lambda ev, *a: scans.append(set(ev.columns)) or life(ev, *a))
    assert Q.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert seen["signals"] == ["session_id", "kind", "severity"] and seen["markers"] == ["session_id", "event_ts"]
    assert scans == [set(E.RULED)]  # states are found once, for the signals too


def test_status_of_rules_is_that_of_their_assessment(spark):
    from runscope.operators import assess as A
    from runscope.plans import queries as Q

    ev = Q.stored_events(spark, "/root/testdata/sf0.001")
    sig, marks, states = Q.found(ev, *Q.JUDGED, *Q.EXPLAINED)
    status = A.rule_status(states, sig.select(*Q.JUDGED), marks, ev)
    whole = A.rule_assessment(states, sig, marks, ev)
    key = lambda df: sorted(map(tuple, df.select(status.columns).collect()))
    assert key(status) == key(whole) and whole.where("size(concerns) > 0").count() and "__n" not in whole.columns


def test_rows_of_a_bucket_are_in_order_of_kind(spark, tmp_path):
    ev = spark.range(400).selectExpr("concat('s', id % 20) as session_id", "concat('k', id % 3) as kind", "id")
    for _ in range(2):  # written, then taken as kept files
        out = layout.by_session(ev, 2, store="kinds", keep=f"file://{tmp_path}/kept")
        files = out.select("_metadata.file_path").distinct().collect()
        assert len(files) == 2 and sorted(r["id"] for r in out.collect()) == list(range(400))
        for f in files:
            got = [(r["kind"], r["session_id"]) for r in spark.read.parquet(f[0]).collect()]
            assert got == sorted(got)
        spark.sql(f"DROP TABLE {[t.name for t in spark.catalog.listTables() if t.name.startswith(layout.PREFIX) and spark.table(t.name).columns == ev.columns][0]}")
