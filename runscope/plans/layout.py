"""The physical layout that the rules share."""

from __future__ import annotations

import contextlib
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runscope.session import exists, scratch_path

PREFIX = "runscope_events_"
#: To be raised when ``by_session`` writes its files in another way, so that kept ones are not taken for it.
LAYOUT = 2
#: Rows of a bucket are in order of these: most rules read one kind, and skip the pages of the others.
SORTED = ("kind", "session_id")


def _location(spark: SparkSession, name: str) -> str:
    return spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()["data_type"]


def _complete(spark: SparkSession, name: str) -> bool:
    """Whether a catalogue entry's files are there, to the last one."""
    return spark.catalog.tableExists(name) and exists(spark, f"{_location(spark, name)}/_SUCCESS")


def drop_stale(spark: SparkSession) -> list[str]:
    """Drops catalogue entries of layouts without files, which an application that was killed or stopped early leaves in a lasting catalogue."""
    gone = []
    for t in spark.catalog.listTables():
        if t.name.startswith(PREFIX):
            with contextlib.suppress(Exception):  # another application may drop it at the same time
                if not _complete(spark, t.name):
                    spark.sql(f"DROP TABLE IF EXISTS {t.name}")
                    gone.append(t.name)
    return gone


def by_session(ev: DataFrame, buckets: int | None = None, store: str | None = None, keep: str | None = None) -> DataFrame:
    """The events as a table bucketed by session, written once into the shared folder.

    Every rule partitions by session, alone or with more columns, so all of them
    read their own columns of this table without a shuffle of their own, and a lost
    executor costs the tasks that it ran.  With ``store``, a name of what ``ev``
    holds, a table made before for it in this application is read again; the table
    and its catalogue entry go when the driver ends, and an entry belongs to one
    application, whatever its catalogue.

    With ``keep`` as well, a folder, the files stay there for later applications: one
    that finds complete files of the same content, columns, buckets and LAYOUT takes
    them; whoever owns the folder removes them.
    """
    spark = ev.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    what = hashlib.sha256(f"{LAYOUT}/{n}/{store}/{ev.schema.json()}".encode()).hexdigest()[:16] if store else uuid.uuid4().hex[:16]
    name = PREFIX + hashlib.sha256(f"{spark.sparkContext.applicationId}/{keep}/{what}".encode()).hexdigest()[:16]
    if store and _complete(spark, name):
        return spark.table(name)
    drop_stale(spark)
    order = [c for c in SORTED if c in ev.columns]
    drop = lambda: spark.sql(f"DROP TABLE IF EXISTS {name}")
    spot = scratch_path(spark, name, drop)
    if keep and store:
        spot = f"{keep.rstrip('/')}/{what}"
        if exists(spark, f"{spot}/_SUCCESS"):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ev.schema)
            spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (session_id) SORTED BY ({", ".join(order)}) INTO {n} BUCKETS LOCATION '{spot}'")
            return spark.table(name)
    # the same hash deals rows to tasks and to buckets, so each task writes one file
    ev.repartition(n, "session_id").write.format("parquet").mode("overwrite").bucketBy(n, "session_id").sortBy(*order).option("path", spot).saveAsTable(name)
    return spark.table(name)


def state_of(table: DataFrame) -> str:
    """A name for what the files of a table hold now: their paths, sizes and times of change."""
    files = table.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    row = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("*").cast("decimal(20,0)")).alias("h")).first()
    return f"{row['n']}-{row['h']}"
