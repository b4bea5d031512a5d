"""Idempotent tables behind a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runscope.operators import events as E
from runscope.sources import event_store


def read_store(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stored table, empty where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def write_batch(df: DataFrame, batch_id: int | str, path: str, by: tuple[str, ...] = ()) -> None:
    """A batch as partitions of its own: writing it again replaces them, so a retried batch leaves no second copy.

    Rows are dealt by ``by`` first, so that the files of a partition follow from its size and not from the number of tasks.
    """
    df = df.hint("rebalance", *by) if by else df
    df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch_id").parquet(path)


#: Batches after which small ones of a day are merged.
MERGE_EVERY = 16


def store_events(ev: DataFrame, batch_id: int, store: str) -> None:
    """Events that no other batch has stored, each once (see ``event_store``)."""
    event_store.add(ev, batch_id, store)
    if batch_id % MERGE_EVERY == MERGE_EVERY - 1:
        event_store.merge(ev.sparkSession, store, batch_id)


def store_logs(lines: DataFrame, batch_id: int, path: str) -> DataFrame:
    """(source_path, session_id) of the batch's logs, from this batch's metadata records or an earlier one's, which are stored."""
    write_batch(E.log_sessions(lines), batch_id, path)
    stored = read_store(lines.sparkSession, path, "source_path string, session_id string, batch_id long")
    own = stored.join(lines.select("source_path").distinct(), "source_path", "left_semi")
    return own.groupBy("source_path").agg(F.min_by("session_id", "batch_id").alias("session_id"))


def ingest(lines: DataFrame, store: str, checkpoint: str, mapping: dict | None = None, **normal):
    """The writer of a stream of raw lines: events once, invalid lines and unknown types apart, the cursor in the checkpoint."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        _, bad = E.quarantine(batch)
        ev = E.normalize(batch, mapping, logs=store_logs(batch, batch_id, f"{store}/logs"), **normal)
        store_events(ev, batch_id, store)
        write_batch(bad, batch_id, f"{store}/quarantine")
        write_batch(E.unknown_types(ev), batch_id, f"{store}/unknown_types")
        batch.unpersist()

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def write_table(df: DataFrame, path: str, write_id: int | str, by: str = "day") -> None:
    """Signals, assessments, calls or sessions, partitioned by day; the same ``write_id`` written again replaces what it wrote on these days."""
    write_batch(df, write_id, path, (by,))
