"""The event store: events once, by day and batch, with filters over their ids and merging of small batches.

Below a folder stand four tables, each partitioned by day and ``batch_id``: ``events``;
``ids``, their event ids, sorted; ``filters``, Bloom filters over these; ``merged``, which
batches a merged one replaces.  A batch opens the id files of its days whose filters
hit, no others.  A merged batch has a negative number and counts from the moment that its
row in ``merged`` is written, as what it replaces counts no more from then on; every step
can be repeated.  There is one writer, the stream's.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runscope.operators import events as E
from runscope.session import exists

#: Bits of a filter's bucket (the size of Spark's bitmaps); ids that a bucket is meant for; bits for an id.
BUCKET_BITS, BUCKET_IDS, HASHES = 32_768, 3_000, 3
#: Batches of one tier of a day that are merged into one of the next; tiers.
MERGE_AT, TIERS = 16, 8
IDS = "event_id string, day date, batch_id long"
FILTERS = "size int, bucket int, bits binary, day date, batch_id long"
MERGED = "old long, day date, batch_id long"
TABLES = ("events", "ids", "filters", "merged")


def _folder(store: str, table: str, day) -> str:
    return f"{store}/{table}/day={'__HIVE_DEFAULT_PARTITION__' if day is None else day}"


def _none(spark: SparkSession, schema) -> DataFrame:
    """A table without rows, which the planner knows to have none: what is joined with it starts no tasks."""
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    return spark.range(1).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def read_days(spark: SparkSession, store: str, table: str, schema, days: list) -> DataFrame:
    """A table's partitions of these days; the folders of no others are listed."""
    found = [p for d in days if exists(spark, p := _folder(store, table, d))]
    return spark.read.schema(schema).option("basePath", f"{store}/{table}").parquet(*found) if found else _none(spark, schema)


def read_all(spark: SparkSession, store: str, table: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{store}/{table}") if exists(spark, f"{store}/{table}") else _none(spark, schema)


def _join(a: DataFrame, b: DataFrame, *more: str, how: str = "inner", few: bool = False) -> DataFrame:
    """``a`` with the columns of ``b`` that has its day (null for null) and its columns ``more``; with ``few``, ``b`` has a bounded number of rows a day."""
    key = F.coalesce(F.col("day").cast("string"), F.lit("")).alias("__day")
    own = b.select("*", key).drop("day")
    return a.select("*", key).join(F.broadcast(own) if few else own, ["__day", *more], how).drop("__day")


def counted(table: DataFrame, merged: DataFrame) -> DataFrame:
    """The rows of a table that count: none of replaced batches, none of a merged one without its mark."""
    rest = _join(table, merged.select("day", F.col("old").alias("batch_id")).distinct(), "batch_id", how="left_anti", few=True)
    made = _join(rest.where("batch_id < 0"), merged.select("day", "batch_id").distinct(), "batch_id", how="left_semi", few=True)
    return rest.where("batch_id >= 0").unionByName(made).select(*table.columns)


def read_events(spark: SparkSession, store: str, schema) -> DataFrame:
    """The stored events, each once, also while batches are being merged."""
    return counted(read_all(spark, store, "events", schema), read_all(spark, store, "merged", MERGED))


def _bits(event_id: Column, size: Column) -> tuple[Column, list[Column]]:
    """The bucket of an id among ``size`` ones and its bits there: 15 bits of a hash for each, the rest for the bucket."""
    h = F.xxhash64(event_id)
    return F.pmod(F.shiftrightunsigned(h, 45), size).cast("int"), [F.shiftrightunsigned(h, 15 * k).bitwiseAND(F.lit(BUCKET_BITS - 1)) for k in range(HASHES)]


def filters_of(ids: DataFrame) -> DataFrame:
    """FILTERS of (day, batch_id, event_id): as many buckets as the ids of a day and batch need, a power of two."""
    n = ids.groupBy("day", "batch_id").agg(F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), F.count("*") / BUCKET_IDS)))).cast("int").alias("size"))
    sized = _join(ids, n, "batch_id")
    bucket, bits = _bits(F.col("event_id"), F.col("size"))
    each = sized.select("day", "batch_id", "size", bucket.alias("bucket"), F.explode(F.array(*bits)).alias("bit"))
    return each.groupBy("size", "bucket", "day", "batch_id").agg(F.bitmap_construct_agg("bit").alias("bits")).select("size", "bucket", "bits", "day", "batch_id")


def hit(ids: DataFrame, filters: DataFrame) -> DataFrame:
    """(day, batch_id) of the filters that may hold one of the ids (day, event_id)."""
    sizes = filters.select("day", "size").distinct()
    sized = _join(ids, sizes, few=True)
    bucket, bits = _bits(F.col("event_id"), F.col("size"))
    asked = sized.select("day", "size", bucket.alias("bucket"), *[b.alias(f"b{k}") for k, b in enumerate(bits)])
    byte = lambda b: F.conv(F.hex(F.substr("bits", (F.shiftright(b, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    on = F.lit(True)
    for k in range(HASHES):
        b = F.col(f"b{k}")
        on = on & (F.getbit(byte(b).cast("long"), b.bitwiseAND(F.lit(7)).cast("int")) == 1)
    return _join(asked, filters, "size", "bucket").where(on).select("day", "batch_id").distinct()


def write_partitions(df: DataFrame, path: str) -> None:
    """Rows as the partitions of their day and batch, which they replace."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(path)


def _index(spark: SparkSession, store: str, days: list, own: Column, schema) -> None:
    """Ids and filters of the partitions that ``own`` names."""
    ids = read_days(spark, store, "events", schema, days).where(own).select("event_id", "day", "batch_id")
    write_partitions(ids.hint("rebalance", "day", "batch_id").sortWithinPartitions("day", "batch_id", "event_id"), f"{store}/ids")
    write_partitions(filters_of(read_days(spark, store, "ids", IDS, days).where(own)), f"{store}/filters")


def add(ev: DataFrame, batch_id: int, store: str) -> None:
    """Adds the events of a batch that no other batch has stored, each once; the same batch again changes nothing.

    An event has the same time, so the same day, whenever it is read again: only the
    days of the batch are looked at.
    """
    spark = ev.sparkSession
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in ev.schema)}, batch_id long"
    ids = ev.select("day", "event_id").persist()  # whole events are many times as wide: they are made once, for the write
    days = [r["day"] for r in ids.select("day").distinct().collect()]  # the days of one micro-batch
    merged = read_days(spark, store, "merged", MERGED, days)
    others = counted(read_days(spark, store, "filters", FILTERS, days), merged).where(F.col("batch_id") != batch_id)
    parts = [(r["day"], r["batch_id"]) for r in hit(ids, others).collect()]
    ids.unpersist()
    stored = read_days(spark, store, "ids", IDS, sorted({d for d, _ in parts}, key=str)).where(_named(parts))
    fresh = E.new_events(E.dedupe(ev), stored).withColumn("batch_id", F.lit(batch_id).cast("long"))
    write_partitions(fresh, f"{store}/events")
    _index(spark, store, days, F.col("batch_id") == batch_id, schema)


def _named(parts: list[tuple]) -> Column:
    """The partitions of a list; none for an empty one."""
    by_day, out = defaultdict(list), F.lit(False)
    for day, batch in parts:
        by_day[day].append(batch)
    for day, batches in by_day.items():
        out = out | (F.col("day").eqNullSafe(F.lit(day).cast("date")) & F.col("batch_id").isin(batches))
    return out


def tier(batch_id: int) -> int:
    """How often a batch has been merged."""
    return -batch_id % TIERS if batch_id < 0 else 0


def _last(batch_id: int) -> int:
    """The newest batch within a merged one."""
    return -batch_id // TIERS if batch_id < 0 else batch_id


def merge(spark: SparkSession, store: str, before: int, at: int = MERGE_AT) -> list[tuple]:
    """Merges, on each day, the batches of a tier older than ``before`` once there are ``at`` of them; gives the (day, batch) that it replaced.

    A day so keeps at most ``at`` batches a tier, and an event is written once a tier.  What an
    earlier call left undone is done first.
    """
    merged = read_all(spark, store, "merged", MERGED).collect()  # a bounded number for each day
    marked, old = {(r["day"], r["batch_id"]) for r in merged}, {(r["day"], r["old"]) for r in merged}
    there = {(r["day"], r["batch_id"]) for r in read_all(spark, store, "filters", FILTERS).select("day", "batch_id").distinct().collect()}
    remove(spark, store, [p for p in there if p in old or (p[1] < 0 and p not in marked)])
    groups = defaultdict(list)
    for day, batch in there - old:
        if (batch >= 0 or (day, batch) in marked) and _last(batch) < before:
            groups[day, tier(batch)].append(batch)
    plan = [(day, b, -(max(map(_last, bs)) * TIERS + t + 1)) for (day, t), bs in groups.items() if len(bs) >= at and t + 1 < TIERS for b in bs]
    if not plan:
        return []
    names = spark.createDataFrame(plan, "day date, old long, new long")
    days = sorted({d for d, _, _ in plan}, key=str)
    schema = spark.read.parquet(f"{store}/events").schema
    ev = read_days(spark, store, "events", schema, days).where(_named([(d, b) for d, b, _ in plan])).withColumnRenamed("batch_id", "old")
    rows = _join(ev, names, "old", few=True).withColumnRenamed("new", "batch_id").select(*schema.names)
    write_partitions(rows.hint("rebalance", "day", "batch_id"), f"{store}/events")
    _index(spark, store, days, _named([(d, n) for d, _, n in plan]), schema)
    write_partitions(names.select("old", "day", F.col("new").alias("batch_id")).coalesce(1), f"{store}/merged")  # from here on
    done = [(d, b) for d, b, _ in plan]
    remove(spark, store, done)
    return done


def remove(spark: SparkSession, store: str, parts: list[tuple]) -> None:
    """Deletes what no reader counts any more."""
    for day, batch in parts:
        for table in TABLES:
            target = spark._jvm.org.apache.hadoop.fs.Path(f"{_folder(store, table, day)}/batch_id={batch}")
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
