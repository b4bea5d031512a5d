"""Running values over sessions of any size.

A window over a session runs in one task.  ``segmented`` cuts sessions with many rows by
time and deals the segments to tasks; the functions here then compute a value within
each segment, what each segment carries over to the next ones (a few numbers for each
segment and key), and add the two.  Rows without segments get the plain window, so the
rules are written once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runscope.session import materialize

ORDER = ("event_ts", "source_path", "source_offset")
SEGMENT, HOT = "__segment", "__hot"
#: Rows of a segment, about; segments of a session at most, the steps that its times are told apart by.
SEGMENT_ROWS, STEPS = 100_000, 1024


def columns(rows: DataFrame) -> list[str]:
    """The columns that tell the segment, if there are any."""
    return [c for c in (SEGMENT, HOT) if c in rows.columns]


def segmented(rows: DataFrame, size: int = SEGMENT_ROWS, at: str = "event_ts") -> DataFrame:
    """``rows`` with the segment of each, and whether its session has several; dealt to tasks by session and segment.

    Sessions of more than ``size`` rows are cut at quantiles of the time ``at``; rows of one
    time are in one segment, those without a time in the first.  The cuts are written, so
    that a task that is run again finds the same ones.
    """
    when = F.unix_micros(at)
    many = rows.groupBy("session_id").agg(F.count("*").alias("__n")).where(F.col("__n") > size)
    steps = [k / STEPS for k in range(1, STEPS)]
    cuts = rows.select("session_id", when.alias("__at")).join(many, "session_id").groupBy("session_id").agg(F.percentile_approx("__at", steps, 4 * STEPS).alias("__q"), F.first("__n").alias("__n"))
    parts = F.least(F.ceil(F.col("__n") / size), F.lit(STEPS)).cast("int")
    places = F.transform(F.sequence(F.lit(1), parts - 1), lambda k: F.element_at("__q", F.greatest(F.lit(1), (k * STEPS / parts).cast("int"))))
    cuts = materialize(cuts.select("session_id", F.array_distinct(places).alias("__cuts")), "segment_cuts")
    out = rows.join(cuts, "session_id", "left")
    segment = F.coalesce(F.size(F.filter("__cuts", lambda c: c <= when)), F.lit(0))
    return out.select(*[rows[c] for c in rows.columns], F.when(F.col("__cuts").isNull(), 0).otherwise(segment).alias(SEGMENT), F.col("__cuts").isNotNull().alias(HOT)).repartition("session_id", SEGMENT)


def _within(by: Sequence[str], order: Sequence, rows: DataFrame) -> Window:
    return Window.partitionBy("session_id", *([SEGMENT] if SEGMENT in rows.columns else []), *by).orderBy(*order)


def _carried(rows: DataFrame, by: Sequence[str], each: Column, over) -> DataFrame:
    """For each segment and key of a large session, ``over`` of what the segments before it have as ``each``."""
    own = rows.where(HOT).groupBy("session_id", SEGMENT, *by).agg(each.alias("__each"))
    before = Window.partitionBy("session_id", *by).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("__carry", over(F.col("__each")).over(before)).where(F.col("__carry").isNotNull()).drop("__each")


def _with_carry(rows: DataFrame, carried: DataFrame, by: Sequence[str], name: str, value: Column) -> DataFrame:
    keys = ["session_id", SEGMENT, *by]
    c = carried.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__carry")
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"__k{i}") if k in ("session_id", SEGMENT) else F.col(k).eqNullSafe(F.col(f"__k{i}")))
    return rows.join(c, on, "left").withColumn(name, value).drop("__own", "__carry", *[f"__k{i}" for i in range(len(keys))])


def running(rows: DataFrame, name: str, value: Column, *by: str, of=F.sum, order: Sequence = ORDER) -> DataFrame:
    """Adds ``of`` (``F.sum`` or ``F.max``) of ``value`` over all rows of the session and key up to each row."""
    w = _within(by, order, rows).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if SEGMENT not in rows.columns:
        return rows.withColumn(name, of(value).over(w))
    both = {F.sum: lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), F.max: F.greatest}[of]
    return _with_carry(rows.withColumn("__own", of(value).over(w)), _carried(rows, by, of(value), of), by, name, both(F.col("__own"), F.col("__carry")))


def previous(rows: DataFrame, name: str, value: Column, *by: str, order: Sequence = ORDER) -> DataFrame:
    """Adds ``value``, which must not be null (a struct of what may be), of the row before in the session and key; null for the first."""
    own = F.lag(value).over(_within(by, order, rows))
    if SEGMENT not in rows.columns:
        return rows.withColumn(name, own)
    last = lambda c: F.last(c, ignorenulls=True)
    return _with_carry(rows.withColumn("__own", own), _carried(rows, by, F.max_by(value, F.struct(*order)), last), by, name, F.coalesce("__own", "__carry"))


def latest(rows: DataFrame, name: str, value: Column, *by: str, order: Sequence = ORDER) -> DataFrame:
    """Adds the last ``value`` that is not null, of the rows of the session and key up to each row."""
    last = lambda c: F.last(c, ignorenulls=True)
    own = last(value).over(_within(by, order, rows).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if SEGMENT not in rows.columns:
        return rows.withColumn(name, own)
    each = F.max(F.when(value.isNotNull(), F.struct(*order, value.alias("__v"))))["__v"]
    return _with_carry(rows.withColumn("__own", own), _carried(rows, by, each, last), by, name, F.coalesce("__own", "__carry"))
