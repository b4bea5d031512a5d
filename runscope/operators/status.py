"""What an operator asks for: lists, details, pages, changes, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str = "session_id", order: str = "assessed_at") -> DataFrame:
    """The newest row of each key."""
    columns = F.struct(*[F.col(c) for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.max_by(columns, order).alias("__r")).select(key, "__r.*")


def active_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("state").isin("active_turn", "between_turns", "waiting"))


def list_sessions(sessions: DataFrame, attention: DataFrame) -> DataFrame:
    """Sessions with their attention, in no order; ``session_page`` gives them page by page."""
    return sessions.join(attention.select("session_id", "needs_attention", "max_severity"), "session_id", "left").fillna(False, ["needs_attention"])


def session_page(listed: DataFrame, n: int, after: tuple | None = None) -> DataFrame:
    """The first ``n`` sessions behind a key, by attention, then the latest first (unknown times last), then by id.

    ``after`` is (needs_attention, last_ts, session_id) of the last row of the page before;
    without it the first page.  Each task keeps ``n`` rows at most and only these are merged.
    """
    rows = listed
    if after is not None:
        urgent, last, session = after
        attention, at, name = F.col("needs_attention"), F.col("last_ts"), F.col("session_id")
        behind = at.isNull() & (name > session) if last is None else (at < F.lit(last)) | at.isNull() | ((at == F.lit(last)) & (name > session))
        rows = rows.where(((attention == urgent) & behind) | (~attention if urgent else F.lit(False)))
    return rows.orderBy(F.desc("needs_attention"), F.desc_nulls_last("last_ts"), "session_id").limit(n)


def session_detail(sessions: DataFrame, summary: DataFrame, assessments: DataFrame, session: str) -> DataFrame:
    own = lambda df: df.where(F.col("session_id") == session)
    return own(sessions).join(own(summary), "session_id", "left").join(latest(own(assessments)), "session_id", "left")


def current_assessment(assessments: DataFrame) -> DataFrame:
    return latest(assessments)


def changes_after(feed: DataFrame, after: int, order: str = "change_id") -> DataFrame:
    """The state-change feed beyond a reader's cursor."""
    return feed.where(F.col(order) > after).orderBy(order)


def drilldown(sessions: DataFrame, trace: DataFrame) -> DataFrame:
    """Sessions with the outside viewer's id where it knows them."""
    return sessions.join(trace.select("session_id", "trace_id"), "session_id", "left")


def admit_requests(requests: DataFrame, per_session: int, max_cost: float) -> DataFrame:
    """Requests with ``admitted``: each key once, at most ``per_session`` of a session, and a running cost within the budget.

    The budget is one sequence over all requests of a day: hourly sums come first,
    and only the sums run in one window.
    """
    once = requests.withColumn("__n", F.row_number().over(Window.partitionBy("idempotency_key").orderBy("requested_at", "session_id"))).where("__n = 1").drop("__n")
    once = once.withColumn("nth", F.row_number().over(Window.partitionBy("session_id").orderBy("requested_at", "idempotency_key")))
    fit = once.where(F.col("nth") <= per_session).withColumn("hour", F.date_trunc("hour", "requested_at"))
    before = fit.groupBy("hour").agg(F.sum("cost").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select("hour", "before")
    inside = F.sum("cost").over(Window.partitionBy("hour").orderBy("requested_at", "idempotency_key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spent = fit.withColumn("inside", inside).join(before, "hour").withColumn("spent", F.col("before") + F.col("inside"))
    return once.join(spent.select("idempotency_key", "spent"), "idempotency_key", "left").withColumn("admitted", F.coalesce(F.col("spent") <= max_cost, F.lit(False)))
