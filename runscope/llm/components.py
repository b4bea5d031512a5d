"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runscope.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")  # the small star drops what repeats


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v longs); the root is the smallest node reachable.

    Each round is written to the shared folder, so that lineage stays short and a
    lost executor costs a task.  The loop ends when a round changes nothing.
    """
    now = materialize(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark = None
    while True:
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if (row["n"], row["h"]) == mark or not row["n"]:
            break
        mark = (row["n"], row["h"])
        now = materialize(_small_star(_large_star(now)), "edges")
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def placed(rows: DataFrame, columns: list[str], text: str, names: tuple[str, str]) -> DataFrame:
    """``rows`` with a number for each row and its place among rows of one doc_id, called ``names``: the columns that ``one_row_each`` needs in a written table."""
    nested = (T.MapType, T.StructType, T.ArrayType)
    all_of = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if isinstance(rows.schema[c].dataType, nested) else F.col(f"`{c}`") for c in columns])
    return rows.withColumn(names[0], F.monotonically_increasing_id()).withColumn(names[1], F.array(F.xxhash64(F.col(f"`{text}`")), all_of))


def one_row_each(table: DataFrame, groups: DataFrame, group: str, names: tuple[str, str], columns: list[str]) -> DataFrame:
    """The columns ``columns`` of one row of each ``group``.

    ``table`` is a written table with the columns of ``placed``; ``groups`` has its
    doc_id, these and ``group`` for every row.  It is the row with the smallest doc_id,
    a null id coming last; of equals the one with the smaller hash of its text, then of
    all its columns.  The order of the rows plays no part: what ties beyond that is
    alike in every column.  Only small columns are grouped; whole rows move once.
    """
    row, place = names
    best = groups.groupBy(group).agg(F.min(F.struct(F.isnull("doc_id"), F.col("doc_id"), F.col(place), F.col(row))).alias("p")).select(F.col(f"p.{row}").alias(row))
    return table.join(best, row, "left_semi").select(*[F.col(f"`{c}`") for c in columns])
