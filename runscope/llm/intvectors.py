"""Vectors of integers in packed blocks: what the exact searches by inner product share.

A block is one row: some vectors that stand side by side in an order, their ids
and whatever bounds its maker adds.  Tasks compare a block with a group of queries
at once, and both are of bounded size, whatever the table's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries compared with a block at once.
STEP = 256
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def integers(rows: DataFrame, key: str, vector: str, *more) -> DataFrame:
    """(vec_id, dim, v, more...): each component x as floor(256 * x), at most the limits of a long.

    Rows without id, null and empty vectors, and those with a null or non-finite
    component (or one that is not finite when scaled) take no part; rows that are
    alike in id, vector and what else is kept count once.
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = rows.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("v"), *more).where(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    fine = fine.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * 256) < float("inf"))))
    kept = [c for c in fine.columns if c not in ("vec_id", "v")]
    return fine.select("vec_id", F.size("v").alias("dim"), F.transform("v", lambda c: F.floor(c * 256)).alias("v"), *kept).distinct()


def one_each(queries: DataFrame) -> DataFrame:
    """One row of each vec_id: the one with the smallest vector (then the smallest other columns)."""
    rest = [c for c in queries.columns if c not in ("vec_id", "v")]
    least = queries.groupBy("vec_id").agg(F.min(F.struct("v", *rest)).alias("r"))
    return least.select("vec_id", *[F.col(f"r.{c}").alias(c) for c in queries.columns if c != "vec_id"])


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The lists of a column as rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The inner products of the rows of two integer matrices, exactly; beyond a long they are its limits."""
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    if most < 2**63:
        return q @ x.T
    whole = q.astype(object) @ x.astype(object).T
    return np.array([[min(max(s, LEAST), MOST) for s in row] for row in whole], np.int64).reshape(len(q), len(x))


def top(scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` highest scores of each row where ``fits``; ties go to the smaller id."""
    n = scores.shape[1]
    if n > k:
        least = np.partition(np.where(fits, scores, LEAST), n - k, axis=1)[:, n - k]
        fits = fits & (scores >= least[:, None])
    r, c = np.nonzero(fits)
    order = np.lexsort((ids[c], ~scores[r, c], r))
    r, c = r[order], c[order]
    first = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[first], c[first]
