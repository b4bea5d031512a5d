"""Exact top-k search by a Voronoi join: queries and data meet only where distance bounds allow it.

Rows belong to the cell of their nearest pivot.  Summaries of the cells (the
distances of a few inner rows) give each cell of queries a score that every one of
its queries reaches k times; a block of data reaches only the groups of queries
that its own distances to the pivot do not rule out, and is compared with them there.

With a pivot a of queries within r, a pivot b of data at distance t and D = |a - b|,
the triangle inequality holds |q - x| between max(0, D - r - t, t - D - r) and
D + r + t; and q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2, so that f = (|x|^2 - |q - x|^2) / 2
orders the candidates of a query as their scores do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runscope.llm.batches import map_batches, struct
from runscope.llm.intvectors import STEP, inner, integers, matrix, one_each, top
from runscope.llm.packing import pack, values
from runscope.session import materialize

#: Rows of a block, queries of a group, rows for each pivot, pivots of a vector length, lengths that have pivots (others have their origin).
BLOCK_ROWS, GROUP_ROWS, PIVOT_ROWS, PIVOTS, LENGTHS = 4096, 1024, 1024, 256, 8
#: Bytes of a length's pivots; bands of a factor of four in squared length.
PIVOT_BYTES, BANDS = 4 << 20, 32
#: Share of the numbers compared that rounding may be off.
SLACK = 1e-9
BLOCK = "block long, dim int, cell int, t_min double, t_max double, n_min double, n_max double, ids array<long>, v array<long>, t array<double>, n array<double>"
GROUP = "grp long, dim int, cells array<int>, ids array<long>, v array<long>"


def pivots_of(own: DataFrame, counts: dict[int, int]) -> dict[int, np.ndarray]:
    """For each vector length: different vectors of a bounded sample, like ones side by side."""
    out = {}
    for dim, n in counts.items():
        size = min(PIVOTS, max(1, n // PIVOT_ROWS), max(1, PIVOT_BYTES // (8 * dim)))
        rows = own.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(size).select("v").collect()
        left = np.unique(np.array([r["v"] for r in rows], float), axis=0)
        chain = [0]
        while len(chain) < len(left):
            far = ((left - left[chain[-1]]) ** 2).sum(axis=1)
            far[chain] = np.inf
            chain.append(int(far.argmin()))
        out[dim] = left[chain]
    return out


def assigned(own: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``own`` with the cell of each row's nearest pivot, its distance ``t``, its squared length ``n`` and the band of that."""

    def make():
        def cells(b: pa.RecordBatch) -> list:
            dims = b.column("dim").to_numpy()
            cell, t, n = np.zeros(len(dims), np.int32), np.zeros(len(dims)), np.zeros(len(dims))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = matrix(b.column("v").take(pa.array(at)), int(d)).astype(float)
                p = pivots.get(int(d), np.zeros((1, int(d))))
                n[at] = (x * x).sum(axis=1)
                near = (n[at][:, None] - 2 * x @ p.T + (p * p).sum(axis=1)).argmin(axis=1)
                cell[at], t[at] = near, np.sqrt(((x - p[near]) ** 2).sum(axis=1))
            band = np.minimum(np.log2(n + 1) / 2, BANDS - 1).astype(np.int32)
            return [b.column("vec_id"), b.column("dim"), b.column("v"), cell, t, n, band]

        return cells

    return map_batches(own, make, struct(*[(f.name, f.dataType) for f in own.schema.fields], ("cell", T.IntegerType()), ("t", T.DoubleType()), ("n", T.DoubleType()), ("band", T.IntegerType())))


def between(p: np.ndarray) -> np.ndarray:
    """The distances of pivots."""
    return np.sqrt(((p[:, None, :] - p[None, :, :]) ** 2).sum(axis=2)) if p.nbytes * len(p) < 1 << 28 else np.stack([np.sqrt(((p - x) ** 2).sum(axis=1)) for x in p])


def above(d: np.ndarray, r: np.ndarray, t_min, t_max, n_max) -> np.ndarray:
    """The largest f that rows at these distances of their pivot can have, for queries within ``r`` of a pivot at ``d``."""
    least = np.maximum(0, np.maximum(d - r - t_max, t_min - d - r))
    return (n_max - least * least) / 2 + SLACK * (n_max + (d + r + t_max) ** 2 + 1)


def thresholds(pivots: dict, radius: dict, inner_rows: dict, k: int) -> dict[tuple[int, int], float]:
    """For each cell of queries an f that at least ``k`` rows reach for each of its queries; -inf if there are not so many."""
    out = {}
    for (dim, cell), r in radius.items():
        p = pivots.get(dim, np.zeros((1, dim)))
        reached = []
        for (other, own), (t, n) in inner_rows.items():
            if other == dim:
                d = float(np.sqrt(((p[cell] - p[own]) ** 2).sum()))
                far = d + r + t
                reached.append((n - far * far) / 2 - SLACK * (n + far * far + 1))
        reached = np.sort(np.concatenate(reached))[::-1] if reached else np.zeros(0)
        out[dim, cell] = float(reached[k - 1]) if len(reached) >= k else -np.inf
    return out


def nearest(rows: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of largest inner product for each id where ``is_query`` (a condition on vec_id) holds.

    Components are floor(256 * x).  Highest scores first, ties to the smaller vec_id; no
    row of a query's own id is among them.  A query meets the vectors of its own length.
    What takes no part: see ``intvectors.integers``; of a query id with several vectors
    the smallest asks, as a candidate each of them counts.  Scores beyond a long are its
    limits.  An empty table gives no row; other columns are ignored.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    own = materialize(integers(rows, key, vector), "integers")
    counts = {r["dim"]: r["count"] for r in own.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()}
    total = own.count()
    pivots = pivots_of(own, counts)
    data = assigned(own, pivots)
    asked = materialize(assigned(one_each(own.where(is_query(F.col("vec_id")))), pivots), "asked")
    n_asked, repeats = asked.count(), own.where(is_query(F.col("vec_id"))).groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1

    def block(t: pa.Table) -> dict:
        far, n = t["t"].to_numpy(), t["n"].to_numpy()
        return {"dim": t["dim"][0], "cell": t["cell"][0], "t_min": far.min(), "t_max": far.max(), "n_min": n.min(), "n_max": n.max(), "ids": t["vec_id"].to_pylist(), "v": matrix(t["v"], t["dim"][0].as_py()).reshape(-1), "t": far, "n": n}

    def group(t: pa.Table) -> dict:
        return {"dim": t["dim"][0], "cells": t["cell"].to_pylist(), "ids": t["vec_id"].to_pylist(), "v": matrix(t["v"], t["dim"][0].as_py()).reshape(-1)}

    schema = lambda ddl: spark.createDataFrame([], ddl).schema
    blocks = materialize(pack(data, ["dim", "cell", "band", "t", "vec_id"], ["dim", "cell", "band"], block_rows, block, schema(BLOCK), total, cores), "blocks")
    groups = materialize(pack(asked, ["dim", "cell", "t", "vec_id"], ["dim"], group_rows, group, schema(GROUP), n_asked, cores), "groups")

    # summaries: the radius of each cell of queries; of each cell of data the k rows next to the pivot (and as many as a query's own)
    few = k + repeats
    cells = asked.groupBy("dim", "cell").agg(F.max("t").alias("r"))
    inside = blocks.select("dim", "cell", F.posexplode(F.arrays_zip(F.slice("t", 1, few).alias("t"), F.slice("n", 1, few).alias("n"))).alias("p", "x")).select("dim", "cell", "x.t", "x.n")
    first = F.row_number().over(Window.partitionBy("dim", "cell").orderBy("t", F.desc("n")))
    inside = inside.withColumn("at", first).where(F.col("at") <= few).groupBy("dim", "cell").agg(F.collect_list("t").alias("t"), F.collect_list("n").alias("n"))
    common = F.col("dim").isin(list(counts))  # lengths without pivots are few rows each, but their number has no bound: nothing is ruled out there
    radius = {(r["dim"], r["cell"]): r["r"] for r in cells.where(common).collect()}
    reach = thresholds(pivots, radius, {(r["dim"], r["cell"]): (np.array(r["t"]), np.array(r["n"])) for r in inside.where(common).collect()}, few)
    asking = {d: (np.array([c for (x, c) in radius if x == d]), np.array([r for (x, c), r in radius.items() if x == d]), np.array([reach[x, c] for (x, c) in radius if x == d])) for d in counts}
    apart = {d: between(p) for d, p in pivots.items()}

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block the cells of queries that it may concern."""
        for b in batches:
            out = []
            for x in b.to_pylist():
                if x["dim"] in asking:
                    c, r, least = asking[x["dim"]]
                    out.append(c[above(apart[x["dim"]][c, x["cell"]], r, x["t_min"], x["t_max"], x["n_max"]) >= least].tolist() if len(c) else [])
                else:
                    out.append([0])
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("dim"), pa.array(out, pa.list_(pa.int32()))], names=["block", "dim", "cells"])

    needed = blocks.select("block", "dim", "cell", "t_min", "t_max", "n_max").mapInArrow(allowed, "block long, dim int, cells array<int>")
    needed = needed.select("block", "dim", F.explode("cells").alias("cell"))
    who = groups.select("grp", "dim", F.explode(F.array_distinct("cells")).alias("cell"))
    pairs = needed.join(who, ["dim", "cell"]).groupBy("block", "grp").agg(F.collect_set("cell").alias("need"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                dim, cell = b.column("dim")[i].as_py(), b.column("cell")[i].as_py()
                need = values(b, "need", i)
                x, ids = values(b, "v", i).reshape(-1, dim), values(b, "ids", i)
                if dim in asking:  # rows that no cell's queries can want stay out
                    c, r, least = asking[dim]
                    r, least = (dict(zip(c.tolist(), a.tolist(), strict=True)) for a in (r, least))
                    r, least = (np.array([a[j] for j in need.tolist()])[:, None] for a in (r, least))
                    t = values(b, "t", i)
                    keep = (above(apart[dim][need, cell][:, None], r, t, t, values(b, "n", i)) >= least).any(axis=0)
                    x, ids = x[keep], ids[keep]
                mine = np.isin(values(b, "cells", i), need)
                q, names = values(b, "q", i).reshape(-1, dim)[mine], values(b, "names", i)[mine]
                for a in range(0, len(q), STEP):
                    score = inner(q[a : a + STEP], x)
                    rows, cols = top(score, names[a : a + STEP, None] != ids[None, :], ids, k)
                    yield pa.RecordBatch.from_arrays([pa.array(names[a + rows]), pa.array(ids[cols]), pa.array(score[rows, cols])], names=["query_id", "vec_id", "score"])

    tasks = max(1, min(blocks.count(), 20_000))
    asks = groups.select("grp", "cells", F.col("ids").alias("names"), F.col("v").alias("q"))
    met = pairs.join(asks, "grp").repartition(tasks, "block").join(blocks.select("block", "dim", "cell", "ids", "v", "t", "n"), "block")
    found = met.mapInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
