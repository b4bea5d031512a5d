"""Nearest neighbours by largest inner product over robust-pruned directed graphs.

Vectors are dealt to shards of a bounded size.  In a shard, nodes join a graph in
batches: a greedy search over what is there proposes neighbours, relaxed distance
pruning keeps edges to a diverse few of them, and each edge is offered back.  A
query runs a beam search in every shard; what the beams hold is scored exactly.
A shard holds vectors of about one length (within a factor of two), measured by
its longest; an extra coordinate then gives all of them length one, so that
nearness and inner product order alike, and no long vector elsewhere blurs the
differences.  Equal vectors are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from runscope.llm.packing import pack, values
from runscope.session import materialize

#: Nodes of a shard; edges of a node; beams of building and of queries; relaxation; nodes that join at once.
SHARD_NODES, DEGREE, BUILD_BEAM, QUERY_BEAM, ALPHA, BATCH = 4096, 32, 48, 128, 1.2, 256
#: Bytes of vectors and edges that a task may hold as a shard.
SHARD_BYTES = 32 << 20
#: Nodes expanded at each step of a search; entry nodes; queries searched together in a task.
WIDTH, ENTRIES, QUERY_BLOCK = 4, 16, 4096
FOUND = "query long, rep long, score double"
#: A shard in one row; a block of queries in one row.
GRAPH = "shard int, reps array<long>, v array<double>, edges array<int>, entries array<int>"
ASKED = "block long, names array<long>, q array<double>"


def search(x: np.ndarray, edges: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of each row of ``q``: (places, inner products), best first; place -1 where the beam is not full."""
    n, rows = len(x), len(q)
    stamp = np.full((rows, n), -1, np.int16)
    ids = np.full((rows, beam), -1, np.int64)
    near = np.full((rows, beam), -np.inf, np.float32)
    done = np.ones((rows, beam), bool)
    first = entries[:beam]
    ids[:, : len(first)], near[:, : len(first)], done[:, : len(first)] = first, q @ x[first].T, False
    order = np.argsort(-near, axis=1, kind="stable")
    ids, near, done = (np.take_along_axis(a, order, 1) for a in (ids, near, done))
    stamp[:, first] = 0
    live = np.arange(rows)
    lanes = np.arange(WIDTH * edges.shape[1], dtype=np.int16) + 1
    while len(live):
        left = ~done[live]
        open_ = left & (np.cumsum(left, axis=1) <= WIDTH)
        live = live[open_.any(axis=1)]
        if not len(live):
            break
        open_ = open_[open_.any(axis=1)]
        at = np.argsort(~open_, axis=1, kind="stable")[:, :WIDTH]
        real = np.take_along_axis(open_, at, 1)
        own = np.where(real, np.take_along_axis(ids[live], at, 1), -1)
        done[live] |= open_
        next_ = np.where(own[:, :, None] >= 0, edges[own], -1).reshape(len(live), -1)
        row = live[:, None]
        new = (next_ >= 0) & (stamp[row, next_] < 0)
        r, k = np.nonzero(new)
        stamp[live[r], next_[r, k]] = lanes[k]
        new[r, k] = stamp[live[r], next_[r, k]] == lanes[k]  # a place met twice in one step counts once
        r, k = np.nonzero(new)
        score = np.full(next_.shape, -np.inf, np.float32)
        score[r, k] = np.einsum("ij,ij->i", x[next_[r, k]], q[live[r]])
        both = np.concatenate([near[live], score], axis=1)
        order = np.argsort(-both, axis=1, kind="stable")[:, :beam]
        near[live] = np.take_along_axis(both, order, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(new, next_, -1)], axis=1), order, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~new], axis=1), order, 1)
    return ids, near


def prune(x: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Relaxed pruning: the nearest candidate stays, and drops those that it is ``alpha`` times nearer to than the node.

    Vectors have length one, distances are taken in double precision; -1 marks no candidate.
    """
    # a candidate that stands twice counts once
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    cand[cand == own[:, None]] = -1
    points = x[cand].astype(np.float64)
    far = np.where(cand >= 0, 1 - np.einsum("ikd,id->ik", points, x[own].astype(np.float64)), np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    cand, far, points = np.take_along_axis(cand, order, 1), np.take_along_axis(far, order, 1), np.take_along_axis(points, order[:, :, None], 1)
    between = 1 - np.matmul(points, points.transpose(0, 2, 1))
    alive = np.isfinite(far)
    out = np.full((len(own), degree), -1, np.int64)
    rows = np.arange(len(own))
    for k in range(degree):
        have = alive.any(axis=1)
        if not have.any():
            break
        best = alive.argmax(axis=1)
        out[have, k] = cand[rows, best][have]
        alive &= between[rows, best] * (alpha * alpha) > far  # squared distances; the chosen one goes too
        alive[rows, best] = False
    return out


def build(x: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entries) of a shard's graph over vectors of length one."""
    n = len(x)
    order = np.random.default_rng(seed).permutation(n)
    edges = np.full((n, DEGREE + DEGREE // 2), -1, np.int64)
    entries = order[:ENTRIES]
    edges[order[: min(n, ENTRIES)], : min(n, ENTRIES)] = entries[None, :]
    start = min(n, ENTRIES)
    at = start
    while at < n:
        own = order[at : at + min(BATCH, at)]
        at += len(own)
        found, _ = search(x, edges, entries, x[own], BUILD_BEAM)
        mates = np.argsort(-(x[own] @ x[own].T), axis=1)[:, :17]  # those that join together do not find each other
        kept = prune(x, own, np.concatenate([found, own[mates]], axis=1), DEGREE, ALPHA)
        edges[own, :DEGREE] = kept
        _offer_back(x, edges, own, kept)
    return edges, entries


def _offer_back(x: np.ndarray, edges: np.ndarray, own: np.ndarray, kept: np.ndarray) -> None:
    """Every edge's end gets an edge back; a node over its room is pruned again."""
    r, k = np.nonzero(kept >= 0)
    to, by = kept[r, k], own[r]
    new = ~(edges[to] == by[:, None]).any(axis=1)
    order = np.argsort(to[new], kind="stable")
    to, by = to[new][order], by[new][order]
    nodes, first, count = np.unique(to, return_index=True, return_counts=True)
    have = (edges[nodes] >= 0).sum(axis=1)
    room = edges.shape[1]
    rank = np.arange(len(to)) - np.repeat(first, count)
    fits = np.repeat(have + count <= room, count)
    edges[to[fits], (np.repeat(have, count) + rank)[fits]] = by[fits]
    full = np.flatnonzero(have + count > room)
    for k in range(0, len(full), BATCH):
        part = full[k : k + BATCH]
        most = int(count[part].max())
        more = np.full((len(part), most), -1, np.int64)
        for row, f in enumerate(part):
            more[row, : count[f]] = by[first[f] : first[f] + count[f]]
        kept = prune(x, nodes[part], np.concatenate([edges[nodes[part]], more], axis=1), DEGREE, ALPHA)
        edges[nodes[part]] = -1
        edges[nodes[part], :DEGREE] = kept


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Divided by the longest's length, with one more coordinate that gives every vector length one.

    Components are scaled by the largest first, so that no square overflows.
    """
    most = np.abs(vectors).max(initial=0.0)
    v = vectors / (most or 1.0)
    v /= max(float(np.sqrt((v * v).sum(axis=1)).max(initial=0.0)), np.finfo(float).tiny)
    return np.concatenate([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(axis=1)))[:, None]], axis=1).astype(np.float32)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Queries at length one, the added coordinate zero; the length of a query changes no order."""
    v = vectors / np.maximum(np.abs(vectors).max(axis=1, keepdims=True), np.finfo(float).tiny)
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.concatenate([v, np.zeros((len(v), 1))], axis=1).astype(np.float32)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    a = column.combine_chunks()
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1) if len(a) else np.zeros((0, 1))


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors of finite components, not all zero, of the length that most have (the longer of equals)."""
    v = F.col(vector).cast("array<double>")
    fine = rows.select(F.col(key).alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    fine = fine.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))
    common = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return fine.where(F.size("v") == (common["n"] if common else 0))


def _log2_length(v) -> Column:
    """The binary logarithm of a vector's length, without overflow."""
    most = F.array_max(F.transform(v, F.abs))
    return F.log2(most) + F.log2(F.aggregate(v, F.lit(0.0), lambda a, c: a + (c / most) * (c / most))) / 2


def nearest(rows: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", shard_nodes: int | None = None, beam: int = QUERY_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row where ``is_query`` (a condition on vec_id) holds.

    Every usable row is indexed and no row is its own neighbour.  Nearest first,
    ties to the smaller vec_id; fewer than ``k`` rows if there are no more
    candidates.  Null, zero and non-finite vectors, vectors of another length than
    most, and rows without id take no part; a repeated vec_id counts once for each
    vector; a score beyond double precision is infinite, and one of infinities that
    cancel comes last; an empty table gives no row; other columns are ignored.

    Shards have ``shard_nodes`` nodes at most; by default SHARD_NODES, more (up to what
    SHARD_BYTES hold) where there are several shards for every core, as a query visits
    every shard.
    """
    spark = rows.sparkSession
    own = materialize(usable(rows, key, vector).distinct(), "vectors")
    # The k + 1 smallest ids of a vector are all that can be among k neighbours; first by parts, so that a hot vector is spread.
    by = lambda *cols: F.row_number().over(Window.partitionBy(*cols).orderBy("vec_id"))
    few = own.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("n", by("v", "part")).where(F.col("n") <= k + 1)
    few = few.withColumn("n", by("v")).where(F.col("n") <= k + 1)
    classes = materialize(few.groupBy("v").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("members")), "classes")
    # shards by length: at most some 2,100 ranges of a factor of two, each dealt to as many shards as its vectors fill
    octave = F.floor(_log2_length(F.col("v"))).cast("int")
    sizes = {r["octave"]: (r["n"], r["d"]) for r in classes.groupBy(octave.alias("octave")).agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).collect()}
    if shard_nodes is None:
        room = SHARD_BYTES // (20 * max([d for _, d in sizes.values()], default=1) + 18 * DEGREE)
        shard_nodes = max(SHARD_NODES, min(room, sum(n for n, _ in sizes.values()) // (4 * spark.sparkContext.defaultParallelism)))
    ranges = {k: -(-n // shard_nodes) for k, (n, _) in sizes.items()}
    starts = dict(zip(sorted(ranges), np.cumsum([0, *[ranges[k] for k in sorted(ranges)]]).tolist(), strict=False))
    shards = max(1, sum(ranges.values()))
    place = F.create_map(*[F.lit(x) for k in starts for x in (k, F.array(F.lit(starts[k]), F.lit(ranges[k])))]) if starts else F.lit(None).cast("map<int,array<int>>")
    asked = own.where(is_query(F.col("vec_id")))
    # a vector that many queries share is searched once
    queries = materialize(asked.join(classes.select("v", "rep"), "v").select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query")), "queries")
    query_vectors = classes.join(queries.select(F.col("query").alias("rep")).distinct(), "rep", "left_semi").select(F.col("rep").alias("query"), "v")

    def grow(table: pa.Table) -> pa.Table:
        v = _matrix(table["v"])
        edges, entries = build(lifted(v))
        one = {"shard": table["shard"][0], "reps": table["rep"].to_numpy(), "v": v.reshape(-1), "edges": edges.astype(np.int32).reshape(-1), "entries": np.asarray(entries, np.int32)}
        return pa.table({n: pa.array([x], t) for (n, x), t in zip(one.items(), graph.types, strict=True)})

    graph = to_arrow_schema(T.StructType.fromDDL(GRAPH))
    own_range = place[octave]
    dealt = classes.select((own_range[0] + F.pmod(F.xxhash64("rep"), own_range[1])).cast("int").alias("shard"), "rep", "v")
    index = materialize(dealt.groupBy("shard").applyInArrow(grow, GRAPH), "graphs")
    packed = lambda t: {"names": t["query"].to_numpy(), "q": _matrix(t["v"]).reshape(-1)}
    rows = query_vectors.select("query", "v", F.size("v").alias("dim"))
    asked_blocks = materialize(pack(rows, ["dim", "query"], ["dim"], QUERY_BLOCK, packed, T.StructType.fromDDL(ASKED), queries.select("query").distinct().count(), spark.sparkContext.defaultParallelism), "query_blocks")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                reps, names = values(b, "reps", i), values(b, "names", i)
                v, q = values(b, "v", i).reshape(len(reps), -1), values(b, "q", i).reshape(len(names), -1)
                edges, entries = values(b, "edges", i).reshape(len(reps), -1).astype(np.int64), values(b, "entries", i).astype(np.int64)
                x = lifted(v)
                for a in range(0, len(q), BATCH):
                    part = q[a : a + BATCH]
                    ids, _ = search(x, edges, entries, unit(part), min(beam, max(len(x), ENTRIES)))
                    r, c = np.nonzero(ids >= 0)
                    with np.errstate(over="ignore", invalid="ignore"):
                        score = np.einsum("ij,ij->i", v[ids[r, c]], part[r])
                    score = np.where(np.isnan(score), -np.inf, score)  # sums of both infinities
                    order = np.lexsort((reps[ids[r, c]], -score, r))
                    rank = np.arange(len(r)) - np.searchsorted(r[order], r[order])
                    order = order[rank <= k]
                    yield pa.RecordBatch.from_arrays([pa.array(names[a + r[order]]), pa.array(reps[ids[r[order], c[order]]]), pa.array(score[order])], names=["query", "rep", "score"])

    # each block of queries goes to every shard, as the method says; a shard moves once, however many blocks there are
    everywhere = asked_blocks.select("names", "q", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    found = everywhere.repartition(min(shards, 20_000), "shard").join(index, "shard").mapInArrow(ask, FOUND)
    best = lambda *order: F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), *order))
    found = found.withColumn("n", best("rep")).where(F.col("n") <= k + 1).drop("n")
    listed = found.join(classes.select("rep", "members"), "rep").select("query", "score", F.explode("members").alias("vec_id"))
    listed = listed.withColumn("n", best("vec_id")).where(F.col("n") <= k + 1)
    lists = listed.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))
    each = queries.join(lists, "query").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return each.select("query_id", F.posexplode("near").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), "x.vec_id", "x.score")
