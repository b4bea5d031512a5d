"""Hard negatives out of Hilbert-ordered blocks with zone maps.

Candidates stand along a Hilbert curve in blocks of a Parquet table; each block has
the smallest and largest value of every component and the labels that it holds.
Interval arithmetic over these gives the range of scores that an anchor can have with
a block's rows, and so the blocks that each of its windows must read.  A first round
reads for each window the blocks that promise most (the square root of their number);
what it finds there raises the window's lower end, which rules out more blocks, and most
rows of the others, for the second.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runscope.llm.batches import map_batches, struct
from runscope.llm.intvectors import LEAST, MOST, STEP, inner, integers, matrix, one_each, top
from runscope.llm.packing import pack, values
from runscope.session import materialize

#: Rows of a block, anchors of a group, blocks whose zone maps a task compares at once.
BLOCK_ROWS, GROUP_ROWS, CHUNK_BLOCKS = 1024, 512, 256
#: Rows that the directions of the curve are fitted on (they order the blocks and decide nothing else); directions and bits of each.
FIT_ROWS, DIRECTIONS, BITS = 10_000, 8, 8
#: Share of a bound that rounding may be off.
SLACK = 1e-9
BLOCK = "block long, dim int, ids array<long>, labels array<int>, v array<long>, lo array<long>, hi array<long>, has array<int>"
GROUP = "grp long, dim int, ids array<long>, labels array<int>, v array<long>"
#: A window: of which anchor (its place in the group), for which of its positives, lowest and highest score.
WINDOW = "grp long, at int, win long, lo long, hi long"
FOUND = "grp long, at int, win long, vec_id long, score long"


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """The places along a Hilbert curve of rows of integers below ``2 ** bits``, as signed longs in the same order.

    Each level's orthant is found in the frame that the levels above have turned; from the
    top, an unset bit swaps the low bits of a coordinate with those of the first, a set one
    flips the first's.  Gray codes of the orthants then give the place.
    """
    x = points.astype(np.uint64).copy()
    dims = x.shape[1]
    for b in range(bits - 1, 0, -1):
        low = np.uint64((1 << b) - 1)
        for d in range(dims):
            on = (x[:, d] >> np.uint64(b)) & np.uint64(1) == 1
            changed = np.where(on, low, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= changed
            x[:, d] ^= np.where(on, np.uint64(0), changed)
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, 0, -1):
        on = (x[:, -1] >> np.uint64(b)) & np.uint64(1) == 1
        flip ^= np.where(on, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= flip[:, None]
    place = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            place = (place << np.uint64(1)) | ((x[:, d] >> np.uint64(b)) & np.uint64(1))
    return (place ^ np.uint64(1 << 63)).view(np.int64) if dims * bits == 64 else place.view(np.int64)


def directions(own: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For the most frequent vector length of a bounded sample: its leading directions and the ranges along them."""
    rows = own.select("dim", "v").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(FIT_ROWS).collect()
    dims = [r["dim"] for r in rows]
    if not dims:
        return {}
    d = max(set(dims), key=lambda x: (dims.count(x), x))
    x = np.array([r["v"] for r in rows if r["dim"] == d], float)
    x /= np.abs(x).max() or 1
    _, axes = np.linalg.eigh(np.cov(x, rowvar=False).reshape(d, d) if len(x) > 1 else np.eye(d))
    axes = axes[:, ::-1][:, :DIRECTIONS]
    along = x @ axes
    return {d: (axes, along.min(axis=0), along.max(axis=0))}


def ordered(own: DataFrame, fitted: dict) -> DataFrame:
    """``own`` with each vector's place on the curve; vectors of other lengths than the fitted one all have place zero.

    A vector's direction alone counts (its largest component is made one), and what
    lies outside the fitted ranges is at their ends.
    """

    def make():
        def places(b: pa.RecordBatch) -> list:
            dims = b.column("dim").to_numpy()
            out = np.zeros(len(dims), np.int64)
            for d, (axes, low, high) in fitted.items():
                at = np.flatnonzero(dims == d)
                if len(at):
                    x = matrix(b.column("v").take(pa.array(at)), d).astype(float)
                    along = (x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1)) @ axes
                    scaled = np.clip((along - low) / np.maximum(high - low, 1e-12), 0, 1) * ((1 << BITS) - 1)
                    out[at] = hilbert(scaled.astype(np.uint64), BITS)
            return [*b.columns, out]

        return places

    return map_batches(own, make, struct(*[(f.name, f.dataType) for f in own.schema.fields], ("place", T.LongType())))


def ranges(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest inner product of each row of ``q`` with any vector within each box, rounding added."""
    q, lo, hi = q.astype(float), lo.astype(float), hi.astype(float)
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    off = SLACK * (np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T + 1)
    return plus @ lo.T + minus @ hi.T - off, plus @ hi.T + minus @ lo.T + off


class Mining:
    """Blocks of candidates and groups of anchors, and the reading of the anchors' windows."""

    def __init__(self, rows: DataFrame, is_anchor, label, key: str, vector: str, block_rows: int, group_rows: int):
        spark = rows.sparkSession
        self.cores = spark.sparkContext.defaultParallelism
        schema = lambda ddl: spark.createDataFrame([], ddl).schema
        own = materialize(integers(rows, key, vector, label.cast("int").alias("label")).where(F.col("label").isNotNull()), "integers")
        placed = ordered(own, directions(own))
        anchors = materialize(one_each(placed.where(is_anchor(F.col("vec_id")))), "anchors")

        def block(t: pa.Table) -> dict:
            x = matrix(t["v"], t["dim"][0].as_py())
            labels = t["label"].to_numpy()
            return {"dim": t["dim"][0], "ids": t["vec_id"].to_pylist(), "labels": labels, "v": x.reshape(-1), "lo": x.min(axis=0), "hi": x.max(axis=0), "has": np.unique(labels)}

        def group(t: pa.Table) -> dict:
            return {"dim": t["dim"][0], "ids": t["vec_id"].to_pylist(), "labels": t["label"].to_numpy(), "v": matrix(t["v"], t["dim"][0].as_py()).reshape(-1)}

        order = ["dim", "place", "vec_id", "label"]
        self.blocks = materialize(pack(placed, order, ["dim"], block_rows, block, schema(BLOCK), own.count(), self.cores), "blocks")
        self.groups = materialize(pack(anchors, order, ["dim"], group_rows, group, schema(GROUP), anchors.count(), self.cores), "anchor_groups")
        n = self.blocks.count()
        self.tasks, self.first = max(1, min(n, 20_000)), max(1, round(n**0.5))
        # zone maps in chunks; every group meets every chunk in one of as many buckets as groups are dealt to
        self.buckets = max(1, min(self.groups.count(), 4 * self.cores))
        chunk = F.floor(F.row_number().over(Window.partitionBy("dim", "part").orderBy("block")) / CHUNK_BLOCKS)
        zones = self.blocks.select("block", "dim", "lo", "hi", "has", F.shiftright("block", 32).alias("part")).withColumn("chunk", chunk)
        zones = zones.groupBy("dim", "part", "chunk").agg(F.collect_list(F.struct("block", "lo", "hi", "has")).alias("zones"))
        self.zones = materialize(zones.select("dim", "zones"), "zones").select("dim", "zones", F.explode(F.sequence(F.lit(0), F.lit(self.buckets - 1))).alias("bucket"))

    def asking(self, windows: DataFrame) -> DataFrame:
        """The groups of anchors that have windows, with them."""
        own = windows.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("at", "win", "lo", "hi"))).alias("w"))
        return self.groups.join(own.select("grp", *[F.col(f"w.{n}").alias(f"w_{n}") for n in ("at", "win", "lo", "hi")]), "grp")

    def _promising(self, asks: DataFrame, same: bool, most_of: int = 0) -> DataFrame:
        """(block, grp, need): the windows of a group, by number, that each block may hold rows for; with ``most_of``, for each window so many of the blocks that promise most."""
        each = F.pmod(F.xxhash64("grp"), F.lit(self.buckets)).cast("int").alias("bucket")
        met = asks.select("grp", "dim", "labels", "v", "w_at", "w_lo", "w_hi", each).join(self.zones, ["dim", "bucket"])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    dim = b.column("dim")[i].as_py()
                    zones, at = b.column("zones")[i].values, values(b, "w_at", i)
                    names = zones.field("block").to_numpy()
                    least, most = ranges(values(b, "v", i).reshape(-1, dim), matrix(zones.field("lo"), dim), matrix(zones.field("hi"), dim))
                    lo, hi = values(b, "w_lo", i), values(b, "w_hi", i)
                    has, labels = zones.field("has").to_pylist(), values(b, "labels", i)
                    kinds, kind = np.unique(labels, return_inverse=True)
                    holds = np.array([[(k in h) if same else (len(h) > 1 or h[0] != k) for h in has] for k in kinds.tolist()]).reshape(len(kinds), len(has))[kind]
                    fits = holds[at] & (most[at] >= lo[:, None]) & (least[at] <= hi[:, None])
                    promise = np.where(fits, np.minimum(most[at], hi[:, None].astype(float)), -np.inf)
                    if 0 < most_of < promise.shape[1]:
                        least_of = np.partition(promise, -most_of, axis=1)[:, -most_of]
                        fits &= promise >= least_of[:, None]
                    w, blocks = np.nonzero(fits)
                    promise = promise[w, blocks]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), b.column("grp")[i].as_py())), pa.array(names[blocks]), pa.array(w.astype(np.int32)), pa.array(promise)], names=["grp", "block", "w", "promise"])

        found = met.mapInArrow(compare, "grp long, block long, w int, promise double")
        if most_of:
            best = F.row_number().over(Window.partitionBy("grp", "w").orderBy(F.desc("promise"), "block"))
            found = found.withColumn("rank", best).where(F.col("rank") <= most_of)
        return found.groupBy("block", "grp").agg(F.collect_list("w").alias("need"))

    def _read(self, asks: DataFrame, pairs: DataFrame, k: int, same: bool) -> DataFrame:
        """FOUND: the ``k`` best rows of each window within the blocks it reads, over all of them."""
        asks = asks.select("grp", F.col("ids").alias("anchors"), F.col("labels").alias("own"), F.col("v").alias("q"), "w_at", "w_win", "w_lo", "w_hi")
        met = pairs.join(asks, "grp").repartition(self.tasks, "block").join(self.blocks.select("block", "dim", "ids", "labels", "v"), "block")

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    dim, need = b.column("dim")[i].as_py(), np.sort(values(b, "need", i))
                    x, ids, labels = values(b, "v", i).reshape(-1, dim), values(b, "ids", i), values(b, "labels", i)
                    q, own, names = values(b, "q", i).reshape(-1, dim), values(b, "own", i), values(b, "anchors", i)
                    w_at, w_win, w_lo, w_hi = (values(b, c, i)[need] for c in ("w_at", "w_win", "w_lo", "w_hi"))
                    for a in range(0, len(need), STEP):
                        at = w_at[a : a + STEP]
                        who, place = np.unique(at, return_inverse=True)
                        score = inner(q[who], x)[place]
                        fits = (labels[None, :] == own[at][:, None]) == same
                        fits &= (score >= w_lo[a : a + STEP, None]) & (score <= w_hi[a : a + STEP, None]) & (ids[None, :] != names[at][:, None])
                        r, c = top(score, fits, ids, k)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), b.column("grp")[i].as_py())), pa.array(at[r]), pa.array(w_win[a + r]), pa.array(ids[c]), pa.array(score[r, c])], names=["grp", "at", "win", "vec_id", "score"])

        found = met.mapInArrow(read, FOUND)
        rank = F.row_number().over(Window.partitionBy("grp", "at", "win").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    def best(self, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """The first ``k`` rows of each window (WINDOW): of the anchor's label or of any other, best first, with their ``rank``."""
        asks = self.asking(windows)
        first = self._read(asks, self._promising(asks, same, self.first), k, same)
        reached = materialize(first.where(F.col("rank") == k).select("grp", "at", "win", F.col("score").alias("raised")), "reached")
        raised = windows.join(reached, ["grp", "at", "win"], "left").withColumn("lo", F.greatest("lo", F.coalesce("raised", "lo"))).drop("raised")
        asks = materialize(self.asking(raised), "asking")
        return self._read(asks, self._promising(asks, same), k, same)


def mine(rows: DataFrame, is_anchor, label: Column, positives: int = 5, negatives: int = 10, low: int = 3, high: int = 9, key: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components are floor(256 * x), scores inner products; higher ones come first, ties by
    smaller vec_id.  Anchors are the ids where ``is_anchor`` (a condition on vec_id) holds;
    their positives the first ``positives`` other rows of the same ``label``; for each the
    first ``negatives`` rows of another label whose score is between ``low`` and ``high``
    tenths of the positive's.  A positive without such rows gives none.

    Rows with a null label and what ``intvectors.integers`` leaves out take no part; rows
    alike in id, vector and label count once; of an anchor id with several the smallest
    asks.  An anchor meets the vectors of its own length; scores beyond a long are its
    limits.  An empty table gives no row; other columns are ignored.
    """
    m = Mining(rows, is_anchor, label, key, vector, block_rows, group_rows)
    every = m.groups.select("grp", F.posexplode("ids").alias("at", "id")).select("grp", "at", F.lit(-1).cast("long").alias("win"), F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi"))
    near = m.best(every, positives, same=True).select("grp", "at", F.col("rank").cast("long").alias("win"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = materialize(near, "positives")
    tenth = F.col("positive_score").cast("decimal(20,0)")
    edges = near.select("grp", "at", "win", F.ceil(tenth * low / 10).cast("long").alias("lo"), F.floor(tenth * high / 10).cast("long").alias("hi"))
    found = m.best(materialize(edges.where("lo <= hi"), "windows"), negatives, same=False)
    anchors = m.groups.select("grp", F.posexplode("ids").alias("at", "anchor_id"))
    whole = found.join(near, ["grp", "at", "win"]).join(anchors, ["grp", "at"])
    return whole.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
