"""Near duplicates by SimHash fingerprints and a Gray-order hierarchical index.

Two fingerprints that differ in at most three of 64 bits agree in one of four
16-bit blocks.  Fingerprints with a block in common form a shard; a shard that
many share is cut again by the bits that remain (they differ in at most three
places too, so one of four parts agrees again), so no link is lost.  In a shard
the fingerprints are sorted by Gray rank, and a hierarchy of nodes over runs of
neighbours keeps the bits that all below share.  Pairs of nodes are followed
downwards while the differences of their shared bits stay within three.  A shard
gives a spanning forest, at most one edge for each fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runscope.llm.batches import fresh, map_batches, struct
from runscope.llm.components import components, one_row_each, placed
from runscope.session import materialize

SHINGLE_WORDS, SEED, RADIUS = 3, 42, 3
#: Fingerprints above which a shard is cut by further bits; children of a node; node pairs held at once.
SHARD_ROWS, FANOUT, PAIRS = 8192, 8, 1 << 20
#: Widths of the four parts at each level: 64 = 4 * 16, 48 = 4 * 12, 36 = 4 * 9.
WIDTHS = (16, 12, 9)


def shingle_hashes(text: str | None, width: int = SHINGLE_WORDS) -> list[int]:
    """Hashes of a whole text's word shingles; of all words together where they are fewer than ``width``."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) < width:
        return [xxh64_intdigest(joined, SEED)]
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return [xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)]


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """Of a whole text, unsigned; zero for a text without words."""
    return majority(shingle_hashes(text, width))


def majority(hashes: list[int]) -> int:
    """The bits set in over half of the hashes; zero without any."""
    if not hashes:
        return 0
    bits = np.zeros(64, np.int64)
    raw = np.array(hashes, "<u8")
    for k in range(0, len(raw), 1 << 14):
        bits += np.unpackbits(raw[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "fp") -> DataFrame:
    """The columns ``keep`` and the fingerprint as a signed long, called ``name``."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, T.LongType())])

    def make():
        def run(batch: pa.RecordBatch):
            fps = np.array([fingerprint(t) for t in batch.column(len(keep)).to_pylist()], np.uint64).view(np.int64)
            return [*[batch.column(k) for k in range(len(keep))], pa.array(fps)]

        return run

    return map_batches(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(fresh(list(keep), "text")[0])), make, schema)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each bit pattern in Gray order."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merges the classes of the linked places; each label is the smallest place of its class."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up


class GrayIndex:
    """Hierarchy over the fingerprints of several shards, each shard with a tree of its own."""

    def __init__(self, keys: np.ndarray, fps: np.ndarray):
        order = np.lexsort((gray_rank(fps), keys))
        self.fps, keys = fps[order], keys[order]
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        #: For each level, from the fingerprints upwards: first child of each node (and an end), shared ones, shared zeros, nodes of a shard.
        self.levels = [(None, self.fps, self.fps, np.append(begin, len(keys)))]
        while (np.diff(self.levels[-1][3]) > 1).any():
            _, both, either, bounds = self.levels[-1]
            sizes = -(-np.diff(bounds) // FANOUT)
            ends = np.cumsum(sizes)
            shard = np.repeat(np.arange(len(sizes)), sizes)
            first = bounds[:-1][shard] + (np.arange(ends[-1]) - (ends - sizes)[shard]) * FANOUT
            self.levels.append((np.append(first, bounds[-1]), np.bitwise_and.reduceat(both, first), np.bitwise_or.reduceat(either, first), np.append(0, ends)))

    def _near(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        _, both, either, _ = self.levels[level]
        fixed = ~(both[a] ^ either[a]) & ~(both[b] ^ either[b])
        return np.bitwise_count((both[a] ^ both[b]) & fixed) <= RADIUS

    def classes(self) -> np.ndarray:
        """For each fingerprint in Gray order, the first place of its class within its shard."""
        label = np.arange(len(self.fps))
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][1]))
        held = [(top, roots, roots)]
        while held:
            level, a, b = held.pop()
            if level == 0:
                link = (a != b) & (label[a] != label[b])
                link[link] = self._near(0, a[link], b[link])
                label = unite(label, a[link], b[link])
                continue
            if len(a) * FANOUT * FANOUT > PAIRS and len(a) > 1:
                half = len(a) // 2
                held += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            first = self.levels[level][0]
            na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
            n = na * nb
            pair = np.repeat(np.arange(len(a)), n)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            x, y = first[a][pair] + k // nb[pair], first[b][pair] + k % nb[pair]
            keep = x <= y
            x, y = x[keep], y[keep]
            if level == 1:
                keep = (x != y) & (label[x] != label[y])
            else:
                keep = self._near(level - 1, x, y)
            held.append((level - 1, x[keep], y[keep]))
        return label


def _shard_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard; a shard is complete once the next one begins."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def edges(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys):
            index = GrayIndex(keys, fps)
            label = index.classes()
            own = np.flatnonzero(label != np.arange(len(label)))
            if len(own):
                found = index.fps.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found[own]), pa.array(found[label[own]])], names=["u", "v"])

    for b in batches:
        if b.num_rows:
            keys = np.concatenate([keys, b.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            whole = int(np.searchsorted(keys, keys[-1])) if (keys[1:] >= keys[:-1]).all() else 0
            if whole >= 1 << 15:
                yield from edges(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
    yield from edges(keys, fps)


def _parts(width: int) -> Column:
    """The four parts of ``rest`` (4 * width bits) with what remains without each."""
    rest = F.col("rest")
    made = []
    for j in range(4):
        low = rest.bitwiseAND(F.lit((1 << width * j) - 1))
        high = F.shiftrightunsigned(rest, width * (j + 1)) if width * (j + 1) < 64 else F.lit(0).cast("long")
        part = F.shiftrightunsigned(rest, width * j).bitwiseAND(F.lit((1 << width) - 1))
        made.append(F.struct(F.xxhash64("key", F.lit(j), part).alias("key"), F.shiftleft(high, width * j).bitwiseOR(low).alias("rest")))
    return F.explode(F.array(*made))


def link_forest(fps: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (u, v) that join all fingerprints linked at RADIUS or fewer bits; ``fps`` has distinct ``fp``.

    Two shards that a hash of their key throws together are searched as one: that
    costs comparisons, never a link.
    """
    level = fps.select("fp", F.col("fp").alias("rest"), F.lit(0).cast("long").alias("key"))
    found = []
    for k, width in enumerate(WIDTHS):
        cut = level.select("fp", _parts(width).alias("p")).select("fp", "p.key", "p.rest")
        if k + 1 == len(WIDTHS):
            found.append(cut)
            break
        hot = materialize(cut.groupBy("key").count().where(F.col("count") > shard_rows).select("key"), "hot_shards")
        if hot.isEmpty():
            found.append(cut)
            break
        found.append(cut.join(hot, "key", "left_anti"))
        level = cut.join(hot, "key", "left_semi")
    edges = None
    for cut in found:
        rows = cut.select("key", "fp").repartition("key").sortWithinPartitions("key")
        made = rows.mapInArrow(_shard_edges, struct(("u", T.LongType()), ("v", T.LongType())))
        edges = made if edges is None else edges.unionByName(made)
    return edges


def _roots(fps: DataFrame) -> DataFrame:
    """(fp, root) for every fingerprint of ``fps`` (distinct ``fp``): the smallest one reachable over links."""
    roots = materialize(components(link_forest(fps)), "roots")
    return fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): near-duplicate groups of all documents.

    The component is the smallest doc_id reachable over links, itself included.  A
    null or empty text has fingerprint zero, linked like any other.  Repeated rows
    stay, each with the same component; a null doc_id never names a component
    unless the component has no other; an empty table gives no row; other columns
    are ignored.
    """
    own = materialize(fingerprints(docs, text), "fingerprints")
    first = own.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    classes = first.join(_roots(first.select("fp")), "fp")
    named = classes.join(classes.groupBy("root").agg(F.min("first_doc").alias("component_id")), "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    """Sixteen lowercase hex digits of a signed long."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each near-duplicate group, with all its columns.

    Rows are grouped by their own texts' fingerprints, so rows of one doc_id with
    unlike texts are of different groups.  Of a group the row with the smallest
    doc_id stays (a null id comes last), of equals the one with the smaller hash of
    its text, then of all columns; the order of the rows plays no part.  Texts
    without words are one group; an empty table gives no row.
    """
    fp, root, row, place = fresh(docs.columns, "fp", "root", "row", "place")
    made = placed(fingerprints(docs, text, tuple(docs.columns), fp), docs.columns, text, (row, place))
    own = materialize(made, "fingerprints")
    roots = _roots(own.select(F.col(fp).alias("fp")).distinct()).select(F.col("fp").alias(fp), F.col("root").alias(root))
    return one_row_each(own, own.select("doc_id", fp, row, place).join(roots, fp), root, (row, place), docs.columns)
