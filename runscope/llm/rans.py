"""Token-id files coded by a static range asymmetric numeral system.

One frequency table, counted over all documents, is shared by every block.  A
block holds whole documents and is decoded by itself: its ids are dealt to
interleaved lanes, each an entropy coder of its own, and at regular rows all lane
states and the place in the word stream are kept as checkpoints, so that the
stretches between them are decoded side by side.  Checksums cover the words and
the ids.

Files: ``<path>/table`` (id, frequency) and ``<path>/blocks/shard=<n>`` with one
row for each block, ascending by document id over shards, files and rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runscope.llm.batches import map_batches, struct, texts_of
from runscope.session import materialize

#: Frequencies sum to 2**PRECISION; ids of a block, lanes, and rows between checkpoints.
PRECISION, BLOCK_IDS, LANES, CHECKPOINT_ROWS = 18, 1 << 18, 512, 128
#: Blocks that a task decodes at once.
READ_BLOCKS = 4
#: Characters of a text that tell shards apart where ids are equal.
PREFIX = 64
LOW = np.uint64(1 << 31)
_32, _M, _MASK = np.uint64(32), np.uint64(PRECISION), np.uint64((1 << PRECISION) - 1)


class CorruptBlock(ValueError):
    """A checksum of a block does not fit."""


def scale(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Frequencies that sum to 2**precision, at least 1 for every id that occurs."""
    total, size = int(counts.sum()), 1 << precision
    used = np.flatnonzero(counts)
    if len(used) > size:
        raise ValueError("more distinct ids than the table has slots")
    out = np.zeros(len(counts), np.int64)
    if not total:
        return out
    out[used] = np.maximum(1, counts[used].astype(np.float64) * (size - len(used)) / total).astype(np.int64)
    rest = size - int(out.sum())
    order = used[np.argsort(-counts[used], kind="stable")]
    k = 0
    while rest:
        step = rest if rest > 0 else max(rest, 1 - int(out[order[k]]))
        out[order[k]] += step
        rest -= step
        k += 1
    return out


class Table:
    """The shared tables of coder and decoder."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if len(freq) else self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT_ROWS) -> dict:
        n = len(ids)
        lanes = max(1, min(lanes, n))
        rows = -(-n // lanes)
        x = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        sizes = np.zeros(rows, np.int64)
        states = []
        for t in range(rows - 1, -1, -1):
            s = ids[t * lanes : (t + 1) * lanes]
            f, c, y = self.freq[s], self.cum[s], x[: len(s)]
            full = y >= f << np.uint64(63 - PRECISION)
            out = y[full].astype(np.uint32)
            words.append(out)
            sizes[t] = len(out)
            y = np.where(full, y >> _32, y)
            q = y // f
            x[: len(s)] = (q << _M) + (y - q * f) + c
            if t % every == 0:
                states.append(x.copy())
        at = np.concatenate([[0], np.cumsum(sizes)])[: rows : every] if rows else np.zeros(0, np.int64)
        stream = np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b""
        return {"n_ids": n, "lanes": lanes, "every": every, "states": np.array(states[::-1], "<u8").tobytes(), "word_at": at.astype("<i8").tobytes(), "words": stream, "words_crc": zlib.crc32(stream), "ids_crc": zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())}

    def decode(self, b: dict, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of checkpoint stretches ``first`` to ``last`` (all by default), side by side."""
        n, lanes, every = b["n_ids"], b["lanes"], b["every"]
        if zlib.crc32(b["words"]) != b["words_crc"]:
            raise CorruptBlock("the words of a block were changed")
        rows = -(-n // lanes)
        stretches = -(-rows // every)
        last = stretches if last is None else min(last, stretches)
        if first >= last:
            return np.zeros(0, np.uint32)
        words = np.append(np.frombuffer(b["words"], "<u4"), np.uint32(0)).astype(np.uint64)
        x = np.frombuffer(b["states"], "<u8").reshape(stretches, lanes)[first:last].copy()
        at = np.frombuffer(b["word_at"], "<i8")[first:last].copy()
        out = np.zeros((last - first, every, lanes), np.uint32)
        begin = (np.arange(first, last) * every)[:, None] * lanes + np.arange(lanes)[None, :]
        for t in range(min(every, rows - first * every)):
            live = begin + t * lanes < n
            slot = x & _MASK
            s = self.symbol[slot]
            out[:, t] = s
            y = self.freq[s] * (x >> _M) + slot - self.cum[s]
            need = (y < LOW) & live
            rank = np.cumsum(need, axis=1)
            y = np.where(need, y << _32 | words[np.where(need, at[:, None] + rank - 1, len(words) - 1)], y)
            x = np.where(live, y, x)
            at += rank[:, -1]
        ids = out.reshape(-1)[: min(n, last * every * lanes) - first * every * lanes]
        if first == 0 and last == stretches and zlib.crc32(ids.astype("<u4").tobytes()) != b["ids_crc"]:
            raise CorruptBlock("the ids of a block differ from those written")
        return ids


BLOCKS = struct(
    ("shard", T.IntegerType()), ("start", T.LongType()), ("doc_ids", T.ArrayType(T.LongType())), ("lengths", T.ArrayType(T.IntegerType())),
    ("n_ids", T.LongType()), ("lanes", T.IntegerType()), ("every", T.IntegerType()), ("states", T.BinaryType()), ("word_at", T.BinaryType()), ("words", T.BinaryType()), ("words_crc", T.LongType()), ("ids_crc", T.LongType()),
)
TOKENS = struct(("shard", T.IntegerType()), ("offset", T.LongType()), ("doc_id", T.LongType()), ("ids", T.BinaryType()), ("wide", T.BooleanType()))


def _hot_ids(rows: DataFrame, shards: int) -> list[int | None]:
    """Ids with more rows than half a shard holds: fewer than two for each shard."""
    total = rows.count()
    return [r["doc_id"] for r in rows.groupBy("doc_id").count().where(F.col("count") * (2 * shards) > max(total, 2 * shards)).collect()]


def tokenize_in_order(docs: DataFrame, encode: Callable[[], Callable[[str], bytes]], end_id: int = 1, shards: int | None = None) -> DataFrame:
    """Range-partitions by ``doc_id`` and tokenizes: one row for each document with its place in its shard.

    ``encode()`` gives a function from a text to little-endian 32-bit ids; the end id
    follows each document.  Rows of one doc_id are ordered by their texts and may lie
    in several shards, so a repeated or null id is no hot shard; only its rows with the
    same first PREFIX characters and more stay together.
    """
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hot = _hot_ids(rows, shards)
    # only ids with more rows than half a shard need more than themselves; short texts are told apart by their row too: equal ones may be parted
    is_hot = F.lit(False)
    if hot:
        is_hot = F.coalesce(F.col("doc_id").isin([i for i in hot if i is not None]), F.lit(None in hot))
    beyond = F.when(F.length("text") > PREFIX, (1 << 63) - 1).otherwise(F.monotonically_increasing_id())
    rows = rows.select("doc_id", "text", F.when(is_hot, F.substring("text", 1, PREFIX)).alias("prefix"), F.when(is_hot, beyond).alias("beyond"))
    keys = ("doc_id", "prefix", "beyond") if hot else ("doc_id",)
    ordered = rows.repartitionByRange(shards, *keys).sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def make():
        code, shard, offset = encode(), TaskContext.get().partitionId(), 0

        def run(batch: pa.RecordBatch):
            nonlocal offset
            ids, wide, offsets = [], [], []
            for text in texts_of(batch, "text"):
                a = np.frombuffer(code(text) + end, "<u4")
                offsets.append(offset)
                offset += len(a)
                wide.append(bool(a.max() > 0xFFFF))
                ids.append((a if wide[-1] else a.astype("<u2")).tobytes())
            return [np.full(len(ids), shard, np.int32), offsets, batch.column(0), ids, wide]

        return run

    return map_batches(ordered, make, TOKENS)


def _ids(raw: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if wide else "<u2").astype(np.uint32)


def count_ids(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents; each task adds up its own ids before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            ids = [_ids(r, w) for r, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            if ids:
                n = np.bincount(np.concatenate(ids))
                if len(n) < len(total):
                    n = np.pad(n, (0, len(total) - len(n)))
                n[: len(total)] += total
                total = n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    return tokens.select("ids", "wide").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _table_of(rows: list) -> np.ndarray:
    counts = np.zeros(max([r[0] for r in rows], default=-1) + 1, np.int64)
    for i, n in rows:
        counts[i] = n
    return counts


def write(tokens: DataFrame, path: str, block_ids: int = BLOCK_IDS) -> None:
    """Writes ``tokens`` (see tokenize_in_order; read twice, so a written table) as token-id files.

    A document without ids, an empty table and ids beyond 16 bits are written like
    any other; a document of more than BLOCK_IDS ids is a block by itself.
    The table's counts come to the driver: at most one row for each vocabulary
    entry, 2**18 or fewer.  So do the shards' totals, one row each.
    """
    spark = tokens.sparkSession
    freq = scale(_table_of(count_ids(tokens).collect()))
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "id long, freq long").coalesce(1).write.parquet(f"{path}/table")
    base, total = {}, 0
    sizes = F.octet_length("ids") / F.when(F.col("wide"), 4).otherwise(2)
    for r in tokens.groupBy("shard").agg(F.sum(sizes.cast("long")).alias("n")).orderBy("shard").collect():
        base[r["shard"]], total = total, total + r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq)
        held: list[tuple] = []
        size = 0

        def flush():
            ids = np.concatenate([h[2] for h in held])
            row = {"shard": held[0][0], "start": base[held[0][0]] + held[0][3], "doc_ids": [h[1] for h in held], "lengths": [len(h[2]) for h in held]} | table.encode(ids)
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for b in batches:
            for shard, offset, doc, raw, wide in zip(*[b.column(k).to_pylist() for k in range(5)], strict=True):
                ids = _ids(raw, wide)
                if held and (held[0][0] != shard or held[-1][3] + len(held[-1][2]) != offset or size + len(ids) > block_ids):
                    yield flush()
                    size = 0
                held.append((shard, doc, ids, offset))
                size += len(ids)
        if held:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(BLOCKS)
    tokens.mapInArrow(run, BLOCKS).withColumn("shard", F.format_string("%07d", "shard")).sortWithinPartitions("shard", "start").write.partitionBy("shard").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, what: Callable[[np.ndarray], object], kind: T.DataType, name: str) -> DataFrame:
    """Decodes every block: (doc_id, start, n_tokens, <name>) with ``what(ids)`` for each document.

    A task holds READ_BLOCKS blocks at once.  A block whose words or ids do not fit
    their checksums raises CorruptBlock; files without a block give no row.
    """
    table_rows = spark.read.parquet(f"{path}/table").collect()  # one row for each vocabulary entry at most
    freq = _table_of([(r["id"], r["freq"]) for r in table_rows])
    schema = struct(("doc_id", T.LongType()), ("start", T.LongType()), ("n_tokens", T.LongType()), (name, kind))
    if not table_rows:
        return spark.createDataFrame([], schema)

    def make():
        table = Table(freq)

        def run(batch: pa.RecordBatch):
            docs, starts, sizes, values = [], [], [], []
            for b in batch.to_pylist():
                ids = table.decode(b)
                ends = np.cumsum(b["lengths"])
                begins = ends - b["lengths"]
                docs += b["doc_ids"]
                starts += (b["start"] + begins).tolist()
                sizes += b["lengths"]
                values += [what(ids[i:j]) for i, j in zip(begins, ends, strict=True)]
            return [docs, starts, sizes, values]

        return run

    return map_batches(spark.read.parquet(f"{path}/blocks").drop("shard").select(*[f.name for f in BLOCKS if f.name != "shard"]), make, schema, READ_BLOCKS)


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def token_files(docs: DataFrame, encode: Callable[[], Callable[[str], bytes]], path: str, end_id: int = 1) -> DataFrame:
    """Tokenizes ``docs`` into files at ``path`` and reads them back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text has the end id alone; repeated doc_ids stay separate
    rows in the order of their texts; a null doc_id comes first; an empty table
    gives empty files and no row; other columns are ignored.
    """
    tokens = materialize(tokenize_in_order(docs, encode, end_id), "tokens")
    write(tokens, path)
    return read(docs.sparkSession, path, crc_of, T.LongType(), "ids_crc32")
