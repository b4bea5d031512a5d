"""Any number of literals in texts: secrets that were seeded, path prefixes, user names.

A bitmap of bounded size over the first few characters of all literals goes to every
task; a place of a text that it lets pass is looked up among the literals by a join.
The literals themselves are never broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runscope.session import materialize

#: Characters that stand for a literal (all of a shorter one); bits of the bitmap at most, for each literal, and of one of Spark's bitmaps.
ANCHOR, MOST_BITS, EACH_BITS, BUCKET = 8, 1 << 27, 64, 32_768
#: Texts of a task that are searched together, in characters.
STEP_CHARS = 1 << 20
#: Stands between texts; no character.
_GAP = 0x110000
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def strings(c: Column, kind: T.DataType) -> Column:
    """All texts within a column of any type, as an array; nested structs, arrays and maps included."""
    if isinstance(kind, T.StringType):
        return F.array(c)
    if isinstance(kind, T.StructType):
        parts = [strings(c[f.name], f.dataType) for f in kind.fields if _has_text(f.dataType)]
        return F.coalesce(F.concat(*[F.coalesce(p, _none()) for p in parts]), _none())
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(c, lambda x: F.coalesce(strings(x, kind.elementType), _none()))), _none())
    if isinstance(kind, T.MapType):
        sides = [(F.map_keys(c), kind.keyType), (F.map_values(c), kind.valueType)]
        return F.concat(*[strings(a, T.ArrayType(k)) for a, k in sides if _has_text(k)])
    return _none()


def _none() -> Column:
    return F.array().cast("array<string>")


def _has_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_text(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_text(kind.elementType)
    return _has_text(kind.keyType) or _has_text(kind.valueType) if isinstance(kind, T.MapType) else isinstance(kind, T.StringType)


def all_strings(rows: DataFrame, columns: list[str] | None = None) -> Column:
    """The texts of these columns (all, if not given)."""
    parts = [strings(F.col(f"`{f.name}`"), f.dataType) for f in rows.schema.fields if (columns is None or f.name in columns) and _has_text(f.dataType)]
    return F.concat(*parts) if parts else _none()


def _points(texts: list[str]) -> np.ndarray:
    """Code points of the texts, each followed by a gap."""
    out = [np.append(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4"), np.uint32(_GAP)) for t in texts]
    return np.concatenate(out).astype(np.uint64) if out else np.zeros(0, np.uint64)


def hashes(c: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` characters from each place on."""
    h = np.zeros(max(0, len(c) - size + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = h * _BASE + c[k : k + len(h)] + np.uint64(1)
        h ^= h >> np.uint64(29)
        return h * _MIX


def _bits(h: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash."""
    return (h >> np.uint64(5)) & np.uint64(m - 1), (h >> np.uint64(36)) & np.uint64(m - 1)


def anchored(literals: DataFrame, literal: str) -> DataFrame:
    """``literals`` with how many characters stand for each (``size``) and their hash ``h``; empty and null ones go."""
    own = literals.where(F.length(literal) > 0)
    at = own.columns.index(literal)
    schema = T.StructType([*own.schema.fields, T.StructField("size", T.IntegerType()), T.StructField("h", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t[:ANCHOR] for t in b.column(at).to_pylist()]
            h = [int(hashes(_points([t])[:-1], len(t)).view(np.int64)[0]) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(t) for t in texts], pa.int32()), pa.array(h, pa.int64())], names=schema.names)

    return own.mapInArrow(run, schema)


def find(rows: DataFrame, key: str, texts: Column, literals: DataFrame, literal: str = "literal") -> DataFrame:
    """(key, part, begin, before, after, and the columns of ``literals``): every place of every literal in ``texts`` of a row.

    ``texts`` is an array of texts, ``part`` the place in it, ``begin`` the character from 0;
    ``before`` and ``after`` are the characters around it, empty at the ends.  ``literals`` is
    read several times; null texts and empty literals hold and are nothing.
    """
    spark = rows.sparkSession
    known = materialize(anchored(literals, literal), "literals")
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.max(F.length(literal)), F.lit(0)).alias("longest")).first()
    lengths = [r["size"] for r in known.select("size").distinct().collect()]  # ANCHOR at most
    m = BUCKET
    while m < min(MOST_BITS, EACH_BITS * size["n"]):
        m *= 2
    spots = known.select(F.explode(F.array(F.shiftrightunsigned("h", 5).bitwiseAND(F.lit(m - 1)), F.shiftrightunsigned("h", 36).bitwiseAND(F.lit(m - 1)))).alias("bit"))
    maps = spots.groupBy(F.floor(F.col("bit") / BUCKET).alias("bucket")).agg(F.bitmap_construct_agg((F.col("bit") % BUCKET)).alias("bits"))
    bitmap = np.zeros(m // 8, np.uint8)
    for r in maps.toLocalIterator():  # MOST_BITS at most
        bitmap[r["bucket"] * BUCKET // 8 : (r["bucket"] + 1) * BUCKET // 8] = np.frombuffer(r["bits"], np.uint8)
    held = spark.sparkContext.broadcast(bitmap)
    longest = size["longest"]
    own = rows.select(F.col(key).alias("key"), texts.alias("texts"))
    schema = T.StructType([T.StructField("key", own.schema["key"].dataType), *[T.StructField(n, k) for n, k in (("part", T.IntegerType()), ("begin", T.IntegerType()), ("size", T.IntegerType()), ("h", T.LongType()), ("before", T.StringType()), ("rest", T.StringType()))]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = held.value
        on = lambda bit: (flags[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1

        def search(part: list[tuple]) -> Iterator[pa.RecordBatch]:
            starts = np.cumsum([0, *[len(t) + 1 for _, _, t in part]])[:-1]
            c = _points([t for _, _, t in part])
            for n in lengths:
                h = hashes(c, n)
                first, second = _bits(h, len(flags) * 8)
                at = np.flatnonzero(on(first))
                at = at[on(second[at])]
                which = np.searchsorted(starts, at, "right") - 1
                begin = at - starts[which]
                for k in range(0, len(at), 4096):
                    w, b = which[k : k + 4096].tolist(), begin[k : k + 4096].tolist()
                    cols = [[part[i][0] for i in w], [part[i][1] for i in w], b, [n] * len(w), h[at[k : k + 4096]].view(np.int64), [part[i][2][p - 1 : p] if p else "" for i, p in zip(w, b, strict=True)], [part[i][2][p : p + longest + 1] for i, p in zip(w, b, strict=True)]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=schema.names)

        kinds = [pa.int64() if isinstance(schema["key"].dataType, T.LongType) else pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            part, chars = [], 0
            for key_, texts_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, t in enumerate(texts_ or []):
                    if t:
                        part.append((key_, k, t))
                        chars += len(t)
                if chars > STEP_CHARS:
                    yield from search(part)
                    part, chars = [], 0
            if part:
                yield from search(part)

    met = own.mapInArrow(scan, schema).join(known, ["size", "h"]).where(F.startswith("rest", F.col(literal)))
    after = F.substr("rest", F.length(literal) + 1, F.lit(1))
    return met.select("key", "part", "begin", "before", after.alias("after"), *[c for c in known.columns if c not in ("size", "h")])


def holding(rows: DataFrame, literals: DataFrame, literal: str = "secret", columns: list[str] | None = None) -> DataFrame:
    """The rows with each literal that one of their texts holds (all text columns, nested ones too, if none are named), once for each."""
    numbered = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = find(numbered, "__row", all_strings(rows, columns), literals.select(literal).distinct(), literal)
    return numbered.join(found.select(F.col("key").alias("__row"), literal).distinct(), "__row").drop("__row")


def replaced(rows: DataFrame, column: str, literals: DataFrame) -> DataFrame:
    """``rows`` with every literal in a column replaced by ``[REDACTED:<class>]``; null stays null.

    ``literals`` has literal, class, and whether only whole words count (``whole``).  The
    leftmost place goes first, of several that begin there the longest literal, then the
    first class.
    """
    word = lambda c: F.rlike(c, F.lit("[A-Za-z0-9_]"))
    numbered = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = find(numbered, "__row", F.array(F.col(f"`{column}`")), literals.select("literal", "class", "whole").distinct())
    inside = (word(F.substr("literal", F.lit(1), F.lit(1))) & word(F.col("before"))) | (word(F.substr("literal", F.length("literal"), F.lit(1))) & word(F.col("after")))
    found = found.where(~(F.col("whole") & inside)).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("begin", (-F.length("literal")).alias("less"), "class"))).alias("__marks"))
    both = numbered.join(found.withColumnRenamed("key", "__row"), "__row", "left")
    names = rows.columns
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, marks in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                if marks:
                    parts, end = [], 0
                    for m in marks:
                        if m["begin"] >= end:
                            parts += [text[end : m["begin"]], f"[REDACTED:{m['class']}]"]
                            end = m["begin"] - m["less"]
                    text = "".join([*parts, text[end:]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at else b.column(k) for k in range(len(names))], names=names)

    return both.select(*[F.col(f"`{c}`") for c in names], "__marks").mapInArrow(run, rows.schema)
