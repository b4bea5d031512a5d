"""Packed blocks: stretches of an ordered table as one row each, of bounded size, for tasks that compare blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a packing task, so that most blocks are full ones.
PACK_ROWS = 1 << 16


def values(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    """The list that stands in a row of a batch."""
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def pack(rows: DataFrame, order: list[str], alike: list[str], size: int | Callable[[tuple], int], make: Callable[[pa.Table], dict], schema: T.StructType, count: int, cores: int, full_rows: int = 1024) -> DataFrame:
    """One row for each stretch of at most ``size`` rows in the order given, all alike in the integer columns ``alike``.

    ``make`` gets the stretch and gives the columns of ``schema`` but for the first
    one, a number that no other stretch has.  ``count`` is the number of rows;
    ``size`` may depend on the values of ``alike``.
    """
    room = size if callable(size) else lambda _: size
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, None

        def row(table: pa.Table) -> pa.RecordBatch:
            nonlocal made
            made += 1
            found = {schema[0].name: (part << 32) + made} | make(table)
            return pa.RecordBatch.from_arrays([pa.array([found[f.name]], f.type) for f in arrow], schema=arrow)

        for b in batches:
            new = pa.Table.from_batches([b])
            held = new if held is None else pa.concat_tables([held, new])
            keys = np.stack([held[c].to_numpy() for c in alike], axis=1)
            ends, at = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, 0
            for z in [*ends.tolist(), len(keys)]:
                full = room(tuple(keys[z - 1].tolist())) if z else 1
                while at < z and (z < len(keys) or z - at >= full):
                    step = min(full, z - at)
                    yield row(held.slice(at, step).combine_chunks())
                    at += step
            held = held.slice(at).combine_chunks() if at < held.num_rows else None
        if held is not None and held.num_rows:
            yield row(held)

    tasks = max(1, -(-count // PACK_ROWS), min(cores, -(-count // full_rows)))
    placed = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return placed.coalesce(tasks).mapInArrow(run, schema)
