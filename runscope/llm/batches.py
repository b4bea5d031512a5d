"""Arrow batch helpers shared by the operators that run Python inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a function gets at once; Spark hands over more, up to a size in bytes.
BATCH_ROWS = 1000


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | list | None]], schema: T.StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` with a per-task set-up.

    ``make()`` runs once in each task and returns the function of a batch of at
    most ``rows`` rows; that function returns columns in the order of ``schema``
    (or None for no rows).
    """
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                cols = f(whole.slice(at, rows))
                if cols is not None:
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t) for c, t in zip(cols, arrow.types, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch, a null read as the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it differ from all columns (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
