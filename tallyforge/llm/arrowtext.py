"""Running a text function over Arrow batches of a frame with bounded memory."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

#: Rows are handed on in pieces of about this much text, so that neither results nor
#: intermediate arrays grow with the size of an Arrow batch.
PIECE_BYTES = 4_000_000


def release() -> None:
    """Give memory of ended work back to the system, as Python workers outlive their tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def pieces(column: pa.ChunkedArray | pa.Array, lists: bool = True) -> Iterator[tuple[int, list | pa.Array]]:
    """(offset, values) slices of a string or binary column of about PIECE_BYTES each, as lists or in Arrow."""
    at, n = 0, len(column)
    while at < n:
        size, end = 0, at
        while end < n and (end == at or size < PIECE_BYTES):
            value = column[end]
            size += 16 + (len(value.as_buffer()) if value.is_valid else 0)
            end += 1
        part = column.slice(at, end - at)
        yield at, part.to_pylist() if lists else part
        at = end


def map_column(
    df: DataFrame,
    column: str,
    new: T.StructType,
    make: Callable[[], Callable[[list], Iterable[pa.Array]]],
    carry: list[str],
    lists: bool = True,
) -> DataFrame:
    """``carry`` columns of ``df`` with the columns ``new`` computed from ``column``.

    ``make`` runs once a task and returns a function from a list of values (None for null) to one
    Arrow array for each field of ``new``. Each input row gives one output row. Without ``lists``
    the function is given Arrow arrays.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    # a carried column that is also read goes to Python once
    width = len(carry)
    place = carry.index(column) if column in carry else width
    source = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(carry)], *([df[column].alias("v")] if place == width else []))
    schema = T.StructType(
        [T.StructField(c, df.schema[c].dataType) for c in carry] + [T.StructField(f.name, f.dataType) for f in new]
    )
    arrow = to_arrow_schema(T.StructType(list(new)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            values = batch.column(place)
            for at, part in pieces(values, lists):
                kept = [batch.column(i).slice(at, len(part)) for i in range(width)]
                made = [a.cast(f.type) if a.type != f.type else a for a, f in zip(compute(part), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(kept + made, names=schema.names)
            del batch, values
        del compute
        release()

    return source.mapInArrow(run, schema)
