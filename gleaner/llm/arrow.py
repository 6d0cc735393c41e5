"""Arrow batches in and out of Python functions, in pieces of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from gleaner.functions.ship import ship

#: Bytes of text that one piece holds at most (one longer text is a piece of its own).
PIECE_BYTES = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` again, cut so that the column ``text`` of each piece stays below ``most`` bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; a null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def released() -> None:
    """Gives back to the system what Arrow and the C library hold of freed memory: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[Any]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with this package present on the executors; freed memory is given back when a task ends."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[Any]:
        yield from function(batches)
        released()

    return df.mapInArrow(run, schema)
