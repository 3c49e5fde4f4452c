"""Look-ups inside array columns (C1, C4, C13, A7): the row stays whole.

A dictionary within the bounds of ``joins.checked_broadcast`` goes to every
worker once and is looked up for the elements of an Arrow list column, so
tokens are neither exploded nor collected again and nothing is shuffled.  A
larger dictionary is joined with the exploded elements, which are collected
again in order (``exploded`` in the callers); both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as Ty

from ..session import ship_package
from .joins import BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS, checked_copy

#: Elements of a list column that are looked up at a time (a longer row goes alone).
STEP = 1 << 20


@dataclass
class Dictionary:
    """A table written once to the shared folder, with the outcome of its size check."""

    table: DataFrame
    small: bool

    def arrays(self, *cols: str):
        """Broadcast of the columns as Arrow arrays; only for a small table.
        Rows with a null key (the first column) are left out."""
        got = self.table.select(*cols).dropna(subset=[cols[0]]).toArrow()
        return self.table.sparkSession.sparkContext.broadcast([c.combine_chunks() for c in got.columns])


def dictionary(table: DataFrame | Dictionary, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> Dictionary:
    """``table`` checked (a checked one as it is)."""
    return table if isinstance(table, Dictionary) else Dictionary(*checked_copy(table, max_rows, max_bytes))


def places_in(elements: pa.Array, keys: pa.Array) -> pa.Array:
    """Place of each element among the keys, null where there is none."""
    return pc.index_in(elements, value_set=keys.cast(elements.type))


def list_of(lengths: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)


def map_lists(docs: DataFrame, list_col: str, fields: list[Ty.StructField],
              made: Callable[[pa.RecordBatch, pa.Array, np.ndarray], list], drop: tuple = ()) -> DataFrame:
    """``docs`` without the columns ``drop``, and with the columns ``fields`` that
    ``made(rows, elements, lengths)`` gives for a slice of rows: the elements
    of their lists in one flat array, and each list's length (null list: 0)."""
    at = docs.columns.index(list_col)
    keep = [i for i, c in enumerate(docs.columns) if c not in drop]
    schema = Ty.StructType([docs.schema.fields[i] for i in keep] + fields)

    def run(batches):
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, start = np.cumsum(sizes), 0
            while start < len(sizes):
                done = ends[start] - sizes[start]
                end = max(start + 1, int(np.searchsorted(ends, done + STEP, "right")))
                rows = batch.slice(start, end - start)
                new = made(rows, rows.column(at).flatten(), sizes[start:end])
                yield pa.RecordBatch.from_arrays([rows.column(i) for i in keep] + new, schema.names)
                start = end

    ship_package(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def map_batches(df: DataFrame, schema: Ty.StructType, run: Callable) -> DataFrame:
    """``mapInArrow`` with this package's modules on the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)
