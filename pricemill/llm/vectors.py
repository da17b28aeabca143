"""Columns of vectors as numpy matrices, and the length that the vectors of a table have."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F


def length_of(df: DataFrame, column: str) -> int:
    """The length that most vectors of ``column`` have, the longer one of two as frequent; 0 if there is none."""
    sizes = df.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("size")).count()
    row = sizes.where("size > 0").orderBy(F.desc("count"), F.desc("size")).first()
    return row["size"] if row else 0


def usable(column: pa.Array, length: int) -> np.ndarray:
    """Flags of the rows whose vector has ``length`` entries, all of them finite numbers."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), length), False).to_numpy(zero_copy_only=False).astype(bool)
    at = np.flatnonzero(fits)
    if len(at):
        entries = pc.list_flatten(column.take(pa.array(at)))
        fine = pc.fill_null(pc.is_finite(entries), False).to_numpy(zero_copy_only=False).reshape(len(at), length)
        fits[at] = fine.all(axis=1)
    return fits


def matrix(column: pa.Array, rows: np.ndarray, length: int) -> np.ndarray:
    """The vectors at ``rows`` (positions, all usable) in double precision."""
    taken = pc.list_flatten(column.take(pa.array(rows)))
    return taken.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), length)


def bytes_column(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * width
    made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])
    return made.cast(pa.binary())
