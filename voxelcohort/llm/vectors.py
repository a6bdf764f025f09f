"""Shared parts of the two vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for vectors with a length, only finite components and one that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def as_doubles(df: DataFrame, id: str, vector: str, *more: str) -> DataFrame:
    """Usable rows with a non-null integer id as ``(id long, dim int, vec array<double>)`` and the columns ``more``."""
    rows = df.filter(F.col(id).isNotNull() & usable(F.col(vector)))
    return rows.select(F.col(id).cast("long").alias("id"), F.size(vector).alias("dim"), F.col(vector).cast("array<double>").alias("vec"), *more)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def packed(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(x.tobytes())])


def unpacked(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The matrix again, in double precision."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)


def travels_as(df: DataFrame, vector: str) -> str:
    """Element type in which vectors are exchanged: float for float columns, which loses nothing, else double."""
    kind = df.schema[vector].dataType.elementType.simpleString()
    return "float" if kind == "float" else "double"


def units(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of one length, scaled to length one in double precision; by the largest component first, so that no square overflows or vanishes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.sqrt((x * x).sum(1))[:, None]


def by_dim(table: pa.Table | pa.RecordBatch) -> dict[int, np.ndarray]:
    """Row numbers of each vector length in a batch."""
    dims = table.column("dim").to_numpy(zero_copy_only=False)
    return {int(d): np.flatnonzero(dims == d) for d in np.unique(dims)}
