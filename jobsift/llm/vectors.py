"""Vector columns shared by the embedding operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def finite(v: Column) -> Column:
    """True where a vector is not null, not empty and all its components are
    numbers."""
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & sound, F.lit(False))


def usual_length(rows: DataFrame, col: str) -> int:
    """The commonest vector length (the smaller of two as common; 0 if there
    are no rows)."""
    most = rows.groupBy(F.size(col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return most["d"] if most else 0


def matrix(column: pa.ChunkedArray | pa.Array, kind: type = np.float64) -> np.ndarray:
    """A list column without nulls, all of one length, as a matrix."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return np.asarray(flat).astype(kind, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A matrix as a list column."""
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), kind))
