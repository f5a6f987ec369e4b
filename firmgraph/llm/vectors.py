"""Vectors as whole numbers, and rows of them as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed_point(vector: Column, scale: int, shift: int = 0) -> Column:
    """floor(scale * x) + shift of each component x, as array<long>; null for a null vector or one with a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale) + shift))


def padded(rows: DataFrame, dims: int, x: str = "x") -> DataFrame:
    """The vectors at one length: shorter ones with zeros behind."""
    return rows.withColumn(x, F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size(x))))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """(rows, dims) of a column of lists of that length each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def lists(values: np.ndarray) -> pa.Array:
    """A list for each row of a matrix."""
    n, m = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * m, m, dtype=np.int32)) if m else pa.array(np.zeros(n + 1, np.int32)), pa.array(values.ravel()))
