"""Helpers for tables of vectors: which rows take part, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(~bad, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def common_size(rows: DataFrame, vector: str = "vector") -> int:
    """The most frequent vector length (of several, the greatest); 0 for no rows."""
    top = (rows.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.desc("n"), F.desc("d")).first())
    return top["d"] if top else 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column without nulls as a float64 matrix with d columns."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), d)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products whose rounding doesn't depend on how many rows there are."""
    return (a * b).sum(1)
