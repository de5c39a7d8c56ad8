"""Rows of a vector column as whole numbers, and Arrow batches of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds finite entries only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def of_one_size(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows whose vector has the size that most rows have (the greater of equals), and that size."""
    sizes = rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).first()
    d = sizes.d if sizes else 0
    return rows.where(F.size(vector) == d), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A column of lists of d numbers each as an array of (rows, d) doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)


def whole(m: np.ndarray, times: float, plus: int, most: int) -> np.ndarray:
    """floor(times * m) + plus as 64-bit integers; floors beyond +-most are put at that bound."""
    return np.clip(np.floor(times * m), -most, most).astype(np.int64) + plus
