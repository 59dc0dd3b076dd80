"""Vectors as arrays of double."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Of length one; a zero vector stays zero."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, centroid: the unit vector of the mean of unit vectors, summed element by element with partial aggregation."""
    parts = df.where(F.col(vector).isNotNull()).select(key, F.posexplode(unit(F.col(vector))).alias("at", "x"))
    sums = parts.groupBy(key, "at").agg(F.sum("x").alias("x"))
    whole = sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("c"))
    return whole.select(key, unit(F.col("c")).alias("centroid"))


def padded(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow column of vectors as the rows of a matrix, filled up with zeros, and their lengths; -1 and zeros stand for
    a vector that is null or has null components."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.array(pc.fill_null(pc.list_value_length(column), -1), np.int64)
    n, flat = np.maximum(size, 0), column.flatten()
    row = np.repeat(np.arange(len(n)), n)
    out = np.zeros((len(n), int(n.max(initial=0))))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = flat.to_numpy(zero_copy_only=False)
    if flat.null_count:
        holed = row[np.array(flat.is_null())]
        out[holed], size[holed] = 0.0, -1
    return out, size


def arrays(column: pa.Array, kind: type) -> list[np.ndarray | None]:
    """An Arrow column of arrays, each as numbers of a kind, with NaN (0 in integers) for null components."""
    size, flat = np.array(pc.fill_null(pc.list_value_length(column), -1), np.int64), column.flatten()
    numbers = flat.to_numpy(zero_copy_only=False) if kind is np.float64 else flat.fill_null(0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(np.maximum(size, 0)).tolist()
    numbers = numbers.astype(kind)  # a copy, which does not keep the batch
    return [numbers[z - n : z] if n >= 0 else None for n, z in zip(size.tolist(), upto)]


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the rows of two matrices, summed in order of the components like dot()."""
    total = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for i in range(a.shape[1]):
            total += a[:, i] * b[:, i]
    return total


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of each row of a with each of b, summed like dots()."""
    total = np.zeros((len(a), len(b)))
    with np.errstate(all="ignore"):
        for i in range(a.shape[1]):
            total += a[:, i, None] * b[:, i]
    return total
