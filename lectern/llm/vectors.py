"""Shared helpers for operators on embedding columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """True for vectors that have a direction: no null, no null or non-finite part, not zero."""
    parts = F.transform(F.col(column), lambda x: x.cast("double"))
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col(column).isNotNull() & finite & F.exists(parts, lambda x: x != 0), F.lit(False))


def norm(column: str) -> Column:
    return F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x * x))


def matrix(column: pa.ListArray) -> np.ndarray:
    """The vectors of an Arrow list column of one dimension, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaling by the largest part first keeps extremes finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_dimension(df: DataFrame, column: str) -> DataFrame:
    """Adds ``dim``: vectors of different lengths are never compared."""
    return df.withColumn("dim", F.size(column))


def smallest(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """A sample of about ``most`` rows of each ``dim``, the same in every run, without sorting.

    Rows whose hash falls below a threshold, which the count sets; equal rows
    fall together, so the share of them, not their number, is what is bounded.
    """
    share = df.groupBy(F.col("dim").alias("_dim")).agg(F.count("*").alias("_n"))
    chance = F.pmod(F.xxhash64(*keys, F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    few = df.join(F.broadcast(share), F.col("dim") == F.col("_dim"))  # a row for each dimension
    return few.where(chance * F.col("_n") < most).drop("_dim", "_n")
