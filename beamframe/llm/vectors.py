"""Vectors as whole numbers: what the vector operators keep of a table, and batches of it as NumPy matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components beyond this lie outside what 64-bit squared distances can hold.
MOST = 1 << 27


def usable(vec: str, dims: int) -> Column:
    """The vector has dims components, none of them null, NaN or infinite."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(vec) == dims) & finite


def matrix(column, dims: int, scale: int = 1) -> np.ndarray:
    """floor(scale * x) of an Arrow list column without nulls, a row for each vector."""
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64) * scale
    if len(values) and np.abs(values).max() >= MOST:
        raise ArithmeticError(f"a component times {scale} exceeds {MOST}")
    return np.floor(values).astype(np.int64).reshape(-1, dims)


def group_sums(points: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, componentwise sums) of points for each of k groups; exact."""
    order = np.argsort(at, kind="stable")
    counts = np.bincount(at, minlength=k)
    held = np.flatnonzero(counts)
    sums = np.zeros((k, points.shape[1]), np.int64)
    if len(held):
        sums[held] = np.add.reduceat(points[order], np.r_[0, np.cumsum(counts[held])[:-1]], axis=0)
    return counts, sums


def moved(centres: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Centres with rows at the floor of their mean, others where they are."""
    return np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centres)


def summed(df: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Partial sums (keys, n, s0, s1, ...) added up."""
    return df.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(width)])
