"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """True for vectors that are not null, not zero, and hold neither null nor non-finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def as_double(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.col(name).cast("array<double>"))


def matrix(column) -> np.ndarray:
    """Rows of equal length as float64; raises if lengths differ."""
    return np.array([np.asarray(x, dtype=np.float64) for x in column]) if len(column) else np.empty((0, 0))


def norms(x: np.ndarray) -> np.ndarray:
    """Row by row in a fixed order of operations, so that equal rows have equal norms. Scaled first: neither overflows nor vanishes."""
    top = np.abs(x).max(axis=1, keepdims=True)
    return np.sqrt(((x / top) ** 2).sum(axis=1)) * top[:, 0]


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    y = x / top
    return y / np.sqrt((y**2).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows with rows, in double precision; the same two rows give the same value wherever they stand."""
    return (unit(x) * unit(y)).sum(axis=1)
