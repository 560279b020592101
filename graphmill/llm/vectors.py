"""Vectors in double precision: which take part, and cosines that don't depend on a row's place."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "id long, vector array<double>"


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vector_rows(df: DataFrame, id_col: str, vector_col: str, *more: Column) -> DataFrame:
    """(id, vector as doubles, further columns) of the rows that take part."""
    vector = F.col(vector_col).cast("array<double>")
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), *more).where(usable(F.col("vector")))


def matrix(vectors) -> np.ndarray:
    rows = [np.asarray(v, dtype=float) for v in vectors]
    return np.stack(rows) if rows else np.zeros((0, 0))


def norms(m: np.ndarray) -> np.ndarray:
    """Row lengths; each row is summed alone, so equal rows have equal lengths."""
    scale = np.abs(m).max(1, keepdims=True)
    return np.sqrt(((m / scale) ** 2).sum(1)) * scale[:, 0]


def cosines(m: np.ndarray, lengths: np.ndarray, q: np.ndarray, q_length: float) -> np.ndarray:
    return (m * q).sum(1) / (lengths * q_length)
