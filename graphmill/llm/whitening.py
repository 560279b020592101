"""Whitening of vectors by a hierarchy of singular value decompositions.

Each partition decomposes its centred rows and keeps all singular values and vectors, the row count
and exact sums. Two summaries merge by stacking both scaled bases and one row for the difference of
the means, and decomposing again: nothing of the covariance is lost at any level, and no task holds
more than a few summaries (dimension x dimension numbers each) and a block of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import cut, drop_table, write_table

#: Rows that one decomposition takes at most, and summaries that one task merges at most.
BLOCK, FAN = 4096, 8
#: Entries are held to this range, so that sums of rows stay exact.
MOST = 1 << 40
#: A component whose singular value is below this share of the greatest has no variance but rounding.
FLAT = 1e-12

SUMMARY = "dim int, node long, n long, sums array<long>, s array<double>, basis array<double>"


@dataclass(frozen=True)
class Summary:
    """Rows, their sums by dimension, and singular values and vectors (rows of ``basis``) of the centred rows."""

    n: int
    sums: np.ndarray
    s: np.ndarray
    basis: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n


@dataclass(frozen=True)
class Model:
    """Of the fitted rows: their number, sums, and the first components with variances and their shares; ``error``: greatest entry of the whitened rows' covariance minus the identity."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variance: np.ndarray
    explained: np.ndarray
    error: float | None = None

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows by components; NaN for a component without variance."""
        known = self.variance > 0
        scale = np.where(known, 1 / np.sqrt(np.where(known, self.variance, 1)), np.nan)
        return (x - self.sums / self.n) @ self.components.T * scale


def decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, s, basis = np.linalg.svd(rows, full_matrices=False)
    return s, basis


def summarised(x: np.ndarray) -> Summary:
    sums = x.sum(0)
    return Summary(len(x), sums, *decomposed(x - sums / len(x)))


def merged(a: Summary, b: Summary) -> Summary:
    apart = np.sqrt(a.n * (b.n / (a.n + b.n))) * (a.mean - b.mean)
    return Summary(a.n + b.n, a.sums + b.sums, *decomposed(np.vstack([a.s[:, None] * a.basis, b.s[:, None] * b.basis, apart])))


def blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of one length each, in blocks; empty vectors are left out."""
    offsets = column.offsets.to_numpy()
    flat, sizes = column.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        for k in range(0, len(at), BLOCK):
            rows = at[k : k + BLOCK]
            yield rows, flat[offsets[rows][:, None] + np.arange(dim)]


def summary_rows(found: dict[int, Summary], node: int) -> pd.DataFrame:
    rows = [(dim, node, x.n, x.sums.tolist(), x.s.tolist(), x.basis.ravel().tolist()) for dim, x in found.items()]
    return pd.DataFrame(rows, columns=["dim", "node", "n", "sums", "s", "basis"])


def read_summary(row) -> Summary:
    return Summary(int(row.n), np.array(row.sums, np.int64), np.array(row.s, float), np.array(row.basis, float).reshape(-1, row.dim))


def partition_summaries(x: DataFrame) -> DataFrame:
    """A summary for each partition and length of ``x`` (x array<long>); ``node`` is the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Summary] = {}
        node = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(1)[0].as_py()
            for _, rows in blocks(batch.column(0)):
                dim, one = rows.shape[1], summarised(rows)
                found[dim] = merged(found[dim], one) if dim in found else one
        yield pa.RecordBatch.from_pandas(summary_rows(found, node), schema=pa.schema([("dim", pa.int32()), ("node", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("s", pa.list_(pa.float64())), ("basis", pa.list_(pa.float64()))]))

    return x.select("x", F.spark_partition_id().cast("long").alias("node")).mapInArrow(run, SUMMARY)


def merge_nodes(part: pd.DataFrame) -> pd.DataFrame:
    rows = [read_summary(r) for r in part.sort_values("node").itertuples()]
    whole = rows[0]
    for other in rows[1:]:
        whole = merged(whole, other)
    return summary_rows({int(part["dim"].iloc[0]): whole}, int(part["node"].iloc[0]))


def merge_all(summaries: DataFrame) -> list:
    """One summary a length, by levels of merges of ``FAN`` nodes."""
    level = cut(summaries)
    nodes = (level.agg(F.max("node")).first()[0] or 0) + 1
    while nodes > 1:
        level = level.withColumn("node", F.floor(F.col("node") / FAN)).groupBy("dim", "node").applyInPandas(merge_nodes, SUMMARY)
        nodes = -(-nodes // FAN)
    return level.collect()  # a row for each length of vectors


def model_of(x: Summary, components: int) -> Model:
    e = np.where(x.s > FLAT * max(x.s.max(initial=0), 1), x.s**2 / x.n, 0)
    total, dim = float((x.s**2).sum() / x.n), len(x.sums)
    k = min(components, dim)
    basis = np.zeros((k, dim))
    basis[: min(k, len(x.basis))] = x.basis[:k]
    top = basis[np.arange(k), np.abs(basis).argmax(1)]
    variance = np.zeros(k)
    variance[: min(k, len(e))] = e[:k]
    return Model(x.n, x.sums, basis * np.where(top < 0, -1, 1)[:, None], variance, variance / total if total else np.full(k, np.nan))


def identity_errors(x: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Of each length: the greatest entry of the whitened rows' covariance minus the identity, over the components with variance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, rows in blocks(batch.column(0)):
                w = models[rows.shape[1]].whitened(rows)
                w = np.hstack([w, np.ones((len(w), 1))])  # the last row and column sum the components themselves
                sums[rows.shape[1]] = sums.get(rows.shape[1], 0) + w.T @ w
        out = [(dim, i, j, float(v)) for dim, m in sums.items() for (i, j), v in np.ndenumerate(m)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.float64()))], names=["dim", "i", "j", "v"])

    moments = {dim: np.zeros((len(m.variance) + 1,) * 2) for dim, m in models.items()}
    for r in x.select("x").mapInArrow(run, "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect():  # a few numbers a length
        moments[r.dim][r.i, r.j] = r.v
    out = {}
    for dim, m in moments.items():
        on = np.flatnonzero(models[dim].variance > 0)
        mean = m[on, -1] / models[dim].n
        covariance = m[np.ix_(on, on)] / models[dim].n - np.outer(mean, mean)
        out[dim] = float(np.abs(covariance - np.eye(len(on))).max(initial=0))
    return out


def levels(vector: Column, scale: float) -> Column:
    """floor(scale * entry) as longs."""
    return F.transform(vector, lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(c * F.lit(float(scale)), F.lit(-float(MOST))), F.lit(float(MOST)))), F.lit(-MOST)), F.lit(MOST)))


def deviations(x: np.ndarray, model: Model) -> list:
    """Exact sums over dimensions of (n x - S)^2; None where a long can't hold it."""
    reach = float(np.abs(x).max(initial=0)) * model.n + float(np.abs(model.sums).max())
    if reach * reach * len(model.sums) < 2.0**62:
        return ((model.n * x - model.sums) ** 2).sum(1).tolist()
    exact = [sum((model.n * int(a) - int(s)) ** 2 for a, s in zip(row, model.sums, strict=True)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, components: int = 4) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: each usable row on the first components.

    Entries c become floor(scale * c), held to +-2^40; the fit takes each distinct vector once. Null
    vectors and those with null or non-finite entries have no rows; zero vectors take part. Vectors
    of each length are fitted and whitened apart (a row for each dimension, where fewer than
    ``components``); empty ones have no rows. A component without variance (one distinct vector, or a
    flat dimension) has a null ``whitened``; ``explained`` is null where nothing varies. Repeated rows
    and null ids are whitened like any other; an empty table gives no rows. ``deviation`` is null where
    a long can't hold it. Other columns are ignored.
    """
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v")).where(F.coalesce(finite & (F.size("v") > 0), F.lit(False))).select("vec_id", levels(F.col("v"), scale).alias("x"))
    distinct, path = write_table(rows.select("x").distinct())
    models = {r.dim: model_of(read_summary(r), components) for r in merge_all(partition_summaries(distinct))}
    errors = identity_errors(distinct, models)
    drop_table(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in blocks(batch.column(1)):
                model = models[x.shape[1]]
                k = len(model.variance)
                ids = batch.column(0).take(pa.array(np.repeat(at, k)))
                w = model.whitened(x).ravel()
                per = lambda values: pa.array(np.tile(values, len(at)), from_pandas=True)
                deviation = pa.array(deviations(x, model), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k)))
                yield pa.RecordBatch.from_arrays(
                    [ids, per(np.arange(1, k + 1, dtype=np.int32)), per(np.full(k, model.n, np.int64)), deviation, pa.array(w, from_pandas=True), per(model.explained), per(np.full(k, errors[x.shape[1]]))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
