"""Nearest neighbours by vantage-point trees, one tree a shard.

Cosine order is Euclidean order on the unit sphere, where the triangle inequality prunes. A leaf
is skipped when ``factor`` times its least possible distance passes the worst kept one: 1 is exact,
more is faster and approximate. A tree is built once and queries stream past it in blocks; a query
first looks into its own shard, and takes the radius it finds there to all the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.common import cut
from graphmill.llm.vectors import norms, vector_rows

#: Vectors a shard, queries a block, vectors a leaf.
SHARD, BLOCK, LEAF = 4096, 512, 64
#: Candidates for a vantage point, and vectors that their spread is judged by.
CANDIDATES, JUDGES = 8, 64
#: Rounding that distances and products of unit vectors may carry.
SLACK, NEAR = 1e-7, 1e-9
FOUND = "query_id long, vec_id long, score double, scored long"


class VpTree:
    """Distinct vectors of a shard; a node has a vantage point and the distance ranges of either half, a leaf has rows.

    Equal vectors are one row, with the ``k`` + 1 smallest of their ids: no larger one can be among
    the ``k`` nearest of anything.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, seed: int = 7):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order] + 0.0
        whole = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
        _, first, group = np.unique(whole, return_index=True, return_inverse=True)
        self.vectors, self.ids = vectors[first], [[] for _ in first]
        for i, g in zip(ids.tolist(), group.tolist(), strict=True):
            if len(self.ids[g]) <= k and self.ids[g][-1:] != [i]:  # a row that repeats another counts once
                self.ids[g].append(i)
        self.counts = np.bincount(group)
        self.k, self.lengths = k, norms(self.vectors)
        self.unit = self.vectors / self.lengths[:, None]
        self.random = np.random.default_rng(seed)
        self.leaves: list[np.ndarray] = []
        self.root = self.build(np.arange(len(first)))

    def build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            self.leaves.append(rows)
            return len(self.leaves) - 1
        some = self.unit[rows[self.random.integers(len(rows), size=CANDIDATES)]]
        judges = self.unit[rows[self.random.integers(len(rows), size=JUDGES)]]
        point = some[int(away(some, judges).var(1).argmax())]  # the widest spread of distances splits best
        d = away(point[None], self.unit[rows])[0]
        order = np.argsort(d, kind="stable")  # halves by rank: equal distances can't keep a node from shrinking
        near, far = np.split(order, [len(rows) // 2])
        return point, *[(d[h[0]], d[h[-1]], self.build(rows[h])) for h in (near, far)]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Least possible distance of each query (rows) to each leaf (columns)."""
        out, todo = np.zeros((len(q), len(self.leaves))), [(self.root, np.zeros(len(q)))]
        while todo:
            node, least = todo.pop()
            if isinstance(node, int):
                out[:, node] = least
                continue
            d = away(node[0][None], q)[0]
            todo += [(child, np.maximum(least, np.maximum(lo - d, d - hi))) for lo, hi, child in node[1:]]
        return out

    def search(self, queries: np.ndarray, own: np.ndarray, factor: float = 1.0, known: np.ndarray | None = None) -> tuple[list[list[tuple[float, int]]], np.ndarray]:
        """For each query the best (cosine, id) with another id than ``own``, best first, ties to smaller ids; and how many vectors it met.

        ``known``: cosines that a result must reach (of ``k`` results that the query has elsewhere).
        Each query takes its leaves in the order of their bounds; queries at one leaf are compared together.
        """
        lengths = norms(queries)
        unit = queries / lengths[:, None]
        best: list[list[tuple[float, int]]] = [[] for _ in queries]
        floor = np.full(len(queries), -np.inf) if known is None else np.where(np.isnan(known), -np.inf, known)
        worst, scored = floor.copy(), np.zeros(len(queries), np.int64)
        bounds = self.bounds(unit)
        order = np.argsort(bounds, axis=1, kind="stable")
        for turn in range(order.shape[1]):
            leaf = order[:, turn]
            radius = np.where(np.isfinite(worst), np.sqrt(np.maximum(2 - 2 * np.maximum(worst, -1), 0)), np.inf)
            active = np.flatnonzero(factor * bounds[np.arange(len(leaf)), leaf] <= radius + SLACK)
            if not len(active):
                break  # bounds only grow from here on
            by_leaf = active[np.argsort(leaf[active], kind="stable")]
            for part in np.split(by_leaf, np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
                rows = self.leaves[leaf[part[0]]]
                scored[part] += self.counts[rows].sum()
                self.meet(queries, lengths, unit, own, part, rows, floor, worst, best)
        return best, scored

    def meet(self, queries, lengths, unit, own, part, rows, floor, worst, best) -> None:
        """Compare the queries ``part`` with the vectors ``rows``: products find candidates, the exact measure decides."""
        near = unit[part] @ self.unit[rows].T
        least = worst[part] - NEAR
        if len(rows) > self.k + 1:
            least = np.maximum(least, np.partition(near, -self.k - 1, axis=1)[:, -self.k - 1] - NEAR)
        at, column = np.nonzero(near >= least[:, None])
        q, v = part[at], rows[column]
        scores = (self.vectors[v] * queries[q]).sum(1) / (self.lengths[v] * lengths[q])
        for i, u, score in zip(q.tolist(), v.tolist(), scores.tolist(), strict=True):
            if score >= worst[i]:
                kept = best[i] + [(score, -j) for j in self.ids[u] if j != own[i]]
                kept.sort(reverse=True)
                best[i] = kept[: self.k]
                if len(kept) >= self.k:
                    worst[i] = max(floor[i], kept[self.k - 1][0])


def away(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between unit vectors, rows by rows."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, first, size) of a list column."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return column.values.to_numpy(zero_copy_only=False), ends[:-1].astype(np.int64), np.diff(ends)


def visited(points: DataFrame, asked: DataFrame, k: int, factor: float) -> DataFrame:
    """query_id, vec_id, score, scored: what each query finds in the shards it is sent to.

    ``points``: (shard, id, vector), ``asked``: (shard, id, vector, known). A task reads the vectors
    of a shard, builds its trees (one a dimension) and then takes the shard's queries block by block.
    """
    none = F.lit(None).cast("double")
    both = points.select("shard", F.lit(0).alias("kind"), "id", "vector", none.alias("known")).unionByName(asked.select("shard", F.lit(1).alias("kind"), "id", "vector", "known"))
    ordered = both.repartition("shard").sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, trees = None, [], {}
        for batch in batches:
            group, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(group) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if a == b:
                    continue
                if group[a] != shard:
                    shard, held, trees = group[a], [], {}
                ids, known = batch.column(2).to_numpy()[a:b], batch.column(4).slice(a, b - a).to_numpy(zero_copy_only=False).astype(float)
                flat, first, size = unpacked(batch.column(3).slice(a, b - a))
                if kind[a] == 0:
                    held += [(d, ids[size == d], flat[first[size == d][:, None] + np.arange(d)]) for d in np.unique(size)]
                    continue
                for d in {h[0] for h in held}:
                    mine = [h for h in held if h[0] == d]
                    trees[d] = VpTree(np.concatenate([h[1] for h in mine]), np.vstack([h[2] for h in mine]), k)
                held = []
                for d in np.unique(size):
                    rows = np.flatnonzero(size == d)
                    for at in range(0, len(rows) if d in trees else 0, BLOCK):
                        block = rows[at : at + BLOCK]
                        best, scored = trees[d].search(flat[first[block][:, None] + np.arange(d)], ids[block], factor, known[block])
                        out = [(i, -j, s, n) for i, found, n in zip(ids[block].tolist(), best, scored.tolist(), strict=True) for s, j in found]
                        if out:
                            columns = zip(*out, strict=True)
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["query_id", "vec_id", "score", "scored"])

    return ordered.mapInArrow(run, FOUND)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest by cosine, ties to the smaller id.

    Candidates are all rows with another id; fewer candidates give fewer rows. Vectors that are
    null, zero, or hold null or non-finite components take no part, nor do rows without an id or of
    another dimension than the query. Repeated rows count once, rows of one id with different vectors
    each; an empty table gives no rows; other columns are ignored. Shards
    have a fixed size; a query visits its own shard first, then all others with the radius found.
    """
    points, asked = vector_rows(vectors, id_col, vector_col), vector_rows(queries, id_col, vector_col).dropDuplicates()
    shards = max(1, -(-points.count() // SHARD))
    shard = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(shards))
    placed, home = points.withColumn("shard", shard), asked.withColumn("shard", shard)
    first = cut(visited(placed, home.withColumn("known", F.lit(None).cast("double")), k, factor))
    found = first
    if shards > 1:
        radius = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("known"))
        others = home.join(radius, "id", "left").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).where("other <> shard")
        found = first.unionByName(visited(placed, others.select(F.col("other").alias("shard"), "id", "vector", "known"), k, factor))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
