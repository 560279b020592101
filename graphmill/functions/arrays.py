"""Vectors between Arrow and NumPy, and their sums by key.

A sum by key is worked out twice: each task adds up the vectors of equal keys in every Arrow batch,
so that a hub sends a few partial sums and not a vector an edge, then the shuffled partial sums are
added as a stream. The width of a vector doesn't matter to the plan: no expression is per component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.functions.ordering import cut

#: Numbers that the sums of one block of targets hold (64 MB), and in-edges of a target in one block; a hub has more.
BLOCK_NUMBERS, BLOCK_EDGES = 1 << 23, 1 << 20
#: Edges of all targets of one block, on average.
BLOCK_ALL = 1 << 23


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    if not len(column):
        return np.zeros((0, 0))
    if column.null_count:
        raise ValueError("a vector is null")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * len(column[0]):
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1).astype(float, copy=False)


def vectors(rows: np.ndarray) -> pa.ListArray:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(rows).ravel()))


def groups(batch: pa.RecordBatch, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order that brings rows of equal keys (the first ``keys`` columns) together, and where each group starts in it."""
    frame = pd.DataFrame({k: batch.column(k).to_pandas() for k in range(keys)})
    codes = frame.groupby(list(frame), sort=False, dropna=False).ngroup().to_numpy()
    order = np.argsort(codes, kind="stable")
    return order, np.flatnonzero(np.append(True, np.diff(codes[order]) != 0))[: len(codes)]


def weighed(x: np.ndarray, weights: np.ndarray | None) -> np.ndarray:
    """Rows times their weights: one a row, or one for each of as many equal parts."""
    if weights is None:
        return x
    n, parts = weights.shape
    return (x.reshape(n, parts, -1) * weights[:, :, None]).reshape(n, -1)


def vector_sums(rows: DataFrame, keys: list[str], vector: str, weights: str | None = None) -> DataFrame:
    """keys, ``total`` (sum of ``vector``, times ``weights``, an array of one weight for each equal part of it), ``n`` (rows). Null vectors don't count."""
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    schema, k, names = f"{head}, total array<double>, n long", len(keys), [*keys, "total", "n"]
    used = rows.where(f"`{vector}` is not null").select(*keys, vector, *([weights] if weights else []))

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = weighed(matrix(batch.column(k)), matrix(batch.column(k + 1)) if weights else None)
                order, first = groups(batch, k)
                at = pa.array(order[first])
                n = np.diff(np.append(first, len(order)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(k)), vectors(np.add.reduceat(x[order], first)), pa.array(n)], names=names)

    def wholly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last group of a batch may go on in the next one."""
        open_: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if open_ is None else pa.Table.from_batches([open_, batch]).combine_chunks().to_batches()[0]
            x, n = matrix(whole.column(k)), whole.column(k + 1).to_numpy()
            order, first = groups(whole, k)
            out = pa.RecordBatch.from_arrays([*(whole.column(c).take(pa.array(order[first])) for c in range(k)), vectors(np.add.reduceat(x[order], first)), pa.array(np.add.reduceat(n[order], first))], names=names)
            open_ = out.slice(out.num_rows - 1)
            yield out.slice(0, out.num_rows - 1)
        if open_ is not None:
            yield open_

    return used.mapInArrow(partly, schema).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(wholly, schema)


def in_blocks(edges: DataFrame, width: int) -> tuple[DataFrame, bool, int]:
    """(block, src, dst) of edges, so that the sums of a block's targets fit a task, whether a hub's in-edges are dealt to several blocks by source, and the number of blocks."""
    spark = edges.sparkSession
    edges = edges.select("src", "dst")
    degree = cut(edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n")))
    seen = degree.agg(F.count(F.lit(1)).alias("targets"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges")).first()
    blocks = max(spark.sparkContext.defaultParallelism, -(-seen.targets * width // BLOCK_NUMBERS), -(-seen.edges // BLOCK_ALL))
    place, hubs = F.xxhash64("dst"), seen.most > BLOCK_EDGES
    if hubs:
        chunks = degree.where(F.col("n") > BLOCK_EDGES).select("dst", F.ceil(F.col("n") / BLOCK_EDGES).alias("chunks"))
        edges = edges.join(chunks, "dst", "left")
        place = F.when(F.col("chunks").isNull(), place).otherwise(F.xxhash64("dst", F.pmod(F.xxhash64("src"), F.col("chunks"))))
    return edges.select(F.pmod(place, F.lit(blocks)).cast("int").alias("block"), "src", "dst"), hubs, blocks


@dataclass(frozen=True)
class Packed:
    """Edges in blocks of targets: rows (src, block, near: targets in order), a few for each source and block; sums over them need no sort of edges."""

    rows: DataFrame
    hubs: bool
    blocks: int


def packed(edges: DataFrame, width: int, again: bool = False) -> Packed:
    """Edges (src, dst) packed for sums of ``width`` components; ``again``: written once, for several sums.

    Edges are sorted by source once, as numbers alone. A row holds a batch's edges at most, whatever
    the degree of its source.
    """
    rows, hubs, blocks = in_blocks(edges, width)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block, src, dst = (batch.column(k).to_numpy() for k in range(3))
            order = np.lexsort((block, src))
            block, src, dst = block[order], src[order], dst[order]
            first = np.flatnonzero(np.append(True, (src[1:] != src[:-1]) | (block[1:] != block[:-1])))
            near = pa.ListArray.from_arrays(pa.array(np.append(first, len(src)).astype(np.int32)), pa.array(dst))
            yield pa.RecordBatch.from_arrays([pa.array(src[first]), pa.array(block[first]), near], names=["src", "block", "near"])

    known = rows.where("src is not null and dst is not null")
    out = known.repartition("src").sortWithinPartitions("src", "dst").mapInArrow(pack, "src long, block int, near array<long>")
    return Packed(cut(out) if again else out, hubs, blocks)


def neighbor_sums(edges: DataFrame | Packed, h: DataFrame, width: int) -> DataFrame:
    """dst, total (sum of the sources' ``h``, times their ``w`` if there is one), ``n`` (in-edges whose source has a vector), from edges (src, dst) and h (node_id, h, w).

    Targets lie in blocks whose sums fit a task. A source's vector meets the arrays of its targets in
    each block and goes there with them: the shuffle holds no vector for each edge, and edges are
    neither sorted nor joined one by one. A hub's in-edges are dealt to several blocks by source.
    """
    near = edges if isinstance(edges, Packed) else packed(edges, width)
    vector = h.select(F.col("node_id").alias("src"), "h", F.col("w") if "w" in h.columns else F.lit(1.0).alias("w")).where("h is not null")
    sent = near.rows.join(vector, "src").select("block", "src", F.col("near")[0].alias("least"), "near", "h", "w")
    met = sent.repartitionById(near.blocks, "block").sortWithinPartitions("block", "src", "least").select("block", "near", "h", "w")
    step = max(1, (1 << 21) // max(1, width))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's sums leave when it ends."""
        at, slots, total, n = None, {}, np.zeros((0, width)), np.zeros(0, np.int64)

        def done() -> Iterator[pa.RecordBatch]:
            ids = np.fromiter(slots, np.int64, len(slots))
            for lo in range(0, len(ids), 8192):
                hi = min(lo + 8192, len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi]), vectors(total[lo:hi]), pa.array(n[lo:hi])], names=["dst", "total", "n"])

        for batch in batches:
            blocks_ = batch.column(0).to_numpy()
            ends = [0, *(np.flatnonzero(blocks_[1:] != blocks_[:-1]) + 1), len(blocks_)] if len(blocks_) else [0]
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                if blocks_[lo] != at:
                    yield from done()
                    at, slots, total, n = blocks_[lo], {}, np.zeros((0, width)), np.zeros(0, np.int64)
                part = batch.slice(int(lo), int(hi - lo))
                x = matrix(part.column(2)).reshape(-1, width) * part.column(3).to_numpy()[:, None]
                every, owner = part.column(1).flatten().to_numpy(), np.repeat(np.arange(len(x)), pc.list_value_length(part.column(1)).to_numpy())
                for k in range(0, len(every), step):
                    order = np.argsort(every[k : k + step], kind="stable")
                    dst, known = every[k : k + step][order], owner[k : k + step][order]
                    starts = np.flatnonzero(np.append(True, dst[1:] != dst[:-1]))
                    slot = np.fromiter((slots.setdefault(d, len(slots)) for d in dst[starts].tolist()), np.int64, len(starts))
                    if len(slots) > len(total):
                        more = max(len(slots), 2 * len(total), 1024) - len(total)
                        total, n = np.vstack([total, np.zeros((more, width))]), np.append(n, np.zeros(more, np.int64))
                    total[slot] += np.add.reduceat(x[known], starts)
                    n[slot] += np.diff(np.append(starts, len(dst)))
        yield from done()

    sums = met.mapInArrow(add, "dst long, total array<double>, n long")
    if not near.hubs:
        return sums
    return vector_sums(sums.select("dst", "total"), ["dst"], "total").select("dst", "total").join(sums.groupBy("dst").agg(F.sum("n").alias("n")), "dst")


def attention_sums(edges: DataFrame, z: DataFrame, target: DataFrame, left: np.ndarray, right: np.ndarray, slope: float) -> DataFrame:
    """dst, total: sums of the sources' ``z``, each head's part times its share, from edges (src, dst), z and target (node_id, z).

    A share is the softmax, over the in-edges of a target, of the leaky sum of two scores: ``left``
    times the source's part and ``right`` times the target's. Blocks are those of ``neighbor_sums``:
    a vector goes to each block that asks for it once, and no score of an edge is written. A target keeps the
    greatest score so far, and its sums are scaled down when a greater one comes. A block's part of
    a hub leaves with its greatest scores and weights, and such parts are added by target.
    """
    heads, width = left.shape
    size = heads * width
    rows, hubs, _ = in_blocks(edges, size + 2 * heads)
    none = F.lit(None)
    vector = z.where("z is not null").select(F.col("node_id").alias("src"), F.col("z").alias("h"))
    kind = vector.schema["h"].dataType
    own = target.where("z is not null").select(F.col("node_id").alias("dst"), F.col("z").alias("h"))
    # files look smaller than the vectors made of them: no join may send these to the driver to broadcast them
    asking = rows.select("block", "dst").distinct().join(own.hint("merge"), "dst").select("block", none.cast("long").alias("src"), "dst", "h")
    sent = rows.select("block", "src").distinct().join(vector.hint("merge"), "src").select("block", "src", none.cast("long").alias("dst"), "h")
    met = asking.unionByName(sent).unionByName(rows.withColumn("h", none.cast(kind)))
    met = met.repartition("block").sortWithinPartitions("block", F.asc_nulls_first("src"), F.asc_nulls_first("dst"))
    score = lambda x, w: (x.reshape(len(x), heads, width) * w).sum(2)
    spread = lambda w: np.repeat(w, width, axis=1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's targets come first, then each source before its edges; both may go on in the next batch."""
        at, slots, r, top, weight, total = None, {}, [], None, None, None
        last, last_src = np.zeros((1, size)), None

        def done() -> Iterator[pa.RecordBatch]:
            if total is None:
                return
            ids = np.fromiter(slots, np.int64, len(slots))
            for lo in range(0, len(ids), 8192):
                k = lo + np.flatnonzero(weight[lo : lo + 8192, 0] > 0)
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[k]), vectors(total[k]), vectors(top[k]), vectors(weight[k])], names=["dst", "total", "top", "weight"])

        for batch in batches:
            blocks_ = batch.column(0).to_numpy()
            ends = [0, *(np.flatnonzero(blocks_[1:] != blocks_[:-1]) + 1), len(blocks_)] if len(blocks_) else [0]
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                if blocks_[lo] != at:
                    yield from done()
                    at, slots, r, top, weight, total, last_src = blocks_[lo], {}, [], None, None, None, None
                part = batch.slice(int(lo), int(hi - lo))
                has_src, has_dst = (part.column(k).is_valid().to_numpy(zero_copy_only=False) for k in (1, 2))
                if not has_src.all():
                    mine = part.filter(pa.array(~has_src))
                    slots.update(zip(mine.column(2).to_pylist(), range(len(slots), len(slots) + mine.num_rows), strict=True))
                    r.append(score(matrix(mine.column(3)), right))
                    part, has_dst = part.filter(pa.array(has_src)), has_dst[has_src]
                if not part.num_rows or not slots:
                    continue
                if total is None:
                    r = np.vstack(r)
                    top, weight, total = np.full(r.shape, -np.inf), np.zeros(r.shape), np.zeros((len(r), size))
                src, held = part.column(1).to_numpy(), part.filter(pa.array(~has_dst))
                x = np.vstack([last, matrix(held.column(3)).reshape(-1, size)])
                owner = np.append(-1 if last_src is None else last_src, src[~has_dst])
                known = np.cumsum(~has_dst)[has_dst]  # the vector before an edge; its own source's, if that has one
                slot = np.array([slots.get(d, -1) for d in part.column(2).filter(pa.array(has_dst)).to_pylist()], np.int64)
                fits = (owner[known] == src[has_dst]) & ((known > 0) | (last_src is not None)) & (slot >= 0)
                last, last_src = x[-1:], owner[-1] if len(owner) > 1 else last_src
                slot, known = slot[fits], known[fits]
                if not len(slot):
                    continue
                order = np.argsort(slot, kind="stable")
                slot, known = slot[order], known[order]
                starts = np.flatnonzero(np.append(True, np.diff(slot) != 0))
                t, each = slot[starts], np.diff(np.append(starts, len(slot)))
                s = score(x, left)[known] + r[slot]
                e = np.where(s > 0, s, slope * s)
                new = np.maximum(top[t], np.maximum.reduceat(e, starts))
                e, down = np.exp(e - np.repeat(new, each, axis=0)), np.exp(top[t] - new)
                weight[t] = weight[t] * down + np.add.reduceat(e, starts)
                total[t] = total[t] * spread(down) + np.add.reduceat(x[known] * spread(e), starts)
                top[t] = new
        yield from done()

    parts = met.mapInArrow(add, "dst long, total array<double>, top array<double>, weight array<double>")
    if hubs:
        parts = cut(parts)
        most = parts.groupBy("dst").agg(F.array(*[F.max(F.col("top")[k]) for k in range(heads)]).alias("most"))
        down = F.zip_with("top", "most", lambda a, b: F.exp(a - b))
        both = parts.join(most, "dst").select("dst", "total", "weight", down.alias("down"))
        sums = vector_sums(both, ["dst"], "total", "down").select("dst", "total")
        parts = sums.join(vector_sums(both, ["dst"], "weight", "down").select("dst", F.col("total").alias("weight")), "dst")
    share = F.transform("total", lambda v, k: v / F.element_at("weight", (k / F.lit(width)).cast("int") + 1))
    return parts.select("dst", share.alias("total"))
