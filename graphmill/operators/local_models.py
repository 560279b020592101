"""Models over blocks whose batches fit a task: a batch, as one rank's work, is one unit from its features to its scores or gradients.

Spark brings a batch's block and its features together once, by batch; no state of a layer and no
message of an edge is shuffled.
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.functions.arrays import matrix, vectors

SLOPE = 0.2
NO_LABEL = np.iinfo(np.int64).min


def add_at(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Adds ``rows`` to the rows ``at`` of ``out``, repeats too."""
    if len(at):
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(at[order]) != 0))
        out[at[order[first]]] += np.add.reduceat(rows[order], first)
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in half the bytes, if these hold them."""
    with np.errstate(over="ignore"):
        half = x.astype(np.float32)
    return half if np.array_equal(half, x) else x


def summed(kind: str, edges: tuple[np.ndarray, np.ndarray], t: np.ndarray, h: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], tuple]:
    """(the targets whose state a sage or gcn layer gives, what its product reads of them in parts, (sources, targets, weights) of the edges that say something)."""
    (src, dst), n = edges, len(h)
    into = np.bincount(dst, minlength=n)[dst]
    w = 1 / into if kind == "sage" else 1 / np.sqrt(np.bincount(src, minlength=n)[src] * into)
    live = has[src]
    src, dst, w = src[live], dst[live], w[live]
    total = add_at(np.zeros(h.shape), dst, h[src] * w[:, None])
    if kind == "sage":
        t = t[has[t]]
        return t, [h[t], total[t]], (src, dst, w)
    return t, [total[t]], (src, dst, w)


class Batch:
    """One batch: ``nodes`` (sorted ids), ``edges`` of each layer and ``seeds`` as places in them, ``h`` of the nodes that ``has`` it, labels of seeds (``NO_LABEL``: none)."""

    def __init__(self, batch: int, layers: int, kind: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, h: np.ndarray):
        x, on = a[known], kind > -1
        order = np.lexsort((b[on], a[on], kind[on]))  # sums come out the same in each run
        self.batch, self.nodes = batch, np.unique(np.concatenate([a[kind <= layers], b[(kind >= 0) & (kind < layers)]]))
        kind, a, b = kind[on][order], a[on][order], b[on][order]
        at = lambda ids: np.searchsorted(self.nodes, ids)
        self.edges = [(at(a[kind == k]), at(b[kind == k])) for k in range(layers)]
        self.seeds = at(a[kind == layers])
        self.has = np.zeros(len(self.nodes), bool)
        self.has[at(x)] = True
        self.h = np.zeros((len(self.nodes), h.shape[1]))
        self.h[at(x)] = h
        self.label = np.full(len(self.nodes), NO_LABEL)
        self.label[at(a[kind == layers + 1])] = b[kind == layers + 1]

    #: (targets, what the first layer's product reads of them), if that is worked out already.
    first = None

    def slim(self, kind: str) -> Batch:
        """The batch without what training needs no more: the sums that the first layer of sage or gcn reads hang on no parameter, so its sources go."""
        out = copy.copy(self)
        if kind == "gat":
            out.h = narrow(self.h)
            return out
        every = self.targets()[0]
        t, x, _ = summed(kind, self.edges[0], every, self.h, self.has)
        at = lambda places: np.searchsorted(every, places)
        out.nodes, out.label, out.seeds, out.h, out.has = self.nodes[every], self.label[every], at(self.seeds), None, None
        out.edges, out.first = [None, *((at(a), at(b)) for a, b in self.edges[1:])], (at(t), [narrow(part) for part in x])
        return out

    def targets(self) -> list[np.ndarray]:
        """The targets of each layer."""
        out = [self.seeds]
        for src, _ in self.edges[:0:-1]:
            out.insert(0, np.unique(np.concatenate([out[0], src])))
        return out


def batches_of(parts: Iterator[pa.RecordBatch], layers: int, width: int) -> Iterator[Batch]:
    """Batches from rows (batch, k, a, b, h) sorted by batch; one may go on in the next part."""

    def made(held: list[pa.RecordBatch]) -> Batch:
        t = pa.Table.from_batches(held).combine_chunks()
        column = lambda k: t.column(k).combine_chunks()
        known = column(4).is_valid().to_numpy(zero_copy_only=False)
        h = matrix(column(4).drop_null()).reshape(-1, width)
        return Batch(t.column(0)[0].as_py(), layers, *(column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)), known, h)

    held: list[pa.RecordBatch] = []
    for part in parts:
        ids = part.column(0).to_numpy()
        ends = [*np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids)] if len(ids) else []
        for lo, hi in zip([0, *ends[:-1]], ends, strict=True) if ends else ():
            if held and held[0].column(0)[0].as_py() != ids[lo]:
                yield made(held)
                held = []
            held.append(part.slice(int(lo), int(hi - lo)))
    if held:
        yield made(held)


def rows_of(blocks, features: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(batch, k, a, b, h): nodes with their features (k = -1), edges of layer k, seeds (k = layers), labels of seeds (k = layers + 1)."""
    layers, none = len(blocks.edges), F.lit(None).cast(features.schema["h"].dataType).alias("h")
    zero = F.lit(0).cast("long").alias("b")
    seeds = blocks.nodes[-1]
    ids = seeds.select("batch", "node_id")
    for e in blocks.edges:
        ids = ids.unionByName(e.select("batch", F.col("src").alias("node_id")))
    asked = ids.repartition("node_id").distinct()  # dealt by node once, for this and for the join
    out = asked.join(features.select("node_id", "h"), "node_id").select("batch", F.lit(-1).alias("k"), F.col("node_id").alias("a"), zero, "h")
    for k, e in enumerate(blocks.edges):
        out = out.unionByName(e.select("batch", F.lit(k).alias("k"), F.col("src").alias("a"), F.col("dst").alias("b"), none))
    out = out.unionByName(seeds.select("batch", F.lit(layers).alias("k"), F.col("node_id").alias("a"), zero, none))
    if labels is not None:
        known = seeds.join(labels.select("node_id", F.col("label").cast("long").alias("b")).where("b is not null"), "node_id")
        out = out.unionByName(known.select("batch", F.lit(layers + 1).alias("k"), F.col("node_id").alias("a"), "b", none))
    return out.repartition("batch").sortWithinPartitions("batch")


def forward(model, batch: Batch, activated: Callable, product: Callable, draw: int | None) -> tuple[np.ndarray, np.ndarray, list[dict]]:
    """(states of all nodes, of which the seeds' are scores; which nodes have one; what each layer keeps)."""
    h, has, kept, n = batch.h, batch.has, [], len(batch.nodes)
    for k, t in enumerate(batch.targets()):
        on = np.zeros(n, bool)
        if model.kind == "gat":
            p, heads, (src, dst) = model.params[k], model.heads, batch.edges[k]
            live = has[src] & has[dst]
            src, dst = src[live], dst[live]
            z, y = h @ p["source"], h @ p["target"]
            side = lambda v, w: (v.reshape(n, heads, -1) * w).sum(2)
            s = side(z, p["left"])[src] + side(y, p["right"])[dst]
            e = np.where(s > 0, s, SLOPE * s)
            top = np.full((n, heads), -np.inf)
            np.maximum.at(top, dst, e)
            e = np.exp(e - top[dst])
            share = e / add_at(np.zeros((n, heads)), dst, e)[dst]
            o = add_at(np.zeros_like(z), dst, (z[src].reshape(len(src), heads, -1) * share[:, :, None]).reshape(len(src), -1))
            x = o + p["bias"]
            kept.append({"h": h, "t": t, "src": src, "dst": dst, "z": z, "y": y, "share": share, "slope": np.where(s > 0, 1.0, SLOPE), "o": o})
            h = x.reshape(n, heads, -1).mean(1) if model.last(k) else x
            on[t] = True
        else:
            weights, bias = product(model, k)
            if k == 0 and batch.first is not None:
                (t, parts), (src, dst, w) = batch.first, (None, None, None)
            else:
                t, parts, (src, dst, w) = summed(model.kind, batch.edges[k], t, h, has)
            x = np.hstack([part.astype(float) for part in parts])
            out, slope = activated(model, k, x @ weights + bias, np.full(len(t), batch.batch), batch.nodes[t], draw)
            kept.append({"x": x, "t": t, "src": src, "dst": dst, "w": w, "slope": slope, "n": n})
            h = np.zeros((n, len(bias)))
            h[t] = out
            on[t] = True
        has = on
    return h, has, kept


def back(model, k: int, saved: dict, g: np.ndarray, product: Callable) -> tuple[np.ndarray | None, dict[str, np.ndarray]]:
    """(gradient of the layer's input states, none for the first layer; gradients of its parameters), from g of all nodes (0 but for targets)."""
    t, src, dst = saved["t"], saved["src"], saved["dst"]
    if model.kind != "gat":
        weights, _ = product(model, k)
        at = g[t] * saved["slope"]
        dw, half = saved["x"].T @ at, len(weights) // 2 if model.kind == "sage" else 0
        own = ({"own": dw[:half], "neigh": dw[half:]} if half else {"weight": dw}) | {"bias": at.sum(0)}
        if k == 0:
            return None, own
        gx = at @ weights.T
        along = np.zeros((saved["n"], len(weights) - half))
        along[t] = gx[:, half:]
        out = add_at(np.zeros_like(along), src, along[dst] * saved["w"][:, None])
        if half:
            out[t] += gx[:, :half]
        return out, own
    p, heads, h, z = model.params[k], model.heads, saved["h"], saved["z"]
    n, split = len(h), lambda v: v.reshape(len(v), heads, -1)
    grad = np.tile(g, heads) / heads if model.last(k) else g
    inner = split(grad * saved["o"]).sum(2)
    score = saved["share"] * (split(grad[dst] * z[src]).sum(2) - inner[dst]) * saved["slope"]
    gl, gr = (add_at(np.zeros((n, heads)), at, score) for at in (src, dst))
    gz = add_at(np.zeros_like(z), src, (split(grad[dst]) * saved["share"][:, :, None]).reshape(len(src), -1)) + (gl[:, :, None] * p["left"]).reshape(n, -1)
    gy = (gr[:, :, None] * p["right"]).reshape(n, -1)
    grads = {"left": (split(z) * gl[:, :, None]).sum(0), "right": (split(saved["y"]) * gr[:, :, None]).sum(0), "source": h.T @ gz, "target": h.T @ gy, "bias": grad[t].sum(0)}
    return (gz @ p["source"].T + gy @ p["target"].T if k else None), grads


def gradient(model, batch: Batch, classes: int, activated: Callable, product: Callable, flat: Callable, draw: int | None) -> np.ndarray:
    """Gradients of all parameters, end to end, then the loss and the labelled seeds; sums over the batch. A label outside the classes raises."""
    z, has, kept = forward(model, batch, activated, product, draw)
    at = batch.seeds[(batch.label[batch.seeds] != NO_LABEL) & has[batch.seeds]]
    label = batch.label[at]
    if len(at) and (label.min() < 0 or label.max() >= classes):
        raise ValueError("a label is not a class")
    top = z[at] - z[at].max(1, keepdims=True) if len(at) else z[at]
    log_p = top - np.log(np.exp(top).sum(1, keepdims=True))
    g, row = np.zeros_like(z), np.arange(len(at))
    error = np.exp(log_p)
    error[row, label] -= 1
    g[at] = error
    out = [np.array([-log_p[row, label].sum(), len(at)])]
    for k in range(len(kept) - 1, -1, -1):
        g, grads = back(model, k, kept[k], g, product)
        out.insert(0, flat(grads))
    return np.concatenate(out)


def packed(rows: DataFrame, layers: int, width: int, kind: str) -> DataFrame:
    """batch, data, nodes (sampled): a row a batch."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(parts, layers, width):
            yield pa.RecordBatch.from_arrays([pa.array([b.batch], pa.int64()), pa.array([pickle.dumps(b.slim(kind))], pa.binary()), pa.array([len(b.nodes)], pa.int64())], names=["batch", "data", "nodes"])

    return rows.mapInArrow(run, "batch long, data binary, nodes long")


def scored(rows: DataFrame, layers: int, width: int, forward_: Callable[[Batch], tuple], schema: str) -> DataFrame:
    """batch, node_id, h of the seeds."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(parts, layers, width):
            z, has, _ = forward_(b)
            at = b.seeds[has[b.seeds]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), b.batch)), pa.array(b.nodes[at]), vectors(z[at])], names=["batch", "node_id", "h"])

    return rows.mapInArrow(run, schema)
