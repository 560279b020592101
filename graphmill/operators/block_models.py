"""Models over sampled blocks, forwards and backwards: everything is keyed by (batch, node).

A layer reads the states of a block's sources and gives states to its targets. Sums over neighbours
and their reverse, gradients pushed to sources, are joins of a block's edges with states and
``vector_sums``; dense products, activations and their derivatives run in Arrow batches. Gradients
of parameters are added up by tasks and then in two rounds, so that the driver gets one row of as
many numbers as there are parameters.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphmill.functions.arrays import matrix, vector_sums, vectors
from graphmill.functions.ordering import cut, dropped, new_folder, written
from graphmill.operators import layers as L
from graphmill.operators import local_models as M
from graphmill.operators.graph import SEED, adjacent, hub_chunks, sample_layer

KEYS = ["batch", "node_id"]
STATE = "batch long, node_id long, h array<double>"
PARTS = "part string, batch long, node_id long, h array<double>"


#: Ids of sampled nodes in one slice of written blocks, at most so many slices, and numbers of features that are brought to batches at once at least (256 MB of floats).
SLICE_IDS, SLICES, WINDOW_NUMBERS = 1 << 20, 64, 1 << 26


@dataclass(frozen=True)
class Sizes:
    """Batches from ``first`` to ``last`` in ``slices`` of blocks as they are written; seeds of all batches and of the largest, and nodes that a seed leads to at most."""

    first: int
    last: int
    slices: int
    seeds: int
    most: int
    each: int

    def slice_of(self, batch):
        return F.floor((batch - self.first) * self.slices / (self.last - self.first + 1)).cast("int")


@dataclass(frozen=True)
class Blocks:
    """edges[k] (batch, src, dst): the block of layer k, the outermost first; nodes[k] (batch, node_id): its sources, nodes[-1] the seeds.

    ``rows``: the edges as they are written under ``path``, with their slice. Only frontiers are
    written, the outermost sources are not.
    """

    edges: list[DataFrame]
    nodes: list[DataFrame]
    observed: tuple = ()
    sizes: Sizes | None = None
    rows: tuple = ()
    path: str = ""

    def counters(self, inputs: int | None = None) -> dict:
        """Nodes and edges of each layer, as the jobs that sampled them observed; ``inputs``: the outermost nodes, which are counted here if no job has."""
        nodes, edges = self.observed
        return {"nodes": [self.nodes[0].count() if inputs is None else inputs, *(o.get["n"] for o in nodes)], "edges": [o.get["n"] for o in edges]}

    def of(self, batches: DataFrame) -> Blocks:
        """The blocks of some batches (batch)."""
        take = lambda f: f.join(F.broadcast(batches), "batch", "left_semi")  # noqa: E731 - a row for each batch of one step
        return replace(self, edges=[take(e) for e in self.edges], nodes=[take(n) for n in self.nodes])

    def between(self, first: int, last: int) -> Blocks:
        """The blocks of the batches from ``first`` to ``last``; other slices aren't read."""
        of, batch = self.sizes.slice_of, F.col("batch")
        near = F.col("slice").between(of(F.lit(first)), of(F.lit(last))) & batch.between(first, last)
        return replace(self, edges=[r.where(near).drop("slice") for r in self.rows], nodes=[n.where(batch.between(first, last)) for n in self.nodes])

    def windows(self, features: DataFrame, width: int) -> int:
        """In how many parts features come to batches, so that a part is not much larger than the features themselves."""
        s = self.sizes
        numbers = s.seeds * s.each * width
        if numbers <= WINDOW_NUMBERS:
            return 1
        return -(-numbers // max(WINDOW_NUMBERS, 2 * width * features.count()))


#: Edges (edge_id, src, dst), or what gives the edges about a frontier (node_id) in chunks, as ``hub_chunks`` does.
Edges = DataFrame | Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def nearby(edges: Edges) -> Edges:
    """Edges for several samples: their arrays by target are written once."""
    if callable(edges):
        return edges
    rows, chunks = hub_chunks(edges.select("edge_id", "src", "dst"))
    near = written(adjacent(rows), new_folder(edges.sparkSession, "near"))
    return lambda frontier: (near, chunks)


def sample(seeds: DataFrame, edges: Edges, fanouts: list[int], draw: str = "") -> Blocks:
    """Blocks of seeds (batch, node_id); the seeds use the last fan-out. A block's sources are its targets and what was sampled.

    Another ``draw`` samples other edges.
    """
    near, path = nearby(edges), new_folder(seeds.sparkSession, "blocks")
    seen: tuple[list, list] = ([], [])

    def made(df: DataFrame, kind: int, name: str, *partitions: str) -> DataFrame:
        observation = Observation()
        seen[kind].insert(0, observation)
        return written(df.observe(observation, F.count(F.lit(1)).alias("n")), f"{path}/{name}", *partitions)

    nodes, rows = [made(seeds.select(*KEYS).distinct(), 0, "seeds")], []
    n = F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))
    most, total, first, last = nodes[0].groupBy("batch").agg(F.count(F.lit(1)).alias("n")).agg(*n, F.coalesce(F.min("batch"), F.lit(0)), F.coalesce(F.max("batch"), F.lit(0))).first()
    each = int(np.prod([1 + f for f in fanouts]))
    sizes = Sizes(first, last, min(SLICES, max(1, -(-total * each // SLICE_IDS)), last - first + 1), total, most, each)
    for layer in range(len(fanouts) - 1, -1, -1):
        found = sample_layer(nodes[0], *near(nodes[0]), fanouts[layer], layer, draw).select("batch", "src", "dst", sizes.slice_of(F.col("batch")).alias("slice"))
        rows.insert(0, made(found, 1, f"layer{layer}", "slice"))
        wider = nodes[0].unionByName(rows[0].select("batch", F.col("src").alias("node_id"))).distinct()
        nodes.insert(0, made(wider, 0, f"frontier{layer}") if layer else wider)
    return Blocks([r.drop("slice") for r in rows], nodes, seen, sizes, tuple(rows), path)


@dataclass(frozen=True)
class Model:
    """A stack of layers of one kind: sage, gcn or gat. ``params``: of each layer, its arrays by name."""

    kind: str
    params: list[dict[str, np.ndarray]]
    heads: int = 1
    dropout: float = 0.0

    def last(self, k: int) -> bool:
        return k == len(self.params) - 1


def start(kind: str, inputs: int, hidden: int, classes: int, layers: int, heads: int = 1, dropout: float = 0.2, seed: int = SEED) -> Model:
    """Random weights: hidden layers of ``hidden`` outputs (of each head, for gat), the last of ``classes``."""
    draw, out, width = np.random.default_rng(seed), [], inputs
    normal = lambda rows, columns: draw.normal(0, 1 / np.sqrt(rows), (rows, columns))
    for k in range(layers):
        size = hidden if k < layers - 1 else classes
        if kind == "sage":
            out.append({"own": normal(width, size), "neigh": normal(width, size), "bias": np.zeros(size)})
        elif kind == "gcn":
            out.append({"weight": normal(width, size), "bias": np.zeros(size)})
        elif kind == "gat":
            out.append({"source": normal(width, heads * size), "target": normal(width, heads * size), "left": normal(heads, size), "right": normal(heads, size), "bias": np.zeros(heads * size)})
        else:
            raise ValueError(f"a model is sage, gcn or gat, not {kind!r}")
        width = heads * size if kind == "gat" else size
    return Model(kind, out, heads if kind == "gat" else 1, 0.0 if kind == "gat" else dropout)


# Activation between layers of sage and gcn: ReLU and dropout, in either order, since a mask of no negative number commutes with it.


def kept_share(batch: np.ndarray, node: np.ndarray, width: int, layer: int, rate: float, draw: int) -> np.ndarray:
    """Dropout's mask by a hash of draw, layer, batch, node and component: 0, or 1 / (1 - rate)."""
    x = batch.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + node.astype(np.uint64) + np.uint64(draw * 64 + layer)
    x = x[:, None] * np.uint64(0xBF58476D1CE4E5B9) + np.arange(1, width + 1, dtype=np.uint64)
    for shift in (30, 27, 31):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(40) >= int(rate * (1 << 24))) / (1 - rate)


def activated(model: Model, k: int, z: np.ndarray, batch: np.ndarray, node: np.ndarray, draw: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(state, derivative) of layer k's outputs; without ``draw`` nothing is dropped."""
    if model.last(k) or model.kind == "gat":
        return z, np.ones_like(z)
    slope = (z > 0).astype(float)
    if draw is not None and model.dropout > 0:
        slope *= kept_share(batch, node, z.shape[1], k, model.dropout, draw)
    return z * slope, slope


def mapped(rows: DataFrame, schema: str, use: Callable[..., Iterator]) -> DataFrame:
    """``use(batches)`` over batches of (batch, node_id, ...) as NumPy arrays, vectors as matrices; it yields columns."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = ([matrix(c) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows)
        for columns in use(arrays):
            yield pa.RecordBatch.from_arrays([vectors(c) if isinstance(c, np.ndarray) and c.ndim == 2 else pa.array(c) for c in columns], names=names)

    return rows.mapInArrow(run, schema)


def params_row(total: np.ndarray) -> tuple:
    return ["params"], np.zeros(1, np.int64), np.zeros(1, np.int64), total[None, :]


def gathered(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of the tasks' parameter rows: in 32 groups first, then one row for the driver."""
    rows = parts.where("part = 'params'").select(F.pmod(F.spark_partition_id(), F.lit(32)).alias("g"), "h")
    once = vector_sums(rows, ["g"], "h").select(F.lit(0).alias("g"), F.col("total").alias("h"))
    got = vector_sums(once, ["g"], "h").collect()  # as many numbers as there are parameters
    return np.array(got[0].total) if got else np.zeros(size)


def flat(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[name].ravel() for name in sorted(params)])


def unflat(x: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name in sorted(like):
        out[name] = x[at : at + like[name].size].reshape(like[name].shape)
        at += like[name].size
    return out


def renamed(states: DataFrame, side: str, *more: str) -> DataFrame:
    return states.select("batch", F.col("node_id").alias(side), *more)


# sage and gcn: a weighted sum over in-edges, the node's own state beside it (sage), one product.


def edge_weights(model: Model, edges: DataFrame) -> DataFrame:
    """batch, src, dst, w: 1 / in-degree (sage), 1 / sqrt(out-degree x in-degree) (gcn), by the block's own degrees."""
    into = edges.groupBy("batch", "dst").agg(F.count(F.lit(1)).alias("i"))
    if model.kind == "sage":
        return edges.join(into, ["batch", "dst"]).select("batch", "src", "dst", F.array(1 / F.col("i")).alias("w"))
    out = edges.groupBy("batch", "src").agg(F.count(F.lit(1)).alias("o"))
    return edges.join(into, ["batch", "dst"]).join(out, ["batch", "src"]).select("batch", "src", "dst", F.array(1 / F.sqrt(F.col("o") * F.col("i"))).alias("w"))


def layer_inputs(model: Model, weighted: DataFrame, targets: DataFrame, h: DataFrame, width: int) -> DataFrame:
    """batch, node_id, h: what the product of a layer reads, of every target."""
    sums = vector_sums(weighted.join(renamed(h, "src", "h"), ["batch", "src"]), ["batch", "dst"], "h", "w").select("batch", F.col("dst").alias("node_id"), "total")
    total = F.coalesce("total", F.array_repeat(F.lit(0.0), width))  # without in-edges
    rows = targets.join(sums, KEYS, "left")
    return rows.join(h, KEYS).select(*KEYS, F.concat("h", total).alias("h")) if model.kind == "sage" else rows.select(*KEYS, total.alias("h"))


def product(model: Model, k: int) -> tuple[np.ndarray, np.ndarray]:
    p = model.params[k]
    return (np.vstack([p["own"], p["neigh"]]) if model.kind == "sage" else p["weight"]), p["bias"]


def dense(model: Model, k: int, rows: DataFrame, draw: int | None) -> DataFrame:
    weights, bias = product(model, k)

    def use(batches):
        for batch, node, x in batches:
            yield batch, node, activated(model, k, x @ weights + bias, batch, node, draw)[0]

    return mapped(rows, STATE, use)


def dense_back(model: Model, k: int, rows: DataFrame, draw: int | None) -> DataFrame:
    """From (batch, node_id, x, g): gradients of what the product read, and one row a task of gradients of parameters."""
    weights, bias = product(model, k)

    def use(batches):
        dw, db = np.zeros_like(weights), np.zeros_like(bias)
        for batch, node, x, g in batches:
            g = g * activated(model, k, x @ weights + bias, batch, node, draw)[1]
            dw += x.T @ g
            db += g.sum(0)
            yield ["state"] * len(node), batch, node, g @ weights.T
        width = len(dw) // 2
        own = {"own": dw[:width], "neigh": dw[width:], "bias": db} if model.kind == "sage" else {"weight": dw, "bias": db}
        yield params_row(flat(own))

    return mapped(rows, PARTS, use)


# gat: a share of each in-edge and head from scalar scores, then a weighted sum of vectors.


def gat_sides(model: Model, k: int, h: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources' z, sources' scores l, targets' scores r)."""
    p, heads = model.params[k], model.heads

    def use(weights, scores):
        def run(batches):
            for batch, node, x in batches:
                z = x @ weights
                yield batch, node, z, (z.reshape(len(z), heads, -1) * scores).sum(2)

        return run

    schema = "batch long, node_id long, z array<double>, s array<double>"
    source = cut(mapped(h.select(*KEYS, "h"), schema, use(p["source"], p["left"])))
    target = mapped(targets.join(h, KEYS).select(*KEYS, "h"), schema, use(p["target"], p["right"]))
    return source.select(*KEYS, "z"), source.select(*KEYS, F.col("s").alias("l")), target.select(*KEYS, F.col("s").alias("r"))


def gat_forward(model: Model, k: int, edges: DataFrame, targets: DataFrame, h: DataFrame) -> tuple[DataFrame, dict]:
    heads, bias = model.heads, model.params[k]["bias"]
    z, left, right = gat_sides(model, k, h, targets)
    shares = cut(L.attention(edges, left, right, heads, ("batch",)))
    sums = vector_sums(shares.join(renamed(z, "src", "z"), ["batch", "src"]), ["batch", "dst"], "z", "share").select("batch", F.col("dst").alias("node_id"), "total")
    out = cut(targets.join(sums, KEYS, "left").select(*KEYS, F.coalesce("total", F.array_repeat(F.lit(0.0), len(bias))).alias("o")))

    def use(batches):
        for batch, node, o in batches:
            x = o + bias
            yield batch, node, x.reshape(len(x), heads, -1).mean(1) if model.last(k) else x

    return mapped(out, STATE, use), {"h": h, "z": z, "shares": shares, "out": out}


def gat_back(model: Model, k: int, saved: dict, g: DataFrame) -> DataFrame:
    """Gradients of the sources' states and of the parameters, from g (batch, node_id, g) of the targets."""
    p, heads = model.params[k], model.heads
    width, last = p["left"].shape[1], model.last(k)

    def at_targets(batches):
        """Each head's gradient, and its product with the head's sum: the softmax needs no more of a target's other edges."""
        for batch, node, o, grad in batches:
            grad = np.tile(grad, heads) / heads if last else grad
            yield ["state"] * len(node), batch, node, np.hstack([grad, (grad * o).reshape(len(o), heads, -1).sum(2)])

    target = cut(mapped(saved["out"].join(g, KEYS).select(*KEYS, "o", "g"), PARTS, at_targets))

    def at_edges(batches):
        for batch, src, dst, share, slope, z, both in batches:
            grad, inner = both[:, :-heads], both[:, -heads:]
            each = (grad * z).reshape(len(z), heads, -1).sum(2)
            score = share * (each - inner) * slope
            yield batch, src, dst, np.hstack([(grad.reshape(len(z), heads, -1) * share[:, :, None]).reshape(len(z), -1), score]), score

    joined = saved["shares"].join(renamed(saved["z"], "src", "z"), ["batch", "src"]).join(target.select("batch", F.col("node_id").alias("dst"), F.col("h").alias("both")), ["batch", "dst"])
    pushed = cut(mapped(joined.select("batch", "src", "dst", "share", "slope", "z", "both"), "batch long, src long, dst long, v array<double>, s array<double>", at_edges))
    to_source = vector_sums(pushed, ["batch", "src"], "v").select("batch", F.col("src").alias("node_id"), F.col("total").alias("v"))
    to_target = vector_sums(pushed, ["batch", "dst"], "s").select("batch", F.col("dst").alias("node_id"), F.col("total").alias("s"))
    none = lambda c, n: F.coalesce(c, F.array_repeat(F.lit(0.0), n)).alias(c)
    rows = saved["h"].join(to_source, KEYS, "left").join(to_target, KEYS, "left").join(target.select(*KEYS, F.slice("h", 1, heads * width).alias("b")), KEYS, "left")

    def at_sources(batches):
        total = {name: np.zeros_like(a) for name, a in p.items()}
        for batch, node, h, v, s, b in batches:
            z, y = (h @ p[name] for name in ("source", "target"))
            gl = v[:, -heads:]
            gz = v[:, :-heads] + (gl[:, :, None] * p["left"]).reshape(len(h), -1)
            gy = (s[:, :, None] * p["right"]).reshape(len(h), -1)
            total["left"] += (z.reshape(len(h), heads, -1) * gl[:, :, None]).sum(0)
            total["right"] += (y.reshape(len(h), heads, -1) * s[:, :, None]).sum(0)
            total["source"] += h.T @ gz
            total["target"] += h.T @ gy
            total["bias"] += b.sum(0)
            yield ["state"] * len(node), batch, node, gz @ p["source"].T + gy @ p["target"].T
        yield params_row(flat(total))

    return cut(mapped(rows.select(*KEYS, "h", none("v", heads * width + heads), none("s", heads), none("b", heads * width)), PARTS, at_sources))


# Stacks. Batches that fit a task are worked on whole (``local_models``), larger ones by joins.

#: Numbers that the states of a layer of one batch may hold (64 MB) to be worked on whole.
LOCAL_NUMBERS = 1 << 23


def widest(model: Model) -> tuple[int, int]:
    """(inputs of the first layer, greatest width of a state or product)."""
    rows = [len(p["source"]) if model.kind == "gat" else len(next(iter(p[name] for name in ("own", "weight") if name in p))) for p in model.params]
    return rows[0], max(*rows, *(len(p["bias"]) for p in model.params))


def fits(model: Model, blocks: Blocks) -> bool:
    """Whether the largest batch, edges and nodes, fits a task."""
    if 2 * blocks.sizes.most * blocks.sizes.each * widest(model)[1] <= LOCAL_NUMBERS:  # as large as it can be
        return True
    size = None
    for f in (blocks.nodes[0], *blocks.edges):
        n = f.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
        size = n if size is None else size.unionByName(n)
    most = size.groupBy("batch").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    return most * widest(model)[1] <= LOCAL_NUMBERS


def forward(model: Model, blocks: Blocks, features: DataFrame, draw: int | None = None) -> tuple[DataFrame, list[dict]]:
    """(batch, node_id, h of the seeds: class scores; what each layer keeps for the way back, nothing where batches are worked on whole).

    Features come to the batches of a window at a time, and only a window's scores stay.
    """
    if not fits(model, blocks):
        return spread(model, blocks, features, draw)
    width, s, use = widest(model)[0], blocks.sizes, lambda b: M.forward(model, b, activated, product, draw)
    scores = lambda some: M.scored(M.rows_of(some, features), len(blocks.edges), width, use, STATE)
    parts = min(blocks.windows(features, width), s.last - s.first + 1)
    if parts == 1:
        return scores(blocks), []
    spark = features.sparkSession
    features, path, every = written(features.select("node_id", "h"), new_folder(spark, "features")), new_folder(spark, "scores"), s.last - s.first + 1
    for k in range(parts):
        written(scores(blocks.between(s.first + k * every // parts, s.first + (k + 1) * every // parts - 1)), f"{path}/window={k}")
    return spark.read.schema(f"{STATE}, window int").parquet(path).drop("window"), []


def sums_of(model: Model, batches: Iterator[bytes], draw: int | None) -> np.ndarray | None:
    """Gradients of all parameters, end to end, the loss and the labelled seeds, over packed batches."""
    classes, total = len(model.params[-1]["bias"]) // model.heads, None
    for data in batches:
        g = M.gradient(model, pickle.loads(data), classes, activated, product, flat, draw)
        total = g if total is None else total + g
    return total


def means_of(model: Model, total: np.ndarray | None) -> tuple[list[dict[str, np.ndarray]], float, int]:
    loss, n = (0.0, 0) if total is None else total[-2:]
    if not n:
        return [{name: np.zeros_like(a) for name, a in p.items()} for p in model.params], 0.0, 0
    return [{name: a / n for name, a in p.items()} for p in layered(model, total)], float(loss / n), int(n)


def layered(model: Model, whole: np.ndarray) -> list[dict[str, np.ndarray]]:
    """All parameters, end to end, as the arrays of layers."""
    out, at = [], 0
    for p in model.params:
        size = sum(a.size for a in p.values())
        out.append(unflat(whole[at : at + size], p))
        at += size
    return out


def local_gradients(model: Model, data: DataFrame, draw: int | None) -> tuple[list[dict[str, np.ndarray]], float, int]:
    """``gradients`` over rows (data) of packed batches, in one job: a task adds up its batches, and sends one row of as many numbers as there are parameters."""

    def use(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sums_of(model, (b.as_py() for batch in batches for b in batch.column(0)), draw)
        if total is not None:
            yield pa.RecordBatch.from_arrays([vectors(total[None, :])], names=["g"])

    rows = data.select("data").coalesce(32).mapInArrow(use, "g array<double>").collect()  # a row a task, of 32 at most
    return means_of(model, np.sum([r.g for r in rows], axis=0) if rows else None)


def stepped(model: Model, adam: Adam, state: tuple, grads: list[dict[str, np.ndarray]]) -> tuple[Model, tuple]:
    """The model and Adam's state after one step."""
    whole = np.concatenate([flat(p) for p in model.params])
    whole, state = adam.step(whole, np.concatenate([flat(g) for g in grads]), state)
    return replace(model, params=layered(model, whole)), state


def folded(model: Model, adam: Adam, state: tuple, data: DataFrame, draw: int) -> tuple[Model, tuple, list[tuple[int, float]]]:
    """One step after the other over packed batches (step, batch, data) of bounded size, all in one task: steps depend on each other, and a job for each would cost more than a step.

    (model, Adam's state, (step, mean loss before it)); ``draw``: that of the first step.
    """

    def use(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for part in batches:
            for step, batch, packed in zip(*(part.column(c) for c in ("step", "batch", "data")), strict=True):
                held.setdefault(step.as_py(), []).append((batch.as_py(), packed.as_py()))
        at, now, said = model, state, []
        for step in sorted(held):
            grads, loss, n = means_of(at, sums_of(at, (b for _, b in sorted(held.pop(step))), draw + len(said)))
            if n:
                said.append((step, loss))
                at, now = stepped(at, adam, now, grads)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((at.params, now, said))], pa.binary())], names=["done"])

    rows = data.select("step", "batch", "data").coalesce(1).mapInArrow(use, "done binary").collect()  # one row: parameters and a number a step
    if not rows:
        return model, state, []
    params, state, said = pickle.loads(rows[0].done)
    return replace(model, params=params), state, said


def spread(model: Model, blocks: Blocks, features: DataFrame, draw: int | None = None) -> tuple[DataFrame, list[dict]]:
    """(batch, node_id, h of the seeds: class scores; what each layer keeps for the way back).

    ``features``: node_id, h. gat's scores are the means over heads, without the final log-softmax,
    which the cross-entropy holds and ``predict`` doesn't need.
    """
    h = cut(blocks.nodes[0].join(features.select("node_id", F.col("h").cast("array<double>").alias("h")), "node_id").select(*KEYS, "h"))
    kept = []
    for k in range(len(model.params)):
        if model.kind == "gat":
            h, saved = gat_forward(model, k, blocks.edges[k], blocks.nodes[k + 1], h)
            h = cut(h)
        else:
            weighted = cut(edge_weights(model, blocks.edges[k]))
            weights = product(model, k)[0]
            x = cut(layer_inputs(model, weighted, blocks.nodes[k + 1], h, len(weights) // (2 if model.kind == "sage" else 1)))
            h, saved = dense(model, k, x, draw), {"edges": weighted, "x": x}
        kept.append(saved)
    return h, kept


def loss_gradients(scores: DataFrame, labels: DataFrame, classes: int) -> DataFrame:
    """Parts of (batch, node_id, h): the cross-entropy's gradient of each seed (not divided by their number), and a row a task of the loss and the seeds. A label outside the classes raises."""

    def use(batches):
        total = np.zeros(2)
        for batch, node, z, label in batches:
            if label.min() < 0 or label.max() >= classes:
                raise ValueError("a label is not a class")
            z = z - z.max(1, keepdims=True)
            log_p = z - np.log(np.exp(z).sum(1, keepdims=True))
            error, at = np.exp(log_p), np.arange(len(z))
            error[at, label] -= 1
            total += [-log_p[at, label].sum(), len(z)]
            yield ["state"] * len(node), batch, node, error
        yield params_row(total)

    return cut(mapped(scores.join(labels.select("node_id", F.col("label").cast("long").alias("label")), "node_id").select(*KEYS, "h", "label"), PARTS, use))


def gradients(model: Model, blocks: Blocks, features: DataFrame, labels: DataFrame, draw: int | None = None) -> tuple[list[dict[str, np.ndarray]], float, int]:
    """(mean gradients of every parameter, mean loss, labelled seeds) over all batches of the blocks; seeds without a label don't count."""
    if fits(model, blocks):
        return local_gradients(model, M.packed(M.rows_of(blocks, features, labels), len(blocks.edges), widest(model)[0], model.kind), draw)
    return spread_gradients(model, blocks, features, labels, draw)


def spread_gradients(model: Model, blocks: Blocks, features: DataFrame, labels: DataFrame, draw: int | None = None) -> tuple[list[dict[str, np.ndarray]], float, int]:
    """The same by joins, for batches of any size."""
    scores, kept = spread(model, blocks, features, draw)
    classes = len(model.params[-1]["bias"]) // model.heads
    parts = loss_gradients(scores, labels, classes)
    loss, n = gathered(parts, 2)
    if not n:
        return [{name: np.zeros_like(a) for name, a in p.items()} for p in model.params], 0.0, 0
    out: list[dict[str, np.ndarray]] = []
    for k in range(len(model.params) - 1, -1, -1):
        g = parts.where("part = 'state'").select(*KEYS, F.col("h").alias("g"))
        if model.kind == "gat":
            parts = gat_back(model, k, kept[k], g)
        else:
            parts = cut(dense_back(model, k, kept[k]["x"].select(*KEYS, F.col("h").alias("x")).join(g, KEYS).select(*KEYS, "x", "g"), draw))
        size = sum(a.size for a in model.params[k].values())
        out.insert(0, {name: a / n for name, a in unflat(gathered(parts, size), model.params[k]).items()})
        if model.kind != "gat" and k:
            parts = to_sources(model, kept[k]["edges"], parts, len(product(model, k)[0]))
    return out, float(loss / n), int(n)


def to_sources(model: Model, weighted: DataFrame, parts: DataFrame, width: int) -> DataFrame:
    """Gradients of the sources' states: over the edges backwards, and each node's own."""
    rows = parts.where("part = 'state'").select(*KEYS, "h")
    half = width // 2
    own, along = (rows.select(*KEYS, F.slice("h", 1, half).alias("h")), rows.select(*KEYS, F.slice("h", half + 1, half).alias("h"))) if model.kind == "sage" else (None, rows)
    pushed = weighted.join(renamed(along, "dst", "h"), ["batch", "dst"]).select("batch", F.col("src").alias("node_id"), "h", "w")
    every = pushed if own is None else pushed.unionByName(own.withColumn("w", F.array(F.lit(1.0))))
    return cut(vector_sums(every, KEYS, "h", "w").select(F.lit("state").alias("part"), *KEYS, F.col("total").alias("h")))


@dataclass(frozen=True)
class Adam:
    """Adam with weight decay in the gradient."""

    rate: float = 0.01
    decay: float = 0.001
    betas: tuple[float, float] = (0.9, 0.999)

    def step(self, params: np.ndarray, gradient: np.ndarray, state: tuple[np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, tuple]:
        first, second, t = state
        a, b = self.betas
        g = gradient + self.decay * params
        first, second, t = a * first + (1 - a) * g, b * second + (1 - b) * g * g, t + 1
        return params - self.rate * (first / (1 - a**t)) / (np.sqrt(second / (1 - b**t)) + 1e-8), (first, second, t)


def train(
    model: Model, seeds: DataFrame, edges: Edges, features: DataFrame, labels: DataFrame, fanouts: list[int], epochs: int = 1, adam: Adam = Adam(), sampled: list[dict] | None = None
) -> tuple[Model, list[tuple[int, int, float]]]:
    """(trained model, (epoch, step, mean loss before the step)): one Adam step a global batch, in the order of ``step``.

    ``seeds``: step, batch, node_id; all batches of a step are worked on at once, as ranks that
    average their gradients. Every epoch samples blocks of its own; ``sampled`` takes their counters.
    Features come to the batches of some steps at a time, and what was made for them goes once they are done.
    """
    spark = seeds.sparkSession
    base = new_folder(spark, "training")
    seeds, features, labels = (written(f, f"{base}/{name}") for f, name in ((seeds.select("step", *KEYS), "seeds"), (features.select("node_id", "h"), "features"), (labels, "labels")))
    ends = seeds.groupBy("step").agg(F.min("batch").alias("first"), F.max("batch").alias("last"), F.count(F.lit(1)).alias("n"))
    steps, near = sorted(tuple(r) for r in ends.collect()), nearby(edges)  # a row a step
    size, said = sum(a.size for p in model.params for a in p.values()), []
    state = (np.zeros(size), np.zeros(size), 0)
    for epoch in range(1, epochs + 1):
        blocks = sample(seeds, near, fanouts, "" if epoch == 1 else f"epoch{epoch}")
        if fits(model, blocks):
            model, state, losses, inputs = whole_steps(model, adam, state, steps, seeds, blocks, features, labels, len(said), fanouts)
            said += [(epoch, step, loss) for step, loss in losses]
        else:
            inputs = None
            for step, *_ in steps:
                of = blocks.of(seeds.where(F.col("step") == step).select("batch").distinct())
                grads, loss, n = spread_gradients(model, of, features, labels, draw=len(said))
                if n:
                    said.append((epoch, step, loss))
                    model, state = stepped(model, adam, state, grads)
        if sampled is not None:
            sampled.append(blocks.counters(inputs))
        dropped(spark, blocks.path)
    dropped(spark, base)
    return model, said


def whole_steps(
    model: Model, adam: Adam, state: tuple, steps: list[tuple], seeds: DataFrame, blocks: Blocks, features: DataFrame, labels: DataFrame, draw: int, fanouts: list[int]
) -> tuple[Model, tuple, list[tuple[int, float]], int]:
    """An epoch's steps (step, first and last batch, seeds) over batches that fit a task: (model, Adam's state, (step, loss), nodes sampled).

    A window of steps is packed by batch once, in parts of bounded size. Steps of a part are taken one after
    the other in one task; a step that fills a part alone is dealt to several tasks.
    """
    spark, width, said, inputs = seeds.sparkSession, widest(model)[0], [], 0
    if not steps:
        return model, state, said, inputs
    numbers = max(n for *_, n in steps) * (blocks.sizes.each * width if model.kind == "gat" else blocks.sizes.each // (1 + fanouts[0]) * len(product(model, 0)[0]))
    each, many = max(1, LOCAL_NUMBERS // numbers), min(len(steps), blocks.windows(features, width))
    for k in range(many):
        mine = steps[k * len(steps) // many : (k + 1) * len(steps) // many]
        lo, hi = min(s[1] for s in mine), max(s[2] for s in mine)
        part = {s[0]: at // each for at, s in enumerate(mine)}
        of = seeds.where(F.col("step").between(mine[0][0], mine[-1][0])).select("step", "batch").distinct()
        of = of.join(F.broadcast(spark.createDataFrame(list(part.items()), "step long, part int")), "step")
        some = blocks if many == 1 else blocks.between(lo, hi)
        packed = M.packed(M.rows_of(some, features, labels), len(blocks.edges), width, model.kind)
        seen, path = Observation(), new_folder(spark, "steps")
        rows = written(packed.join(F.broadcast(of), "batch").observe(seen, F.sum("nodes").alias("n")), path, "part")  # a row a batch
        inputs += seen.get["n"] or 0
        for p in range(part[mine[-1][0]] + 1):
            data = rows.where(F.col("part") == p)
            if numbers <= LOCAL_NUMBERS:
                model, state, losses = folded(model, adam, state, data, draw + len(said))
                said += losses
                continue
            grads, loss, n = local_gradients(model, data, draw + len(said))
            if n:
                said.append((mine[p][0], loss))
                model, state = stepped(model, adam, state, grads)
        dropped(spark, path)
    return model, state, said, inputs


def predict(model: Model, seeds: DataFrame, edges: Edges, features: DataFrame, fanouts: list[int]) -> DataFrame:
    """batch, node_id, h (class scores), predicted: the seeds (batch, node_id) through sampled blocks, nothing dropped."""
    h, _ = forward(model, sample(seeds, edges, fanouts), features)
    return h.select(*KEYS, "h", (F.array_position("h", F.array_max("h")) - 1).alias("predicted"))
