"""Whole runs driven by ``Settings``, over a graph that is prepared once.

``prepare`` writes what depends on the graph and its split alone: the CSC arrays by blocks of
targets, colors with their nearest colors and scores, and the order of each split's nodes. A run
reads these tables: batches are dealt to machines, blocks are sampled from the files' blocks that a
frontier lies in, a model is trained on them and judged on the test nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.config import LEVELS, SEED_RATE, TOP, Settings
from graphmill.functions.ordering import cut, dense_index
from graphmill.operators import block_models as B
from graphmill.operators import graph as G
from graphmill.sources import files

SPLITS = ("train", "val", "test")


@dataclass(frozen=True)
class Prepared:
    """The tables of a prepared graph under ``path``."""

    spark: SparkSession
    path: str

    def order(self, split: str) -> DataFrame:
        """pos, node_id of the labelled nodes of a split: training nodes permuted, others by id."""
        return self.spark.read.parquet(f"{self.path}/order").where(F.col("split") == split).select("pos", "node_id")

    def labels(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/order").select("node_id", "label")

    def colors(self) -> DataFrame:
        """node_id, color of the nodes that have one."""
        return files.read_colors(self.spark, f"{self.path}/colors")[0].where("color > 0")

    def affinity(self, top: int) -> DataFrame:
        """color, neigh_color, affinity: at most ``top`` near colors of each."""
        _, near, scores = files.read_colors(self.spark, f"{self.path}/colors")
        slots = F.explode(F.slice(F.arrays_zip("neighbors", "scores"), 1, top)).alias("slot")
        return near.join(scores, "color").select("color", slots).select("color", F.col("slot.neighbors").alias("neigh_color"), F.col("slot.scores").alias("affinity")).where("neigh_color > 0")

    def edges(self, frontier: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Edges of the files' blocks that a frontier (node_id) lies in, in chunks; hubs are known from ``indptr``, no edge is counted."""
        indptr, indices = files.blocks_of(self.spark, f"{self.path}/csc", frontier)
        degree = F.col("last") - F.col("first")
        hubs = indptr.where(degree > G.HUB).select(F.col("node_id").alias("dst"), F.ceil(degree / G.HUB).alias("chunks"))
        return G.with_chunks(indices.select("edge_id", "src", "dst"), hubs), hubs


def prepare(nodes: DataFrame, edges: DataFrame, path: str, rate: float = SEED_RATE, levels: int = LEVELS, top: int = TOP) -> Prepared:
    """Writes the tables of a graph: nodes (node_id, split, label), edges (edge_id, src, dst).

    Self loops are replaced by one a node. Seeds are drawn from the training nodes at ``rate`` of
    all nodes (at most 20 times as often). Nodes with no split or no label are no seeds of batches,
    but train nodes without a label may be seeds of colors. An empty graph raises ValueError.
    """
    spark = nodes.sparkSession
    nodes = cut(nodes.select("node_id", "split", F.when(G.labeled("label"), F.col("label")).alias("label")))
    train = nodes.where("split = 'train'").select("node_id")
    total, trained = nodes.count(), train.count()
    if not trained:
        raise ValueError("there is no training node")
    normal = cut(G.normalize_loops(edges, nodes))
    files.write_csc(G.adjacency(normal), G.indptr(normal, nodes), f"{path}/csc")
    colors = cut(G.color_graph(normal, cut(G.seeds(train, train, rate * min(20, total / trained))), train, levels))
    files.write_colors(colors, nodes, G.neighbor_matrix(G.affinity(normal, colors, top), top), f"{path}/colors")
    orders = None
    for split in SPLITS:
        ids = nodes.where((F.col("split") == split) & F.col("label").isNotNull()).select("node_id")
        order = G.train_order(ids) if split == "train" else dense_index(ids, "pos", "node_id").select("pos", "node_id")
        rows = order.join(nodes.select("node_id", "label"), "node_id").select("pos", "node_id", "label", F.lit(split).alias("split"))
        orders = rows if orders is None else orders.unionByName(rows)
    orders.write.mode("overwrite").partitionBy("split").parquet(f"{path}/order")
    return Prepared(spark, path)


def batches(graph: Prepared, s: Settings, split: str = "train", whole: bool = False) -> DataFrame:
    """step, pos, node_id, machine, gpu, batch of a split's nodes, dealt as ``s.distribution`` says.

    Training drops the last global batches, as loaders do; ``whole`` keeps every node. Colors' lines
    lie on machine color % machines until a cache says otherwise.
    """
    order = graph.order(split)
    total = order.count()
    rows = G.striped(order, s.batch_size, s.gpus, s.machines, total + (s.global_batch - 1 if whole else 0), drop_last=not whole)
    if s.distribution == "node_color":
        colors = graph.colors()
        resident = colors.groupBy("color").agg(F.count(F.lit(1)).alias("resident")).withColumn("machine", (F.col("color") % s.machines).cast("int"))
        rows = G.distribute(G.scores(rows, colors, graph.affinity(s.top), resident, s.machines), s.domain_batch, s.batch_size, s.machines)
    rank = F.col("machine") * s.gpus + F.col("gpu")
    return rows.select("step", "pos", "node_id", F.col("machine").cast("long").alias("machine"), F.col("gpu").cast("long").alias("gpu"), (F.col("step") * s.machines * s.gpus + rank).cast("long").alias("batch"))


def blocks(graph: Prepared, s: Settings, split: str = "train", whole: bool = False) -> B.Blocks:
    """The blocks of all batches of a split, from the written graph."""
    return B.sample(cut(batches(graph, s, split, whole)), graph.edges, s.fanouts)


@dataclass(frozen=True)
class Report:
    """What a run says: losses (epoch, step, loss), counters of what each epoch sampled, accuracy in percent over so many test nodes."""

    model: B.Model
    losses: list[tuple[int, int, float]]
    sampled: list[dict]
    accuracy: float | None
    tested: int


def run(graph: Prepared, features: DataFrame, inputs: int, classes: int, s: Settings) -> Report:
    """Trains ``s.model`` for ``s.epochs`` and judges it on every labelled test node; ``features``: node_id, h of ``inputs`` components.

    A label outside of 0 to ``classes`` - 1 raises. Without a whole global batch nothing is trained;
    without test nodes the accuracy is None.
    """
    counters: list[dict] = []
    features = cut(features)
    model = B.start(s.model, inputs, s.hidden_channels, classes, s.num_layers, s.num_heads, s.dropout)
    adam = B.Adam(s.learning_rate, s.decay)
    model, losses = B.train(model, batches(graph, s), graph.edges, features, graph.labels(), s.fanouts, s.epochs, adam, counters)
    found = B.predict(model, cut(batches(graph, s, "test", whole=True)), graph.edges, features, s.fanouts)
    right = F.avg((F.col("predicted") == F.col("label")).cast("int")) * 100
    row = found.join(graph.labels(), "node_id").agg(right.alias("accuracy"), F.count(F.lit(1)).alias("n")).first()
    return Report(model, losses, counters, row.accuracy, row.n)
