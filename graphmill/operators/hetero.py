"""Graphs of several node and edge types: loaded against a schema, sampled by relation, run through stacks of layers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions.arrays import Packed, packed
from graphmill.functions.ordering import cut
from graphmill.operators import layers as L
from graphmill.operators.graph import hub_chunks, sample_layer

HOW = {"rgcn": "mean", "rsage": "sum", "rgat": "sum"}


@dataclass(frozen=True)
class Schema:
    """Node types with their numbers of nodes (ids from 0), and relations as (source type, target type)."""

    counts: dict[str, int]
    relations: dict[str, tuple[str, str]]

    def __post_init__(self) -> None:
        for name, ends in self.relations.items():
            if missing := [k for k in ends if k not in self.counts]:
                raise ValueError(f"relation {name!r} joins unknown node types: {', '.join(missing)}")

    def offsets(self) -> dict[str, int]:
        """Where each type begins when all nodes are numbered as one graph, in the order of the types."""
        out, at = {}, 0
        for kind, n in self.counts.items():
            out[kind], at = at, at + n
        return out


@dataclass(frozen=True)
class HeteroGraph:
    """edges (src, dst) by relation, nodes (node_id) and features (node_id, h) by type; nodes without edges or features are there."""

    schema: Schema
    edges: dict[str, DataFrame]
    nodes: dict[str, DataFrame]
    features: dict[str, DataFrame]

    def homogeneous(self) -> DataFrame:
        """rel, src, dst with the ids of one graph."""
        at, out = self.schema.offsets(), None
        for rel, (source, target) in self.schema.relations.items():
            part = self.edges[rel].select(F.lit(rel).alias("rel"), (F.col("src") + at[source]).alias("src"), (F.col("dst") + at[target]).alias("dst"))
            out = part if out is None else out.unionByName(part)
        return out


def load(spark: SparkSession, schema: Schema, edges: dict[str, DataFrame], features: dict[str, DataFrame]) -> HeteroGraph:
    """A graph whose tables fit the schema: an edge or a feature of a node that the counts don't have raises. Nodes without features have zeros."""
    if set(edges) != set(schema.relations) or set(features) != set(schema.counts):
        raise ValueError("edges and features must name the schema's relations and node types")
    every = None
    for what, rows, columns in [*((rel, edges[rel], ("src", "dst")) for rel in schema.relations), *((kind, features[kind], ("node_id",)) for kind in schema.counts)]:
        part = rows.select(*(F.col(c).cast("long").alias(n) for c, n in zip((*columns, columns[0])[:2], ("a", "b"), strict=True)))
        part = part.agg(F.min("a"), F.max("a"), F.min("b"), F.max("b")).toDF("least_a", "most_a", "least_b", "most_b").select(F.lit(what).alias("what"), F.lit(len(columns) == 2).alias("edge"), "*")  # edges are read once
        every = part if every is None else every.unionByName(part)
    for r in every.collect():  # a row a relation and a node type
        ends = schema.relations[r.what] if r.edge else (r.what,)
        for side, kind, least, most in zip(("source", "target"), ends, (r.least_a, r.least_b), (r.most_a, r.most_b), strict=False):
            if least is not None and (least < 0 or most >= schema.counts[kind]):
                raise ValueError(f"{f'{r.what}, {side}' if r.edge else f'features of {kind}'}: ids from {least} to {most} don't fit {schema.counts[kind]} nodes of {kind}")
    nodes, filled = {}, {}
    for kind, n in schema.counts.items():
        nodes[kind] = spark.range(n).withColumnRenamed("id", "node_id")
        first = features[kind].select(F.size("h").alias("n")).first()
        zeros = F.array_repeat(F.lit(0.0), first.n if first else 0)
        filled[kind] = nodes[kind].join(features[kind].select("node_id", F.col("h").cast("array<double>").alias("h")), "node_id", "left").select("node_id", F.coalesce("h", zeros).alias("h"))
    return HeteroGraph(schema, edges, nodes, filled)


def sample(graph: HeteroGraph, kind: str, seeds: DataFrame, fanouts: list[int]) -> tuple[list[dict[str, DataFrame]], dict[str, DataFrame]]:
    """(blocks by layer, outermost first, and relation; input nodes by type) of seeds (batch, node_id) of one type.

    Each relation into a frontier's type gives up to the layer's fan-out of in-edges a node; the next
    frontier holds the targets and the sampled sources of every type. Edges need edge_id, src, dst.
    """
    frontier = {kind: cut(seeds.select("batch", "node_id").distinct())}
    dealt = {rel: hub_chunks(e.select("edge_id", "src", "dst")) for rel, e in graph.edges.items()}
    blocks: list[dict[str, DataFrame]] = []
    for layer in range(len(fanouts) - 1, -1, -1):
        found = {rel: cut(sample_layer(frontier[target], *dealt[rel], fanouts[layer], layer, rel).select("batch", "src", "dst", "edge_id")) for rel, (_, target) in graph.schema.relations.items() if target in frontier}
        blocks.insert(0, found)
        grown = dict(frontier)
        for rel, block in found.items():
            source = graph.schema.relations[rel][0]
            near = block.select("batch", F.col("src").alias("node_id"))
            grown[source] = grown[source].unionByName(near) if source in grown else near
        frontier = {k: cut(f.distinct()) for k, f in grown.items()}
    return blocks, frontier


@dataclass(frozen=True)
class Stack:
    """Layers of one kind (rgcn, rsage, rgat): arrays by relation and name in each; ``head``: weights and bias of the class scores of one type."""

    kind: str
    layers: list[dict[str, dict[str, np.ndarray]]]
    head: tuple[np.ndarray, np.ndarray]
    target: str
    heads: int = 4


def relation_layer(stack: Stack, p: dict[str, np.ndarray], edges: DataFrame, source: DataFrame, target: DataFrame, near: Packed | None = None) -> DataFrame:
    """node_id, h of the targets that a relation reaches."""
    if stack.kind == "rgcn":
        return L.relation_gcn(edges, source, p["weight"], p["bias"], near)
    if stack.kind == "rsage":
        return L.relation_sage(edges, source, target, p["weight"], p["bias"], near)
    out = L.gat_layer(edges, source, p["weight"], p["left"], p["right"], p["bias"], target=target)
    return out.join(edges.select(F.col("dst").alias("node_id")).distinct(), "node_id", "left_semi")


def speaking(stack: Stack, schema: Schema) -> list[list[str]]:
    """The relations of each layer whose results the scores of the target type depend on."""
    have, speak = [set(schema.counts)], []
    for _ in stack.layers:
        speak.append([rel for rel, ends in schema.relations.items() if have[-1].issuperset(ends)])
        have.append({schema.relations[rel][1] for rel in speak[-1]})
    if stack.target not in have[-1]:
        raise ValueError(f"no relation leads to {stack.target!r}")
    wanted = {stack.target}
    for k in range(len(speak) - 1, -1, -1):
        speak[k] = [rel for rel in speak[k] if schema.relations[rel][1] in wanted]
        wanted = {kind for rel in speak[k] for kind in schema.relations[rel][: 1 if stack.kind == "rgcn" else 2]}
    return speak


def forward(stack: Stack, graph: HeteroGraph) -> DataFrame:
    """node_id, h: class scores of every node of the target type.

    A layer gives states to the types that relations lead to, the mean (rgcn) or sum of what its
    relations say, with ReLU between layers; a node that none reaches has zeros, and a type that none
    leads to has no states, so that its relations say nothing from then on. States that no score
    depends on aren't worked out. Edges are packed once for all layers.
    """
    states, speak, near = dict(graph.features), speaking(stack, graph.schema), {}
    pairs = {rel: graph.edges[rel].select("src", "dst") for rel in graph.schema.relations}
    if stack.kind != "rgat":
        for rel in {rel for said in speak for rel in said}:
            widths = [len(p[rel]["weight"]) for p, said in zip(stack.layers, speak, strict=True) if rel in said]
            near[rel] = packed(pairs[rel], max(widths), again=len(widths) > 1)
    for k, params in enumerate(stack.layers):
        parts: dict[str, list[DataFrame]] = {}
        for rel in speak[k]:
            source, target = graph.schema.relations[rel]
            parts.setdefault(target, []).append(relation_layer(stack, params[rel], pairs[rel], states[source], states.get(target), near.get(rel)))
        width = len(next(iter(params.values()))["bias"])
        states = {}
        for kind, frames in parts.items():
            h = graph.nodes[kind].join(L.across_relations(frames, HOW[stack.kind]), "node_id", "left").select("node_id", F.coalesce("h", F.array_repeat(F.lit(0.0), width)).alias("h"))
            states[kind] = cut(h if k == len(stack.layers) - 1 else h.withColumn("h", L.relu("h")))
    return states[stack.target].select("node_id", L.linear("h", *stack.head).alias("h"))
