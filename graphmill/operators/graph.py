"""Graph construction, splits, coloring, affinity, distribution, sampling, fetch, cache, message passing."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.config import BACKENDS, TOP
from graphmill.functions.ordering import accepted, cut, dealt_in_order, dense_index, numbered, order_key, place_in_partition

SEED = 42


#: Edges of one target that stay together where edges are dealt by target; a hub has several such chunks.
HUB = 1 << 17


def adjacency(edges: DataFrame) -> DataFrame:
    """CSC rows: the sources of a node's in-edges, in edge order.

    Edges lie in range partitions of (dst, edge_id), so a hub spans tasks: each counts its own rows,
    and a partition that goes on with a target adds what earlier ones hold of it.
    """
    dealt = dealt_in_order(edges.select("dst", "edge_id", "src"), "dst", "edge_id")
    partition, _ = place_in_partition()
    placed = dealt.select("dst", "edge_id", "src", partition.alias("part"))
    heads = placed.groupBy("part").agg(F.min("dst").alias("dst"))  # a row a partition: only its first target may have begun before
    parts = placed.join(F.broadcast(heads.select("dst").distinct()), "dst").groupBy("dst", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("dst").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.withColumn("before", before).join(heads, ["part", "dst"]).where("before > 0").select("part", "dst", "before")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places within runs of a target; a run may go on in the next batch."""
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            dst = batch.column(0).to_numpy()
            first = np.flatnonzero(np.append(True, dst[1:] != dst[:-1]))
            sizes = np.diff(np.append(first, len(dst)))
            place = np.arange(len(dst)) - np.repeat(first, sizes)
            if dst[0] == last:
                place[: sizes[0]] += seen
            last, seen = dst[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=["dst", "edge_id", "src", "part", "place"])

    local = placed.mapInArrow(count, "dst long, edge_id long, src long, part int, place long")
    return local.join(F.broadcast(offsets), ["part", "dst"], "left").select("dst", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "src", "edge_id")


def indptr(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, first, last (exclusive): running sums of in-degrees, by blocks of node ids."""
    degree = nodes.select("node_id").join(edges.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("degree")), "node_id", "left").fillna(0, ["degree"]).withColumn("block", F.floor(F.col("node_id") / 4096))
    blocks = degree.groupBy("block").agg(F.sum("degree").alias("all"))
    base = blocks.select("block", (F.sum("all").over(Window.orderBy("block")) - F.col("all")).alias("base"))  # a row for 4,096 nodes
    last = F.col("base") + F.sum("degree").over(Window.partitionBy("block").orderBy("node_id"))
    return degree.join(base, "block").select("node_id", (last - F.col("degree")).cast("long").alias("first"), last.cast("long").alias("last"))


def normalize_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Self loops go; every node gets one, with the highest edge ids."""
    top = edges.agg(F.max("edge_id").alias("top"))
    loops = nodes.crossJoin(F.broadcast(top)).select((F.col("top") + 1 + F.col("node_id")).alias("edge_id"), F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    return edges.where("src <> dst").select("edge_id", "src", "dst").unionByName(loops)


def positional_split(nodes: DataFrame, total: int, labeled: int | None = None) -> DataFrame:
    n = total if labeled is None else labeled
    a, b = int(n * 0.6), int(n * 0.6) + int(n * 0.2)
    i = F.col("node_id")
    return nodes.select("node_id", F.when(i < a, "train").when(i < b, "val").when(i < n, "test").otherwise(F.lit(None)).alias("split"))


def index_split(nodes: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """node_id, split by lists of ids (node_id); an id of several lists belongs to the first, nodes of none have null."""
    named = None
    for k, (name, ids) in enumerate(lists.items()):
        part = ids.select("node_id", F.struct(F.lit(k).alias("k"), F.lit(name).alias("name")).alias("s"))
        named = part if named is None else named.unionByName(part)
    first = named.groupBy("node_id").agg(F.min("s")["name"].alias("split"))
    return nodes.select("node_id").join(first, "node_id", "left")


def labeled(label: str):
    """Neither null nor NaN."""
    return F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double"))


def seeds(nodes: DataFrame, train: DataFrame, rate: float) -> DataFrame:
    """node_id, color: accepted train nodes, numbered from 1 in id order."""
    drawn = train.where(accepted(rate, SEED, "seed", F.col("node_id"))).select("node_id")
    return dense_index(drawn, "c", "node_id").select("node_id", (F.col("c") + 1).alias("color"))


def color_graph(edges: DataFrame, start: DataFrame, train: DataFrame | None, levels: int = 10) -> DataFrame:
    """node_id, color, hop: multi-source walk against the edges; the last claim wins, each level.

    Claims carry (generation, claimant's rank, edge); the greatest wins. Edges of a claimant stand for
    their places among its in-edges, so that nothing is sorted over all edges. With ``train``, level
    0 also claims the seeds' in-neighbours among the train nodes.
    """
    adj, chunks = by_target(edges)
    last = edges.agg(F.max("edge_id")).first()[0] or 0
    zero = F.lit(0).cast("long")
    cand = start.select("node_id", zero.alias("g"), F.col("color").alias("r"), zero.alias("p"), "color")
    if train is not None:
        near = reached(start, adj, chunks).select("node_id", F.lit(1).cast("long").alias("g"), F.col("color").alias("r"), "p", "color")
        cand = cand.unionByName(near.join(train.select("node_id"), "node_id", "left_semi").select(cand.columns))
    colored, most = None, start.agg(F.max("color")).first()[0] or 0
    for hop in range(1, levels + 1):
        win = cand.select("node_id", "color", claim(most, last).alias("k")).groupBy("node_id").agg(F.max_by("color", "k").alias("color"), F.max("k").alias("k"))
        win = win if colored is None else win.join(colored.select("node_id"), "node_id", "left_anti")
        dealt = dealt_in_order(win, F.desc("k"))  # the one thing that a level writes
        ranked, most = numbered(dealt, "rank")
        if not most:
            break
        level = dealt.select("node_id", "color", F.lit(hop).cast("int").alias("hop"))
        colored = level if colored is None else colored.unionByName(level)
        if hop < levels:
            cand = reached(ranked.select("node_id", "color", "rank"), adj, chunks).select("node_id", zero.alias("g"), (F.col("rank") + 1).alias("r"), "p", "color")
    adj.unpersist()
    return colored if colored is not None else start.select("node_id", "color", F.lit(1).cast("int").alias("hop")).limit(0)


def claim(most: int, last: int):
    """(g, r, p) of a claim, with g 0 or 1, r to ``most`` and p to ``last``, as one number in the same order, which aggregates in place; a struct where 62 bits don't hold it."""
    bits = last.bit_length()
    if most.bit_length() + bits > 62:
        return F.struct("g", "r", "p")
    return F.shiftleft("g", 62).bitwiseOR(F.shiftleft("r", bits)).bitwiseOR(F.col("p"))


def hub_chunks(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges`` with the chunk of each among its target's in-edges (0 but for hubs), and (dst, chunks) of the hubs, one for ``HUB`` edges at most."""
    chunks = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HUB)
    chunks = cut(chunks.select("dst", F.ceil(F.col("n") / HUB).alias("chunks")))
    return with_chunks(edges, chunks), chunks


def with_chunks(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """``edges`` with the chunk of each, from the (dst, chunks) of hubs."""
    chunk = F.pmod(F.xxhash64("edge_id"), F.coalesce("chunks", F.lit(1)))
    return edges.join(F.broadcast(chunks), "dst", "left").withColumn("chunk", chunk).drop("chunks")  # a row for HUB edges at most


def by_target(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dst, chunk, near) kept by (dst, chunk), so that levels of a walk shuffle their frontiers only and sort a row for each target, and (dst, chunks) of hubs."""
    rows, chunks = hub_chunks(edges.select("dst", "edge_id", "src"))
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return adjacent(rows.repartition(tasks, "dst", "chunk")).sortWithinPartitions("dst", "chunk").persist(), chunks


def in_chunks(frontier: DataFrame, chunks: DataFrame) -> DataFrame:
    """The frontier's nodes as ``dst``, a hub once for each of its chunks."""
    asked = frontier.withColumnRenamed("node_id", "dst").join(F.broadcast(chunks), "dst", "left")
    return asked.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1)) - 1))).drop("chunks")


def reached(frontier: DataFrame, adj: DataFrame, chunks: DataFrame) -> DataFrame:
    """The in-neighbours (node_id, p: their edge) of a frontier's nodes, with the frontier's columns; a hub is asked for chunk by chunk."""
    names = [c for c in frontier.columns if c != "node_id"]
    met = in_chunks(frontier, chunks).join(adj, ["dst", "chunk"]).select(F.explode("near").alias("e"), *names)
    return met.select(F.col("e.src").alias("node_id"), F.col("e.edge_id").alias("p"), *names)


def affinity(edges: DataFrame, colors: DataFrame, top: int = 10, decay: bool = True) -> DataFrame:
    """color, rank, neigh_color, affinity: hop-decayed share of a color's in-edges (or plain counts)."""
    into = edges.select("src", "dst").join(colors.select(F.col("node_id").alias("dst"), F.col("color").alias("c")), "dst")
    met = into.join(colors.select(F.col("node_id").alias("src"), F.col("color").alias("d"), "hop"), "src", "left")  # edges are read once
    weight = F.sum(F.exp(F.lit(-0.5) * F.col("hop"))) if decay else F.count(F.lit(1))
    pairs = met.groupBy("c", "d").agg(weight.alias("w"), F.count(F.lit(1)).alias("n"))
    pairs = pairs.withColumn("all", F.sum("n").over(Window.partitionBy("c"))).where("c <> d")
    rank = F.row_number().over(Window.partitionBy("c").orderBy(F.desc(F.round("w", 9) if decay else "w"), "d"))
    kept = pairs.withColumn("rank", rank).where(F.col("rank") <= top)
    value = F.round(F.col("w") / F.col("all"), 6).alias("affinity") if decay else F.col("w").alias("edges")
    return kept.select(F.col("c").alias("color"), "rank", F.col("d").alias("neigh_color"), value)


def neighbor_matrix(affinity: DataFrame, top: int = TOP) -> DataFrame:
    """color, neighbors, scores: a row a color, ``top`` slots; empty slots hold 0."""
    rows = affinity.groupBy("color").agg(F.array_sort(F.collect_list(F.struct("rank", "neigh_color", "affinity"))).alias("t"))
    pad = lambda field, zero: F.concat(F.col("t")[field], F.array_repeat(zero, top - F.size("t")))
    return rows.select("color", pad("neigh_color", F.lit(0).cast("long")).alias("neighbors"), pad("affinity", F.lit(0.0)).alias("scores"))


def train_order(train: DataFrame) -> DataFrame:
    """pos, node_id: one seeded permutation."""
    return dense_index(train.select("node_id", order_key(SEED, "perm", F.col("node_id")).alias("k")), "pos", "k", "node_id").select("pos", "node_id")


def striped(order: DataFrame, batch: int, gpus: int, machines: int, total: int, drop_last: bool = True) -> DataFrame:
    """step, pos, node_id, machine, gpu: contiguous slices of each global batch."""
    domain, world = batch * gpus, batch * gpus * machines
    at = F.col("pos") % world
    steps = total // world - (1 if drop_last else 0)
    out = order.select(F.floor(F.col("pos") / world).alias("step"), "pos", "node_id", F.floor(at / domain).alias("machine"), F.floor(at % domain / batch).alias("gpu"))
    return out.where(F.col("step") < steps)


def scores(batch_rows: DataFrame, colors: DataFrame, aff: DataFrame, resident: DataFrame, machines: int) -> DataFrame:
    """node_id, machine, score: resident lines of the neighbour colors, weighted by affinity."""
    per = aff.join(resident, aff["neigh_color"] == resident["color"]).groupBy(aff["color"].alias("color"), "machine").agg(F.sum(F.col("resident") * F.col("affinity")).alias("score"))
    every = batch_rows.select("step", "pos", "node_id").join(colors.select("node_id", "color"), "node_id", "left").withColumn("machine", F.explode(F.sequence(F.lit(0), F.lit(machines - 1))))
    return every.join(per, ["color", "machine"], "left").select("step", "pos", "node_id", "machine", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


def distribute(scored: DataFrame, domain: int, batch: int, machines: int) -> DataFrame:
    """Greedy by position within a global batch: the best machine with room, ties to the lowest.

    What a row would take changes only when a machine fills. So in each round every row that is left
    takes its best open machine, rows are counted by machine, and all up to the first that fills one
    keep theirs: as many rounds as machines at most. A batch is a step's rows, of bounded number.
    """
    s = F.transform(F.array_sort(F.collect_list(F.struct("machine", "score"))), lambda x: x["score"])
    rest = scored.groupBy("step", "pos", "node_id").agg(s.alias("s")).withColumn("fill", F.array_repeat(F.lit(0).cast("long"), machines))
    best = F.array_max(F.transform("s", lambda x, m: F.struct(F.when(F.get("fill", m) < domain, x).otherwise(F.lit(-1.0)).alias("x"), (-m).alias("m"))))
    slot = F.get("fill", F.col("machine").cast("int")) + F.row_number().over(Window.partitionBy("step", "machine").orderBy("pos")) - 1
    filled = F.min(F.when(F.col("slot") == domain - 1, F.col("pos"))).over(Window.partitionBy("step"))
    out = None
    for _ in range(machines):
        placed = rest.withColumn("machine", (-best["m"]).cast("long")).repartition("step").withColumn("slot", slot)
        placed = cut(placed.withColumn("done", F.coalesce(F.col("pos") <= filled, F.lit(True))))
        done = placed.where("done").select("step", "pos", "node_id", "machine", "slot", F.floor(F.col("slot") / batch).alias("gpu"))
        out = done if out is None else out.unionByName(done)
        left = placed.where("not done").select("step", "pos", "node_id", "s")
        if left.isEmpty():
            break
        taken = F.array(*[F.max(F.get("fill", F.lit(m))) + F.count_if(F.col("done") & (F.col("machine") == m)) for m in range(machines)])
        rest = left.join(placed.groupBy("step").agg(taken.alias("fill")), "step")
    return out


def adjacent(edges: DataFrame) -> DataFrame:
    """dst, chunk, near: the in-edges (edge_id, src) of a target's chunk in one array of ``HUB`` entries at most."""
    return edges.groupBy("dst", "chunk").agg(F.collect_list(F.struct("edge_id", "src")).alias("near"))


def sample_layer(frontier: DataFrame, edges: DataFrame, chunks: DataFrame, fanout: int, layer: int, relation: str = "") -> DataFrame:
    """Up to ``fanout`` in-edges of each frontier node, by hash order, with the frontier's other columns; ``edges`` and ``chunks`` from ``hub_chunks``, ``adjacent`` already or not.

    A frontier node meets an array of its in-edges and takes the first of them in place, so that what
    is shuffled after the join is the sample alone, and only where a hub's chunks send ``fanout``
    edges each. A hub's edges lie in several tasks, since the join is by target and chunk.
    """
    names = [c for c in frontier.columns if c != "node_id"]
    key = lambda e: order_key(SEED, f"{relation}layer{layer}", F.col("batch"), e["edge_id"])
    keyed = F.transform("near", lambda e: F.struct(key(e).alias("key"), e["edge_id"].alias("edge_id"), e["src"].alias("src")))
    first = lambda entries: F.slice(F.sort_array(entries), 1, fanout)
    near = in_chunks(frontier, chunks).join(edges if "near" in edges.columns else adjacent(edges), ["dst", "chunk"]).select(*names, "dst", first(keyed).alias("near"))
    if chunks.isEmpty():
        return near.select(*names, F.lit(layer).alias("layer"), "dst", F.explode("near").alias("e")).select(*names, "layer", "e.src", "dst", "e.edge_id")
    rank = F.row_number().over(Window.partitionBy(*names, "dst").orderBy("key", "edge_id"))
    several = near.select(*names, "dst", F.explode("near").alias("e")).select(*names, "dst", "e.*").withColumn("r", rank)
    return several.where(F.col("r") <= fanout).select(*names, F.lit(layer).alias("layer"), "src", "dst", "edge_id")


def sample_blocks(batch_nodes: DataFrame, edges: DataFrame, fanouts: list[int]) -> DataFrame:
    """Blocks of all layers; the seeds use the last fan-out, frontiers take in what was sampled."""
    frontier, out = batch_nodes.select("batch", "node_id").distinct(), None
    rows, chunks = hub_chunks(edges.select("edge_id", "src", "dst"))
    for layer in range(len(fanouts) - 1, -1, -1):
        block = cut(sample_layer(frontier, rows, chunks, fanouts[layer], layer))
        out = block if out is None else out.unionByName(block)
        frontier = cut(frontier.unionByName(block.select("batch", F.col("src").alias("node_id"))).distinct())
    return out


def cache_set(backend: str, owners: int, sets: int):
    """The set of a node in its owner's cache: ids are dealt to owners first, except where every requester has a cache of its own."""
    if backend not in BACKENDS:
        raise ValueError(f"cache backend must be one of {', '.join(BACKENDS)}, not {backend!r}")
    return F.pmod("node_id", F.lit(sets)) if backend == "isolated" else F.pmod(F.floor(F.col("node_id") / owners), F.lit(sets))


def cache_trace(accesses: DataFrame, sets: int, ways: int, owners: int = 4, backend: str = "nvshmem", state: DataFrame | None = None) -> DataFrame:
    """step, owner, cache_set, node_id, hit: round-robin sets, folded in the order of ``step``.

    ``state`` holds lines that are resident before (owner, cache_set, node_id, step of their
    installation, before all accesses). Round robin over a set's lines is first in, first out, so
    installing them again in order restores the set. A task reads the log of its sets in order and
    holds the lines of one set.
    """
    keyed = accesses.select("step", "owner", cache_set(backend, owners, sets).cast("long").alias("cache_set"), "node_id", F.lit(False).alias("before"))
    if state is not None:
        keyed = keyed.unionByName(state.select("step", "owner", "cache_set", "node_id", F.lit(True).alias("before")))
    ordered = keyed.repartition("owner", "cache_set").sortWithinPartitions("owner", "cache_set", "step")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lines = None, OrderedDict()
        for batch in batches:
            step, owner, group, node, before = (batch.column(c).to_pylist() for c in ("step", "owner", "cache_set", "node_id", "before"))
            hits = []
            for k in range(batch.num_rows):
                if (owner[k], group[k]) != at:
                    at, lines = (owner[k], group[k]), OrderedDict()
                hits.append(node[k] in lines)
                if not hits[-1]:
                    if len(lines) == ways:
                        lines.popitem(last=False)
                    lines[node[k]] = None
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("step", "owner", "cache_set", "node_id")), pa.array(hits, pa.bool_())], names=["step", "owner", "cache_set", "node_id", "hit"])
            yield out.filter(pa.array([not b for b in before], pa.bool_()))

    return ordered.mapInArrow(fold, "step long, owner long, cache_set long, node_id long, hit boolean")


def resident_lines(trace: DataFrame, ways: int, state: DataFrame | None = None) -> DataFrame:
    """owner, cache_set, node_id, step: what is resident after the trace, the last ``ways`` installed of each set."""
    put = trace.where("not hit").select("owner", "cache_set", "node_id", "step")
    put = put if state is None else put.unionByName(state.select(put.columns))
    last = F.row_number().over(Window.partitionBy("owner", "cache_set").orderBy(F.desc("step")))
    return put.withColumn("r", last).where(F.col("r") <= ways).drop("r")
