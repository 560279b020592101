"""Embedding near-duplicates by a forest of random-projection trees with spill.

Each tree splits the vectors of a label along random directions; vectors near a cut go to both
sides. Pairs are compared within leaves; a pair counts in the first leaf it shares, over all
trees, so no pair is ever listed: a leaf sends link counts and a spanning forest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.common import broadcast_if_small, cut
from graphmill.llm.components import connected_components
from graphmill.llm.jaccard import forest
from graphmill.llm.vectors import matrix, norms, vector_rows

TREES, LEAF, BLOCK = 6, 512, 1024
#: Half-width of the band around a cut whose vectors go to both sides, in standard deviations of
#: the distance that a random direction sees between two vectors at the threshold. At 0.5 a cut
#: parts some 2.5 % of such pairs, so six trees of twenty levels miss about 1 in 200 of them, and
#: closer pairs far more rarely; a wider band makes the rows of a tree grow like a power of the input.
WIDTH = 0.5
#: A node's subtree is drawn from about so many of its vectors (all, if fewer); routing groups hold about so many.
SAMPLE, ROUTED = 2048, 4096
#: A cut that leaves a side more than this share of the node doesn't split it: the node is dense.
DENSE = 0.9
#: Pairs within this of the threshold are computed anew, row by row.
NEAR = 1e-9


def direction(seed: int, node: int, dim: int) -> np.ndarray:
    """The random unit vector of a node, the same wherever it is needed."""
    v = np.random.default_rng([seed & 0x7FFFFFFF, node]).standard_normal(dim)
    return v / np.linalg.norm(v)


def draw_tree(unit: np.ndarray, total: int, seed: int, leaf: int, spill: float) -> dict[int, float]:
    """Cuts of a subtree by heap number (root 1), from a sample that stands for ``total`` vectors."""
    cuts: dict[int, float] = {}
    scale, todo = total / len(unit), [(1, np.arange(len(unit)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) * scale <= leaf or len(rows) < 16 or node >= 1 << 40:
            continue
        at = unit[rows] @ direction(seed, node, unit.shape[1])
        middle = float(np.median(at))
        sides = (rows[at <= middle + spill], rows[at >= middle - spill])
        if max(len(s) for s in sides) > DENSE * len(rows):
            continue
        cuts[node] = middle
        todo += [(2 * node, sides[0]), (2 * node + 1, sides[1])]
    return cuts


def route(unit: np.ndarray, cuts: dict[int, float], seed: int, spill: float) -> list[tuple[int, np.ndarray]]:
    """(leaf, rows) of all vectors."""
    out, todo = [], [(1, np.arange(len(unit)))]
    while todo:
        node, rows = todo.pop()
        if node not in cuts or not len(rows):
            out.append((node, rows))
            continue
        at = unit[rows] @ direction(seed, node, unit.shape[1])
        todo += [(2 * node, rows[at <= cuts[node] + spill]), (2 * node + 1, rows[at >= cuts[node] - spill])]
    return out


def band(threshold: float, dim: int, width: float = WIDTH) -> float:
    """Half-width of the band for unit vectors of ``dim`` components."""
    return width * float(np.sqrt(max(2 - 2 * threshold, 0) / dim))


def grow(points: DataFrame, leaf: int, threshold: float, width: float) -> DataFrame:
    """One round of splitting: (node, id, vector, copies) -> the same under the leaves of each node's subtree, with ``more`` where a leaf is still to be split."""
    sizes = cut(points.groupBy("node").agg(F.count(F.lit(1)).alias("total")))
    # about SAMPLE vectors a node, by a hash of the id: nothing is ranked, however large the node
    share = F.pmod(F.xxhash64("id", F.lit(21)), F.lit(1 << 30)) / F.lit(1 << 30)
    sampled = points.join(broadcast_if_small(sizes), "node").where(share * F.col("total") < SAMPLE)

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        node, m = int(part["node"].iloc[0]), matrix(part["vector"])
        cuts = draw_tree(m / norms(m)[:, None], int(part["total"].iloc[0]), node, leaf, band(threshold, m.shape[1], width))
        return pd.DataFrame({"node": [node], "total": [int(part["total"].iloc[0])], "at": [list(cuts)], "cut": [list(cuts.values())]})

    trees = cut(sampled.groupBy("node").applyInPandas(draw, "node long, total long, at array<long>, cut array<double>"))
    salts = F.ceil(F.col("total") / ROUTED).cast("int")
    dealt = points.join(broadcast_if_small(trees.select("node", salts.alias("salts"))), "node", "left").fillna(1, ["salts"]).withColumn("salt", F.pmod(F.xxhash64("id", F.lit(3)), F.col("salts")).cast("int")).drop("salts")
    copied = trees.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))

    def send(part: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return part.reindex(columns=["node", "split", "id", "vector", "copies"])
        node, m = int(part["node"].iloc[0]), matrix(part["vector"])
        cuts = dict(zip(map(int, tree["at"].iloc[0]), tree["cut"].iloc[0], strict=True))
        out = []
        for k, rows in route(m / norms(m)[:, None], cuts, node, band(threshold, m.shape[1], width)):
            name = (node * 0x9E3779B97F4A7C15 + k * 0xBF58476D1CE4E5B9) % (1 << 63)
            out.append(part.iloc[rows][["id", "vector", "copies"]].assign(node=name, split=len(cuts) > 0))
        return pd.concat(out)[["node", "split", "id", "vector", "copies"]]

    return cut(dealt.groupBy("node", "salt").cogroup(copied.groupBy("node", "salt")).applyInPandas(send, "node long, split boolean, id long, vector array<double>, copies long"))


def compare_leaf(part: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of a pair of blocks of one leaf, each pair where it first shares a leaf."""
    leaf, i, j = int(part["node"].iloc[0]), part["i"].iloc[0], part["j"].iloc[0]
    a = part[part["side"] == i]
    b = a if i == j else part[part["side"] == j]
    if not len(a) or not len(b):
        return pd.DataFrame(columns=["a", "b", "n"])
    ma, mb = matrix(a["vector"]), matrix(b["vector"])
    la, lb = norms(ma), norms(mb)
    cosine = (ma / la[:, None]) @ (mb / lb[:, None]).T
    linked = cosine >= threshold
    for x, y in np.argwhere(np.abs(cosine - threshold) < NEAR):
        linked[x, y] = (ma[x] * mb[y]).sum() / (la[x] * lb[y]) >= threshold
    if i == j:
        np.fill_diagonal(linked, False)
    ids_a, ids_b = a["id"].to_numpy(), b["id"].to_numpy()
    edges = forest(linked, ids_a, ids_b, i == j)
    sides = [[np.asarray(x)[np.asarray(x) < leaf] for x in s["leaves"]] for s in (a, b)]
    known = np.unique(np.concatenate([*sides[0], *sides[1]])) if linked.any() else np.empty(0, np.int64)
    if len(known):
        marks = []
        for s in sides:
            m = np.zeros((len(s), len(known)), np.float32)
            for r, x in enumerate(s):
                m[r, np.searchsorted(known, x)] = 1
            marks.append(m)
        first = linked & ((marks[0] @ marks[1].T) == 0)
    else:
        first = linked
    counts = [(x, None, n) for x, n in zip(ids_a, first @ b["copies"].to_numpy(), strict=True) if n]
    if i != j:
        counts += [(x, None, n) for x, n in zip(ids_b, first.T @ a["copies"].to_numpy(), strict=True) if n]
    return pd.DataFrame([(x, y, 0) for x, y in edges] + counts, columns=["a", "b", "n"]).astype("Int64")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, trees: int = TREES, leaf: int = LEAF, width: float = WIDTH, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``.

    Rows link when their labels are equal and not null and their cosine is at least ``threshold``;
    every link is verified, and found if some tree puts both in one leaf. Vectors that are null,
    zero, or hold null or non-finite components, and rows without an id, link with nothing. Equal
    vectors of a label are one point with so many copies: they link with each other without being
    compared. A leaf that random cuts don't thin out is compared whole, in pairs of fixed blocks.
    """
    dim = F.size("vector")
    valid = vector_rows(vectors, id_col, vector_col, F.xxhash64(F.col(label_col)).alias("label_key"), F.col(label_col).alias("label")).where("label is not null").withColumn("dim", dim)
    key = ["label_key", "label", "dim", "vector"]
    points = cut(valid.groupBy(*key).agg(F.min("id").alias("point"), F.count(F.lit(1)).alias("copies")))
    members = cut(valid.join(points, key).select("id", "point", "copies"))
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    todo = points.select(F.col("point").alias("id"), "vector", "copies", "label_key", "dim", tree.alias("tree")).select((F.xxhash64("label_key", "dim", "tree").bitwiseAND(F.lit((1 << 62) - 1))).alias("node"), "id", "vector", "copies")
    leaves = None
    while True:
        grown = grow(todo, leaf, threshold, width)
        large = cut(grown.groupBy("node").agg(F.count(F.lit(1)).alias("held"), F.max("split").alias("split")).where((F.col("held") > 2 * leaf) & F.col("split")).select("node"))
        done = grown.join(broadcast_if_small(large), "node", "left_anti").select("node", "id", "vector", "copies")
        leaves = done if leaves is None else leaves.unionByName(done)
        if large.limit(1).count() == 0:
            break
        todo = grown.join(broadcast_if_small(large), "node").select("node", "id", "vector", "copies")
    per = leaves.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    home = leaves.groupBy("id").agg(F.collect_set("node").alias("leaves"))
    placed = leaves.join(home, "id").join(per, "node").withColumn("side", F.pmod(F.xxhash64("id", F.lit(11)), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("side", k).alias("i"), F.greatest("side", k).alias("j")))
    dealt = placed.withColumn("u", F.explode(pairs)).select("node", "id", "vector", "copies", "leaves", "side", "u.i", "u.j")
    found = cut(dealt.groupBy("node", "i", "j").applyInPandas(lambda part: compare_leaf(part, threshold), "a long, b long, n long"))
    copies = members.where("id <> point").select(F.col("point").alias("a"), F.col("id").alias("b"))
    labels = connected_components(found.where("b is not null").select("a", "b").unionByName(copies)).select(F.col("node").alias("vec_id"), "component")
    counts = found.where("b is null").groupBy(F.col("a").alias("point")).agg(F.sum("n").alias("others"))
    links = members.join(counts, "point", "left").groupBy(F.col("id").alias("vec_id")).agg(F.max(F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"))
    everyone = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    out = everyone.join(links, "vec_id", "left").join(labels, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
