"""Connected components of a link table, distributed: links and labels never reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import broadcast_if_small, cut


def relabel(df: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """``column`` replaced by its parent where it has one."""
    step = broadcast_if_small(parents.select(F.col("node").alias("_n"), F.col("parent").alias("_p")))
    return df.join(step, df[column] == F.col("_n"), "left").withColumn(column, F.coalesce("_p", column)).drop("_n", "_p")


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component): the smallest node reachable, for every node with a link.

    Each round hooks a node to its smallest neighbour, jumps pointers to the roots, and contracts
    the links; rounds grow with the logarithm of the longest chain of local minima. Self links and
    nulls are ignored, repeated links count once; without links the result is empty.
    """
    links = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while True:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("parent")))
        while True:
            jumped = cut(relabel(parents.withColumn("was", F.col("parent")), "parent", parents.where("parent <> node")))
            parents = jumped.drop("was")
            if jumped.where("parent <> was").limit(1).count() == 0:
                break
        labels = parents if labels is None else cut(relabel(labels, "parent", parents))
        links = cut(relabel(relabel(links, "a", parents), "b", parents).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if links.limit(1).count() == 0:
            return labels.select("node", F.col("parent").alias("component"))
