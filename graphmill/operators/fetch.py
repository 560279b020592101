"""Feature fetch: every request gets its row back at its own position, whatever way the row takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def positioned(inputs: DataFrame) -> DataFrame:
    """batch, pos, node_id: a batch's input nodes in id order."""
    return inputs.select("batch", (F.row_number().over(Window.partitionBy("batch").orderBy("node_id")) - 1).cast("long").alias("pos"), "node_id")


def fetch_isolated(requests: DataFrame, features: DataFrame) -> DataFrame:
    """Every requester reads its own rows."""
    return requests.join(features, "node_id").select("batch", "pos", "node_id", "embedding")


def routed(requests: DataFrame, owners: int) -> DataFrame:
    """batch, pos, node_id, owner, slot: the owner of each id, and the request's place among the batch's requests to it."""
    owner = requests.withColumn("owner", F.pmod("node_id", F.lit(owners)))
    return owner.withColumn("slot", (F.row_number().over(Window.partitionBy("batch", "owner").orderBy("pos")) - 1).cast("long"))


def fetch_routed(requests: DataFrame, features: DataFrame, owners: int) -> DataFrame:
    """Requests meet the rows at the owner, and rows go straight back to their positions."""
    asked = requests.withColumn("owner", F.pmod("node_id", F.lit(owners)))
    held = features.withColumn("owner", F.pmod("node_id", F.lit(owners)))
    return asked.join(held, ["owner", "node_id"]).select("batch", "pos", "node_id", "owner", "embedding")


def fetch_remapped(requests: DataFrame, features: DataFrame, owners: int) -> DataFrame:
    """Requests are split by owner, what an owner's bucket asks for comes back in the bucket's order, and buckets are put back into positions.

    Positions are restored over ids and slots, before the rows join in: no vector is shuffled for each request.
    """
    buckets = routed(requests, owners)
    sent = buckets.select("batch", "owner", "slot", "node_id")
    placed = buckets.select("batch", "owner", "slot", "pos").join(sent, ["batch", "owner", "slot"])
    return placed.join(features, "node_id").select("batch", "pos", "node_id", "owner", "embedding")
