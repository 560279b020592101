"""The set cache as a stream: its lines live in the state store between micro-batches."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from graphmill.functions.ordering import checkpoint_folder

TRACE = "step long, owner long, cache_set long, node_id long, hit boolean"


def stream_trace(accesses: DataFrame, sets: int, ways: int) -> DataFrame:
    """step, owner, cache_set, node_id, hit of a streaming (step, node_id, owner).

    State is keyed by (owner, set): its lines and the round-robin cursor. Accesses of a
    micro-batch are taken by step; across micro-batches the stream's order holds. A task holds one
    set's accesses of one micro-batch, which the source's rate bounds.
    """
    keyed = accesses.select("step", "owner", (F.floor(F.col("node_id") / 4) % sets).alias("cache_set"), "node_id")

    def fold(_key, parts, state):
        lines, cursor = state.get if state.exists else ([None] * ways, 0)
        lines, hits = list(lines), []
        part = pd.concat(list(parts)).sort_values("step")
        for node in part["node_id"].tolist():
            hits.append(node in lines)
            if not hits[-1]:
                lines[cursor % ways] = node
                cursor += 1
        state.update((lines, cursor))
        yield part.assign(hit=hits)[["step", "owner", "cache_set", "node_id", "hit"]]

    return keyed.groupBy("owner", "cache_set").applyInPandasWithState(fold, TRACE, "lines array<long>, cursor long", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame) -> DataFrame:
    """Everything the stream has now, written exactly once to Parquet in the shared folder, read back."""
    spark = stream.sparkSession
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    running = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
