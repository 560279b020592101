"""Training of a linear head over aggregated neighbours: gradients are summed over tasks, the driver holds weights only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.operators import layers as L


def sage_inputs(edges: DataFrame, h: DataFrame) -> DataFrame:
    """node_id, x: a node's vector and the mean of its in-neighbours (0 without any), end to end."""
    width = h.select(F.size("h")).first()
    dim = width[0] if width else 0
    sums = L.summed(L.from_sources(edges, h), ["dst"], "h").withColumnRenamed("dst", "node_id")
    mean = F.coalesce(L.scaled("total", 1 / F.col("n")), F.array_repeat(F.lit(0.0), dim))
    return h.join(sums, "node_id", "left").select("node_id", F.concat("h", mean).alias("x"))


def gradient(rows: DataFrame, weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Sums over all rows (x, label): gradients of the cross-entropy, the loss, and the rows. Labels outside the classes raise."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(weights.size + bias.size + 2)
        for batch in batches:
            if not len(batch):
                continue
            x, y = L.stacked(batch["x"]), batch["label"].to_numpy(int)
            if y.min() < 0 or y.max() >= len(bias):
                raise ValueError("a label is not a class")
            z = x @ weights + bias
            z -= z.max(1, keepdims=True)
            log_p = z - np.log(np.exp(z).sum(1, keepdims=True))
            error = np.exp(log_p)
            error[np.arange(len(y)), y] -= 1
            total += np.concatenate([(x.T @ error).ravel(), error.sum(0), [-log_p[np.arange(len(y)), y].sum(), len(y)]])
        yield pd.DataFrame({"at": np.arange(len(total)), "x": total})

    sums = np.zeros(weights.size + bias.size + 2)
    for at, x in rows.select("x", "label").mapInPandas(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():  # as many numbers as there are weights
        sums[at] = x
    return sums[: weights.size].reshape(weights.shape), sums[weights.size : -2], float(sums[-2]), int(sums[-1])


def train(rows: DataFrame, inputs: int, classes: int, epochs: int = 3, rate: float = 0.01, decay: float = 0.001, betas: tuple = (0.9, 0.999), seed: int = 42) -> tuple[tuple[np.ndarray, np.ndarray], list[float]]:
    """((weights, bias), mean loss before each epoch's step): Adam with weight decay in the gradient; no rows leave the start as it is."""
    state = [np.random.default_rng(seed).normal(0, 1 / np.sqrt(inputs), (inputs, classes)), np.zeros(classes)]
    first, second, losses = [np.zeros_like(x) for x in state], [np.zeros_like(x) for x in state], []
    for step in range(1, epochs + 1):
        gw, gb, loss, n = gradient(rows, *state)
        if not n:
            break
        losses.append(loss / n)
        for k, g in enumerate((gw / n, gb / n)):
            g = g + decay * state[k]
            first[k] = betas[0] * first[k] + (1 - betas[0]) * g
            second[k] = betas[1] * second[k] + (1 - betas[1]) * g * g
            state[k] = state[k] - rate * (first[k] / (1 - betas[0] ** step)) / (np.sqrt(second[k] / (1 - betas[1] ** step)) + 1e-8)
    return (state[0], state[1]), losses
