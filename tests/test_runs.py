"""Runs over prepared graphs: settings take effect, hubs are known from the index, blocks of files are pruned."""

import numpy as np
import pytest

from graphmill.config import Settings
from graphmill.operators import block_models as B
from graphmill.operators import graph as G
from graphmill.operators import runs as R

DIM, CLASSES, N = 4, 2, 60


def settings(**more):
    return Settings(**({"fan_out": "3,3", "num_layers": 2, "batch_size": 3, "gpus": 2, "machines": 2, "hidden_channels": 8, "num_heads": 2, "epochs": 2, "learning_rate": 0.05} | more))


@pytest.fixture(scope="module")
def prepared(spark, tmp_path_factory):
    r = np.random.default_rng(3)
    edges = [(k, int(a), int(b)) for k, (a, b) in enumerate(r.integers(0, N, (200, 2)))]
    edges += [(200 + k, k % N, 7) for k in range(90)]  # node 7 is a hub
    nodes = [(i, "train" if i < 36 else "val" if i < 48 else "test", None if i % 12 == 5 else float(i % 2)) for i in range(N)]
    path = str(tmp_path_factory.mktemp("prepared"))
    e = spark.createDataFrame(edges, "edge_id long, src long, dst long")
    n = spark.createDataFrame(nodes, "node_id long, split string, label double")
    features = spark.createDataFrame([(i, [float(i % 2)] + r.standard_normal(DIM - 1).tolist()) for i in range(N)], "node_id long, h array<double>")
    return R.prepare(n, e, path, rate=0.1), G.normalize_loops(e, n), features


def test_batches_follow_the_settings(prepared):
    graph = prepared[0]
    for name in ("baseline", "node_color"):
        s = settings(distribution=name)
        rows = R.batches(graph, s).collect()
        order = {r.node_id: r.pos for r in graph.order("train").collect()}
        assert len(order) == 33 and rows and {r.node_id: r.pos for r in rows} == {v: p for v, p in order.items() if p < 12}
        counts = {}
        for r in rows:
            assert r.batch == (r.step * 2 + r.machine) * 2 + r.gpu and r.step == r.pos // 12
            counts[r.batch] = counts.get(r.batch, 0) + 1
        assert set(counts.values()) == {3}
        tested = R.batches(graph, s, "test", whole=True).collect()
        assert sorted(r.node_id for r in tested) == sorted(r.node_id for r in graph.order("test").collect()) and len(tested) == 11
    assert {r.machine for r in R.batches(graph, settings(machines=1)).collect()} == {0}


def test_top_limits_the_near_colors(prepared):
    graph = prepared[0]
    near = {}
    for r in graph.affinity(2).collect():
        near.setdefault(r.color, []).append(r.neigh_color)
    assert near and all(len(v) <= 2 for v in near.values())
    assert graph.affinity(10).count() >= sum(map(len, near.values()))


def test_blocks_equal_those_of_the_whole_graph(prepared, monkeypatch):
    """Also where the hub's edges lie in chunks."""
    graph, normal, _ = prepared
    s = settings()
    seeds = R.batches(graph, s)
    for hub in (G.HUB, 20):
        monkeypatch.setattr(G, "HUB", hub)
        got, wanted = R.blocks(graph, s), B.sample(seeds, normal, s.fanouts)
        for a, b in zip(got.edges, wanted.edges, strict=True):
            assert sorted(a.collect()) == sorted(b.collect()) and a.count()
        assert got.counters() == wanted.counters()
    _, hubs = graph.edges(graph.order("train"))
    assert {r.dst: r.chunks for r in hubs.collect()}[7] == -(-normal.where("dst = 7").count() // 20)


def test_other_draws_sample_other_edges(prepared):
    graph = prepared[0]
    seeds = R.batches(graph, settings())
    one, two, again = (sorted(tuple(e) for e in B.sample(seeds, graph.edges, [2, 2], draw).edges[1].collect()) for draw in ("", "epoch2", "epoch2"))
    assert one != two and two == again and len(one) == len(two)


def test_run_learns_and_reports(prepared):
    """Losses fall, and the accuracy is that of the reported model over blocks of the whole graph."""
    graph, normal, features = prepared
    for kind, epochs in (("sage", 6), ("gat", 1)):
        s = settings(model=kind, epochs=epochs, dropout=0.0)
        said = R.run(graph, features, DIM, CLASSES, s)
        assert len(said.sampled) == epochs and {e for e, _, _ in said.losses} == set(range(1, epochs + 1)) and said.tested == 11
        assert said.model.kind == kind and said.losses[-1][2] <= said.losses[0][2]
        found = B.predict(said.model, R.batches(graph, s, "test", whole=True), normal, features, s.fanouts)
        right = [r.predicted == r.label for r in found.join(graph.labels(), "node_id").collect()]
        assert said.accuracy == pytest.approx(100 * sum(right) / 11)


def test_without_whole_batches_or_training_nodes(spark, prepared, tmp_path):
    graph, _, features = prepared
    said = R.run(graph, features, DIM, CLASSES, settings(batch_size=100))
    assert said.losses == [] and said.tested == 11
    none = spark.createDataFrame([(0, None, 1)], "node_id long, split string, label int")
    with pytest.raises(ValueError):
        R.prepare(none, spark.createDataFrame([], "edge_id long, src long, dst long"), str(tmp_path))
