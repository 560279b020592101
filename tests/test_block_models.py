"""Stacks over sampled blocks against NumPy, gradients against finite differences."""

import numpy as np
import pyarrow as pa
import pytest

from graphmill.functions import arrays
from graphmill.operators import block_models as B
from graphmill.operators import layers as L

DIM, HIDDEN, CLASSES = 5, 4, 3


def graph(spark, seed=0, n=18):
    r = np.random.default_rng(seed)
    edges = [(k, int(a), int(b)) for k, (a, b) in enumerate(r.integers(0, n, (60, 2)))] + [(100 + k, k % n, 2) for k in range(30)]  # node 2 is a hub
    edges = [(k, a, b) for k, a, b in edges if b != 5]  # node 5 has no in-edges
    x = r.standard_normal((n, DIM))
    label = r.integers(0, CLASSES, n)
    seeds = [(0, 0, 2), (0, 0, 5), (0, 0, 7), (0, 1, 2), (0, 1, 9), (1, 2, 1), (1, 2, 3)]
    return (
        spark.createDataFrame(edges, "edge_id long, src long, dst long"),
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, h array<double>"),
        spark.createDataFrame([(i, int(v)) for i, v in enumerate(label) if i != 9], "node_id long, label int"),
        spark.createDataFrame(seeds, "step long, batch long, node_id long"),
        x,
        label,
    )


def collected(blocks):
    return [[tuple(e) for e in b.collect()] for b in blocks.edges], [[tuple(v) for v in n.collect()] for n in blocks.nodes]


def plain_forward(model, edges, nodes, x):
    """Scores of the seeds by (batch, node), one edge after the other; no dropout."""
    h = {v: x[v[1]] for v in nodes[0]}
    for k, p in enumerate(model.params):
        into = {v: [(b, s) for b, s, d in edges[k] if (b, d) == v] for v in nodes[k + 1]}
        out_degree = {}
        for b, s, _ in edges[k]:
            out_degree[(b, s)] = out_degree.get((b, s), 0) + 1
        new = {}
        for v, sources in into.items():
            if model.kind == "sage":
                mean = sum((h[u] for u in sources), np.zeros(len(h[v]))) / max(1, len(sources))
                z = h[v] @ p["own"] + mean @ p["neigh"] + p["bias"]
            elif model.kind == "gcn":
                z = sum((h[u] / np.sqrt(out_degree[u] * len(sources)) for u in sources), np.zeros(len(h[v]))) @ p["weight"] + p["bias"]
            else:
                heads, width = p["left"].shape
                y = (h[v] @ p["target"]).reshape(heads, width)
                zs = [(h[u] @ p["source"]).reshape(heads, width) for u in sources]
                z = np.zeros((heads, width))
                for j in range(heads if zs else 0):
                    e = np.array([s[j] @ p["left"][j] + y[j] @ p["right"][j] for s in zs])
                    e = np.exp(np.where(e > 0, e, L.SLOPE * e))
                    z[j] = sum(a * s[j] for a, s in zip(e / e.sum(), zs, strict=True))
                z = z.ravel() + p["bias"]
                z = z.reshape(heads, width).mean(0) if model.last(k) else z
            new[v] = z if model.last(k) or model.kind == "gat" else np.maximum(z, 0)
        h = new
    return h


def plain_loss(model, edges, nodes, x, label):
    losses = [np.log(np.exp(z).sum()) - z[label[v]] for (_, v), z in plain_forward(model, edges, nodes, x).items() if v != 9]
    return sum(losses) / len(losses)


@pytest.mark.parametrize("kind", ["sage", "gcn", "gat"])
def test_three_layers_and_every_gradient(spark, kind):
    e, f, labels, seeds, x, label = graph(spark)
    blocks = B.sample(seeds, e, [2, 3, 4])
    edges, nodes = collected(blocks)
    assert all({(b, d) for b, _, d in edges[k]} <= set(nodes[k + 1]) and {(b, s) for b, s, _ in edges[k]} | set(nodes[k + 1]) == set(nodes[k]) for k in range(3))
    assert max(sum((b, d) == v for b, _, d in edges[2]) for v in nodes[3]) == 4
    model = B.start(kind, DIM, HIDDEN, CLASSES, 3, heads=2, dropout=0)
    r = np.random.default_rng(1)
    for p in model.params:
        p["bias"] += r.standard_normal(p["bias"].shape) / 3
    want = plain_forward(model, edges, nodes, x)
    got = {(v.batch, v.node_id): np.array(v.h) for v in B.forward(model, blocks, f)[0].collect()}
    assert set(got) == set(want) and all(np.allclose(got[v], want[v], atol=1e-12) for v in want)
    grads, loss, n = B.gradients(model, blocks, f, labels)
    assert n == 6 and loss == pytest.approx(plain_loss(model, edges, nodes, x, label))
    for p, g in zip(model.params, grads, strict=True):
        for name, a in p.items():
            assert g[name].shape == a.shape
            for at in np.ndindex(a.shape):
                old, around = a[at], []
                for d in (1e-6, -1e-6):
                    a[at] = old + d
                    around.append(plain_loss(model, edges, nodes, x, label))
                a[at] = old
                assert g[name][at] == pytest.approx((around[0] - around[1]) / 2e-6, abs=2e-6), (kind, name, at)


def test_dropout_forwards_and_backwards(spark):
    """The loss along a direction of all parameters, with the same mask on both sides."""
    e, f, labels, seeds, _, _ = graph(spark, 3)
    blocks = B.sample(seeds, e, [3, 3])
    model = B.start("sage", DIM, 16, CLASSES, 2, dropout=0.5)
    grads, loss, _ = B.gradients(model, blocks, f, labels, draw=4)
    assert loss != B.gradients(model, blocks, f, labels, draw=5)[1] and loss == pytest.approx(B.gradients(model, blocks, f, labels, draw=4)[1], rel=1e-12)
    r, around, slope = np.random.default_rng(2), [], 0.0
    ways = [{name: r.standard_normal(a.shape) for name, a in p.items()} for p in model.params]
    for d in (1e-6, -1e-6):
        moved = B.Model("sage", [{name: a + d * w[name] for name, a in p.items()} for p, w in zip(model.params, ways, strict=True)], 1, 0.5)
        around.append(B.gradients(moved, blocks, f, labels, draw=4)[1])
    slope = sum((g[name] * w[name]).sum() for g, w in zip(grads, ways, strict=True) for name in g)
    assert slope == pytest.approx((around[0] - around[1]) / 2e-6, rel=1e-4)
    mask = B.kept_share(np.arange(400), np.arange(400) * 7, 50, 0, 0.2, 1)
    assert set(np.unique(mask)) == {0, 1.25} and abs((mask == 0).mean() - 0.2) < 0.01


def test_training_takes_one_step_a_global_batch(spark):
    e, f, labels, seeds, _, _ = graph(spark, 5)
    model = B.start("sage", DIM, 8, CLASSES, 2, dropout=0)
    trained, said = B.train(model, seeds, e, f, labels, [3, 3], epochs=6, adam=B.Adam(rate=0.05))
    assert [(a, b) for a, b, _ in said] == [(k, s) for k in range(1, 7) for s in (0, 1)]
    assert said[-1][2] + said[-2][2] < 0.6 * (said[0][2] + said[1][2])
    first = B.gradients(model, B.sample(seeds.where("step = 0"), e, [3, 3]), f, labels)
    assert said[0][2] == pytest.approx(first[1])
    one, _ = B.train(model, seeds.where("step = 0"), e, f, labels, [3, 3], adam=B.Adam(rate=0.05))
    for p, g, q in zip(model.params, first[0], one.params, strict=True):
        for name in p:  # the first step of Adam moves by the rate against the gradient's sign
            d = g[name] + 0.001 * p[name]
            assert np.allclose(q[name], p[name] - 0.05 * d / (np.abs(d) + 1e-8), atol=1e-9)
    predicted = B.predict(trained, seeds, e, f, [3, 3]).collect()
    assert len(predicted) == 7 and all(v.predicted == int(np.argmax(v.h)) for v in predicted)
    with pytest.raises(ValueError):
        B.start("mlp", 2, 2, 2, 2)


def test_vector_sums_of_hubs_and_wide_vectors(spark):
    r = np.random.default_rng(4)
    x, w, key = r.standard_normal((3000, 1024)), r.standard_normal((3000, 2)), np.where(r.random(3000) < 0.9, 1, r.integers(0, 50, 3000))
    rows = spark.createDataFrame([(int(k), "s" if k % 2 else None, v.tolist(), u.tolist()) for k, v, u in zip(key, x, w, strict=True)] + [(1, "s", None, [1.0, 1.0])], "a long, b string, v array<double>, w array<double>").repartition(4)
    for weights in (None, "w"):
        y = x if weights is None else np.hstack([x[:, :512] * w[:, :1], x[:, 512:] * w[:, 1:]])
        got = {t.a: t for t in arrays.vector_sums(rows, ["a", "b"], "v", weights).collect()}
        assert set(got) == set(key.tolist())
        for k, t in got.items():
            assert t.n == (key == k).sum() and np.allclose(t.total, y[key == k].sum(0))
    plan = arrays.vector_sums(rows, ["a"], "v")._jdf.queryExecution().toString()
    assert "sum(" not in plan  # no expression a component
    with pytest.raises(ValueError):
        arrays.matrix(pa.array([[1.0], [1.0, 2.0]]))


def test_linear_keeps_nulls(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [0.0, 1.0])], "i int, v array<double>").repartition(1)
    got = {r.i: r.y for r in rows.select("i", L.linear("v", np.array([[1.0, 2.0, 0.0], [0.0, 1.0, 1.0]]), np.array([0.0, 0.0, 5.0])).alias("y")).collect()}
    assert got == {1: [1.0, 4.0, 7.0], 2: None, 3: [0.0, 1.0, 6.0]}


@pytest.mark.parametrize("kind", ["sage", "gcn", "gat"])
def test_whole_batches_agree_with_joins_where_nodes_have_no_features(spark, kind, monkeypatch):
    """A batch that fits a task is shuffled once, by batch; what it says is what joins say, dropout and unknown nodes too, and labels outside the classes raise."""
    r = np.random.default_rng(9)
    edges = spark.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(r.integers(0, 18, (90, 2)))], "edge_id long, src long, dst long")
    seeds = spark.createDataFrame([(b, n) for b in range(3) for n in range(4 * b, 4 * b + 5)], "batch long, node_id long")
    features = spark.createDataFrame([(n, r.standard_normal(3).tolist()) for n in range(18) if n != 7 or kind == "gat"], "node_id long, h array<double>")
    labels = spark.createDataFrame([(n, n % 2) for n in range(18) if n % 5], "node_id long, label long")
    blocks = B.sample(seeds, edges, [3, 4])
    model = B.start(kind, 3, 4, 2, 2, heads=2, dropout=0.3)
    rows = lambda f: {(v.batch, v.node_id): v.h for v in f.collect()}
    whole, parts = rows(B.forward(model, blocks, features, 1)[0]), rows(B.spread(model, blocks, features, 1)[0])
    assert whole.keys() == parts.keys() and all(np.allclose(whole[k], parts[k]) for k in whole)
    assert B.forward(model, blocks, features)[0]._jdf.queryExecution().executedPlan().toString().count("mapInArrow") <= 1
    a, b = B.gradients(model, blocks, features, labels, 1), B.spread_gradients(model, blocks, features, labels, 1)
    assert a[1:] == pytest.approx(b[1:]) and all(np.allclose(x[n], y[n]) for x, y in zip(a[0], b[0], strict=True) for n in x)
    with pytest.raises(Exception, match="not a class"):
        B.gradients(model, blocks, features, labels.selectExpr("node_id", "-1 as label"), 1)
    monkeypatch.setattr(B, "LOCAL_NUMBERS", 1)
    large = rows(B.forward(model, blocks, features, 1)[0])
    assert large.keys() == parts.keys() and all(np.allclose(large[k], parts[k]) for k in parts)


def test_windows_change_nothing_and_leave_nothing(spark, monkeypatch):
    """Features come to a window's batches alone, whose folders go; steps are folded in a few tasks, not in a job each."""
    import os

    from graphmill.functions.ordering import checkpoint_folder

    e, f, labels, _, _, _ = graph(spark, 7)
    seeds = spark.createDataFrame([(s, s, (7 * s + n) % 18) for s in range(60) for n in range(2)], "step long, batch long, node_id long")
    model = B.start("sage", DIM, 4, CLASSES, 2, dropout=0.3)
    held = lambda: {n for n in os.listdir(checkpoint_folder(spark).removeprefix("file:")) if n.startswith(("steps", "training", "blocks"))}
    before = held()
    spark.sparkContext.setJobGroup("training", "")
    trained, said = B.train(model, seeds, e, f, labels, [2, 3])
    spark.sparkContext.setJobGroup("other", "")
    assert held() == before and len(said) == 60 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("training")) < 60
    monkeypatch.setattr(B, "WINDOW_NUMBERS", 3000)
    monkeypatch.setattr(B, "SLICE_IDS", 500)
    sampled: list[dict] = []
    again, told = B.train(model, seeds, e, f, labels, [2, 3], sampled=sampled)
    assert [x[:2] for x in told] == [x[:2] for x in said] and np.allclose([x[2] for x in told], [x[2] for x in said], atol=1e-12)
    assert all(np.allclose(p[n], q[n], atol=1e-12) for p, q in zip(trained.params, again.params, strict=True) for n in p)
    blocks, rows = B.sample(seeds, e, [2, 3]), lambda d: {(v.batch, v.node_id): v.h for v in d.collect()}
    assert blocks.sizes.slices == 3 and blocks.windows(f, DIM) == 3 and sampled[0] == blocks.counters()
    cuts, whole = rows(B.forward(model, blocks, f)[0]), rows(B.spread(model, blocks, f)[0])
    assert cuts.keys() == whole.keys() and all(np.allclose(cuts[k], whole[k], atol=1e-12) for k in whole)
