"""Typed graphs: loading against a schema, sampling by relation, stacks against NumPy."""

import hashlib

import numpy as np
import pytest

from graphmill.operators import block_models as B
from graphmill.operators import hetero as H

COUNTS = {"a": 7, "b": 5, "c": 4}
RELATIONS = {"ab": ("a", "b"), "ba": ("b", "a"), "cb": ("c", "b"), "aa": ("a", "a")}
DIM, WIDE, CLASSES = 3, 4, 2


def edges_of(seed=0):
    r = np.random.default_rng(seed)
    out = {rel: sorted({(int(x), int(y)) for x, y in zip(r.integers(0, COUNTS[s], 12), r.integers(0, COUNTS[t] - 1, 12), strict=True)}) for rel, (s, t) in RELATIONS.items()}
    return out  # the last node of each type is no target


def loaded(spark, edges, counts=COUNTS, features=None):
    frames = {rel: spark.createDataFrame([(k, *e) for k, e in enumerate(e_)], "edge_id long, src long, dst long") for rel, e_ in edges.items()}
    return H.load(spark, H.Schema(counts, RELATIONS), frames, {k: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, h array<double>") for k, x in features.items()})


def features_of(seed=1):
    r = np.random.default_rng(seed)
    return {k: r.standard_normal((n, DIM)) for k, n in COUNTS.items()}


def stack_of(kind, heads=2, seed=2):
    r = np.random.default_rng(seed)
    layers = []
    for rows in (DIM, WIDE):
        params = {rel: {"weight": r.standard_normal((rows, WIDE)), "bias": r.standard_normal(WIDE)} for rel in RELATIONS}
        for p in params.values():
            p |= {"left": r.standard_normal((heads, WIDE // heads)), "right": r.standard_normal((heads, WIDE // heads))} if kind == "rgat" else {}
        layers.append(params)
    return H.Stack(kind, layers, (r.standard_normal((WIDE, CLASSES)), r.standard_normal(CLASSES)), "b", heads)


def plain(stack, edges, h):
    for k, params in enumerate(stack.layers):
        said = {}
        for rel, (s, t) in RELATIONS.items():
            if s not in h or t not in h:
                continue
            p = params[rel]
            out_degree = {u: sum(x == u for x, _ in edges[rel]) for u, _ in edges[rel]}
            for v in {d for _, d in edges[rel]}:
                near = [u for u, d in edges[rel] if d == v]
                if stack.kind == "rgcn":
                    z = sum(h[s][u] / np.sqrt(out_degree[u] * len(near)) for u in near) @ p["weight"] + p["bias"]
                elif stack.kind == "rsage":
                    z = (h[t][v] + sum(h[s][u] for u in near)) / (len(near) + 1) @ p["weight"] + p["bias"]
                else:
                    parts = []
                    for j in range(stack.heads):
                        cut = slice(j * WIDE // stack.heads, (j + 1) * WIDE // stack.heads)
                        zs = [(h[s][u] @ p["weight"])[cut] for u in near]
                        e = np.array([z @ p["left"][j] + (h[t][v] @ p["weight"])[cut] @ p["right"][j] for z in zs])
                        e = np.exp(np.where(e > 0, e, 0.2 * e))
                        parts.append(sum(x * z for x, z in zip(e / e.sum(), zs, strict=True)))
                    z = np.concatenate(parts) + p["bias"]
                said.setdefault((t, v), []).append(z)
        new = {t: np.zeros((COUNTS[t], WIDE)) for t, _ in said}
        for (t, v), every in said.items():
            new[t][v] = np.mean(every, 0) if stack.kind == "rgcn" else np.sum(every, 0)
        h = {t: x if k == len(stack.layers) - 1 else np.maximum(x, 0) for t, x in new.items()}
    return h[stack.target] @ stack.head[0] + stack.head[1]


@pytest.mark.parametrize("kind", ["rgcn", "rsage", "rgat"])
def test_two_layers_equal_numpy(spark, kind):
    edges, features, stack = edges_of(), features_of(), stack_of(kind)
    got = {r.node_id: np.array(r.h) for r in H.forward(stack, loaded(spark, edges, features=features)).collect()}
    want = plain(stack, edges, features)
    assert sorted(got) == list(range(COUNTS["b"])) and all(np.allclose(got[v], want[v]) for v in got)
    assert np.allclose(got[COUNTS["b"] - 1], stack.head[1])  # no relation reaches it


def test_schema_and_loader_refuse_what_does_not_fit(spark):
    edges, features = edges_of(), features_of()
    with pytest.raises(ValueError):
        H.Schema({"a": 1}, {"ab": ("a", "b")})
    with pytest.raises(ValueError, match="ab, source"):
        loaded(spark, edges | {"ab": [(7, 0)]}, features=features)
    with pytest.raises(ValueError, match="features of c"):
        loaded(spark, edges, features=features | {"c": np.zeros((5, DIM))})
    with pytest.raises(ValueError):
        loaded(spark, {"ab": edges["ab"]}, features=features)
    g = loaded(spark, edges, features=features | {"c": np.zeros((2, DIM))})
    assert [r.h for r in g.features["c"].orderBy("node_id").collect()] == [[0.0] * DIM] * 4 and g.nodes["a"].count() == 7
    at = g.schema.offsets()
    assert at == {"a": 0, "b": 7, "c": 12}
    assert sorted(tuple(r) for r in g.homogeneous().collect()) == sorted((rel, s + at[RELATIONS[rel][0]], d + at[RELATIONS[rel][1]]) for rel, e in edges.items() for s, d in e)
    with pytest.raises(ValueError):
        H.forward(H.Stack("rgcn", stack_of("rgcn").layers, stack_of("rgcn").head, "c"), g)


def test_sampling_by_relation(spark):
    edges = edges_of(3)
    g = loaded(spark, edges, features=features_of())
    seeds = [(0, 0), (0, 1), (1, 2)]
    blocks, inputs = H.sample(g, "b", spark.createDataFrame(seeds, "batch long, node_id long"), [1, 2])
    frontier = {"b": set(seeds)}
    for layer, fanout in ((1, 2), (0, 1)):
        grown = {k: set(v) for k, v in frontier.items()}
        for rel, (s, t) in RELATIONS.items():
            want = set()
            for batch, v in frontier.get(t, ()):
                mine = sorted((hashlib.md5(f"42|{rel}layer{layer}|{batch}|{k}".encode()).hexdigest(), k) for k, (_, d) in enumerate(edges[rel]) if d == v)[:fanout]
                want |= {(batch, *edges[rel][k], k) for _, k in mine}
            assert {tuple(r) for r in blocks[layer][rel].collect()} == want if t in frontier else rel not in blocks[layer]
            if t in frontier:
                grown.setdefault(s, set()).update((batch, u) for batch, u, _, _ in want)
        frontier = grown
    assert {k: {tuple(r) for r in f.collect()} for k, f in inputs.items()} == frontier


def test_counters_are_observed(spark):
    e = spark.createDataFrame([(k, k % 9, (k * 7) % 9) for k in range(60)], "edge_id long, src long, dst long")
    blocks = B.sample(spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "batch long, node_id long"), e, [2, 2])
    assert blocks.counters() == {"nodes": [n.count() for n in blocks.nodes], "edges": [b.count() for b in blocks.edges]}


def test_ties_between_sixth_decimals_don_t_depend_on_the_order_of_a_sum(spark):
    import duckdb

    from graphmill.plans import layer_plans as P

    about = [x + e for x in (-0.0175965, 0.0175965, 0.3103555, -2.0000005, 0.0) for e in (-4e-16, 0.0, 4e-16)]
    got = P.tie_safe(spark.createDataFrame([(1, about)], "node_id long, h array<double>"), "node_id").first().h
    assert got == [x for x in (-0.017597, 0.017597, 0.310356, -2.000001, 0.0) for _ in range(3)]
    assert got == duckdb.sql(f"select {P.tie_safe_sql('h')} from (select {about}::double[] as h)").fetchall()[0][0]


def test_attention_writes_nothing_for_each_edge_and_a_hub_spans_blocks(spark, monkeypatch):
    from graphmill.functions import arrays
    from graphmill.operators import layers as L

    def refuse(df):
        raise AssertionError("scores of edges are written")

    monkeypatch.setattr(L, "cut", refuse)
    monkeypatch.setattr(arrays, "BLOCK_EDGES", 40)
    r, n = np.random.default_rng(5), 60
    edges = [(int(x), 3) for x in r.integers(0, n, 150)] + [(int(x), int(y)) for x, y in r.integers(0, n - 1, (100, 2))]
    h, w = r.standard_normal((n, 3)) * 40, r.standard_normal((3, 4))  # scores that overflow without their maximum
    left, right, bias = r.standard_normal((2, 2)) * 20, r.standard_normal((2, 2)) * 20, r.standard_normal(4)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(h)], "node_id long, h array<double>")
    got = {x.node_id: x.h for x in L.gat_layer(spark.createDataFrame(edges, "src long, dst long"), frame, w, left, right, bias).collect()}
    z = (h @ w).reshape(n, 2, 2)
    for v in range(n):
        near = [s for s, d in edges if d == v]
        s = (z[near] * left).sum(2) + (z[v] * right).sum(1)
        e = np.where(s > 0, s, 0.2 * s)
        e = np.exp(e - e.max(0)) if near else e
        want = ((e / e.sum(0))[:, :, None] * z[near]).sum(0).ravel() if near else np.zeros(4)
        assert np.allclose(got[v], want + bias)


def test_edges_are_packed_and_only_what_scores_depend_on_is_worked_out(spark):
    from graphmill.functions import arrays

    schema = H.Schema(COUNTS, RELATIONS)
    assert H.speaking(stack_of("rgcn"), schema) == [["ba", "aa"], ["ab"]]  # c has no states after a layer, and rgcn doesn't ask for the target's own
    assert H.speaking(stack_of("rsage"), schema) == [["ab", "ba", "cb", "aa"], ["ab"]]
    edges = spark.createDataFrame([(k % 5, k % 90) for k in range(900)], "src long, dst long")
    near = arrays.packed(edges, 4)
    rows = near.rows.collect()
    assert len(rows) <= 5 * near.blocks and sorted((r.src, d) for r in rows for d in r.near) == sorted((k % 5, k % 90) for k in range(900))


def test_an_edge_outside_of_the_counts_raises(spark):
    bad = edges_of() | {"cb": [(0, 1), (COUNTS["c"], 2)]}
    with pytest.raises(ValueError, match=r"cb, source: ids from 0 to 4 don't fit 4 nodes of c"):
        loaded(spark, bad, features=features_of())


def test_attention_sends_no_vectors_to_the_driver(spark, tmp_path):
    """Files look small beside the vectors made of them, so no join of vectors or targets may be planned as a broadcast."""
    from graphmill.operators import layers

    spark.range(10).selectExpr("id as node_id", "array(double(id), 2.0D) as h").write.parquet(f"{tmp_path}/h")
    h, edges = spark.read.parquet(f"{tmp_path}/h"), spark.range(50).selectExpr("id % 7 as src", "id % 5 as dst")
    out = layers.gat_layer(edges, h, np.eye(2), np.ones((1, 2)), np.ones((1, 2)), np.zeros(2))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.node_id for r in out.collect()} == set(range(10))
