"""Graph queries against their SQL, and sequential models on small graphs."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill import queries as Q
from graphmill.functions import ordering
from graphmill.operators import graph as G

Q.register_plans()
SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
#: With fewer training nodes than two global batches these would compare nothing with nothing.
BATCHED = """baseline_distribution gpu_slices epoch_batches partition_scores affinity_distribution sample_blocks sample_one_layer input_nodes fetch_isolated fetch_isolated_whole fetch_positions
run_batches run_blocks csc_in_edges fetch_routed fetch_remapped cache_fetch route_requests request_histogram batch_labels epoch_counters minibatch_stream observed_counters sage_model gcn_model gat_model""".split()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def ducks():
    found = {}
    for folder in (SF, LARGER):
        found[folder] = duckdb.connect()
        for t in TABLES:
            found[folder].sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_matches_sql(spark, ducks, name):
    folder = LARGER if name in BATCHED else SF
    df = Q.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    wanted = ducks[folder].sql(Q.SQL[name])
    assert sorted(wanted.columns) == cols
    at = [wanted.columns.index(c) for c in cols]
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in wanted.fetchall())
    assert got, "no row is compared"


def stack_model(n, edges, seeds, train, levels=10):
    """The walk with stacks: pushed last, popped first."""
    adj = {v: [s for _, s, d in sorted(edges) if d == v] for v in range(n)}
    color, hop = {}, {}
    stack = []
    for c, s in seeds:
        stack.append((s, c))
    first = list(stack)
    for s, c in first:
        stack += [(v, c) for v in adj[s] if v in train]
    for level in range(1, levels + 1):
        later = []
        while stack:
            v, c = stack.pop()
            if v not in color:
                color[v], hop[v] = c, level
                later += [(u, c) for u in adj[v]]
        stack = later
    return {v: (color[v], hop[v]) for v in color}


def test_coloring_equals_stack_model(spark):
    for seed in range(2):
        r = random.Random(seed)
        n = 30
        edges = [(i, r.randrange(n), r.randrange(n)) for i in range(50)]
        train = set(range(18))
        seeds = [(c + 1, s) for c, s in enumerate(sorted(r.sample(sorted(train), 3)))]
        e = spark.createDataFrame(edges, "edge_id long, src long, dst long")
        got = G.color_graph(e, spark.createDataFrame([(s, c) for c, s in seeds], "node_id long, color long"), spark.createDataFrame([(v,) for v in train], "node_id long"))
        assert {x.node_id: (x.color, x.hop) for x in got.collect()} == stack_model(n, edges, seeds, train)


def test_whole_vectors(spark):
    """All 64 components of every node, against sums by hand."""
    edges = [(e.src, e.dst) for e in Q.QUERIES["coo_edges"](spark, SF).collect()]
    vector = {r.node_id: np.array(r.embedding, float) for r in Q.V.features(spark, SF).collect()}
    out, into = Counter(a for a, _ in edges), Counter(b for _, b in edges)
    total, norm = defaultdict(lambda: np.zeros(64)), defaultdict(lambda: np.zeros(64))
    for a, b in edges:
        total[b] += vector[a]
        norm[b] += vector[a] / np.sqrt(out[a] * into[b])
    want = {
        "sage_mean_whole": ("mean", {v: total[v] / into[v] for v in into}),
        "gcn_norm_sum_whole": ("total", dict(norm)),
        "sage_gcn_agg_whole": ("mean", {v: (vector[v] + total[v]) / (into[v] + 1) for v in vector}),
    }
    for name, (column, rows) in want.items():
        got = {(r.node_id, r.dim): r[column] for r in Q.QUERIES[name](spark, SF).collect()}
        assert set(got) == {(v, k) for v in rows for k in range(1, 65)}, name
        assert all(abs(x - rows[v][k - 1]) < 2e-6 for (v, k), x in got.items()), name
    fetched = Q.QUERIES["fetch_isolated_whole"](spark, SF).collect()
    assert len(fetched) == Q.QUERIES["input_nodes"](spark, SF).count() and all(r.embedding == vector[r.node_id].tolist() for r in fetched)


def test_every_rank_and_head(spark):
    dealt = Q.QUERIES["rank_stride_shards"](spark, SF).collect()
    assert {r.rank for r in dealt} == {0, 1, 2, 3} and len(dealt) == Q.QUERIES["train_order"](spark, SF).count()
    assert {(r.pos, r.node_id) for r in dealt if r.rank == 1} == {(r.pos, r.node_id) for r in Q.QUERIES["rank_stride_shard"](spark, SF).collect()}
    heads = Q.QUERIES["gat_attention_heads"](spark, SF).collect()
    assert {h: sum(r.head == h for r in heads) for h in range(4)} == dict.fromkeys(range(4), Q.QUERIES["coo_edges"](spark, SF).count())
    assert {(r.edge_id, r.attention) for r in heads if r.head == 0} == {(r.edge_id, r.attention) for r in Q.QUERIES["gat_attention"](spark, SF).collect()}


def test_hub_is_numbered_by_several_tasks(spark):
    r = random.Random(3)
    edges = [(k, r.randrange(50), 7 if r.random() < 0.9 else r.randrange(50)) for k in range(20_000)]
    r.shuffle(edges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one task
    try:
        got = G.adjacency(spark.createDataFrame(edges, "edge_id long, src long, dst long").repartition(5))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    seen = defaultdict(list)
    for k, s, d in sorted(edges):
        seen[d].append((s, k))
    assert {(x.dst, x.pos): (x.src, x.edge_id) for x in rows} == {(d, p): v for d, every in seen.items() for p, v in enumerate(every)} and len(rows) == len(edges)
    shares = Counter(x.task for x in rows)
    assert len(shares) == 4 and max(shares.values()) < 0.4 * len(edges)  # of four tasks, though one target has nine tenths
    assert sum(len({x.task for x in rows if x.dst == d}) > 1 for d in seen) >= 1


def test_hubs_are_sampled_chunk_by_chunk(spark, monkeypatch):
    monkeypatch.setattr(G, "HUB", 50)
    r = random.Random(4)
    edges = [(k, r.randrange(400), 7 if k % 3 else r.randrange(400)) for k in range(3000)]
    seeds = [(b, v) for b in range(3) for v in (7, 11, b)]
    e = spark.createDataFrame(edges, "edge_id long, src long, dst long")
    rows, chunks = G.hub_chunks(e)
    assert [(x.dst, x.chunks) for x in chunks.collect()] == [(7, -(-sum(d == 7 for *_, d in edges) // 50))]
    frontier = spark.createDataFrame(seeds, "batch long, node_id long")
    layer = G.sample_layer(frontier, rows, chunks, 4, 1)
    plan = layer._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and plan.count("WindowGroupLimit") == 2  # the limit holds before the shuffle too
    want = set()
    for b, v in set(seeds):
        mine = sorted((hashlib.md5(f"42|layer1|{b}|{k}".encode()).hexdigest(), k) for k, _, d in edges if d == v)[:4]
        want |= {(b, k) for _, k in mine}
    assert {(x.batch, x.edge_id) for x in layer.collect()} == want
    got = G.color_graph(e, spark.createDataFrame([(7, 1), (20, 2)], "node_id long, color long"), spark.createDataFrame([(v,) for v in range(200)], "node_id long"))
    assert {x.node_id: (x.color, x.hop) for x in got.collect()} == stack_model(400, edges, [(1, 7), (2, 20)], set(range(200)))


def test_levels_shuffle_frontiers_only(spark):
    r = random.Random(5)
    e = spark.createDataFrame([(k, r.randrange(900), r.randrange(900)) for k in range(5000)], "edge_id long, src long, dst long")
    adj, chunks = G.by_target(e)
    reached = G.reached(spark.createDataFrame([(3, 1)], "node_id long, color long"), adj, chunks)
    reached.count()
    plan = reached._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0].splitlines()
    above = plan[: next(k for k, line in enumerate(plan) if "InMemoryTableScan" in line)]
    while any(x in above[-1] for x in ("Sort ", "Filter ", "TableCacheQueryStage", "Project ")):
        above.pop()
    assert "Join" in above[-1] or "Exchange hashpartitioning" not in above[-1], above  # the kept edges are joined where they lie
    adj.unpersist()


def greedy(rows, domain, machines):
    fill, out = [0] * machines, {}
    for pos in sorted(rows):
        m = max(range(machines), key=lambda k: (rows[pos][k] if fill[k] < domain else -1.0, -k))
        out[pos] = (m, fill[m])
        fill[m] += 1
    return out


@pytest.mark.parametrize(("machines", "domain"), [(2, 6), (16, 4), (3, 1)])
def test_distribution_equals_one_row_after_the_other(spark, machines, domain):
    r = random.Random(machines)
    steps = {s: {s * machines * domain + k: [r.choice([0.0, 0.5, 0.5, 1.0, 2.0 * (s == 1) * (m == 1)]) for m in range(machines)] for k in range(machines * domain - 3 * (s == 2))} for s in range(3)}
    steps[3] = {900 + k: [0.0] * machines for k in range(machines * domain)}  # no scores: striping
    rows = [(s, p, p + 1000, m, float(x)) for s, every in steps.items() for p, xs in every.items() for m, x in enumerate(xs)]
    got = G.distribute(spark.createDataFrame(rows, "step long, pos long, node_id long, machine int, score double").repartition(3), domain, 2, machines).collect()
    want = {(s, p): v for s, every in steps.items() for p, v in greedy(every, domain, machines).items()}
    assert {(x.step, x.pos): (x.machine, x.slot) for x in got} == want and len(got) == len(want)
    assert all(x.gpu == x.slot // 2 and x.node_id == x.pos + 1000 for x in got)
    assert [want[(3, 900 + k)][0] for k in range(machines * domain)] == [k // domain for k in range(machines * domain)]


def test_dense_numbers_of_any_partitioning(spark):
    r = random.Random(6)
    keys = [(k % 7, k) for k in r.sample(range(10_000), 3000)]
    got = ordering.dense_index(spark.createDataFrame(keys, "a int, b int").repartition(6), "i", F.desc("a"), "b").collect()
    assert [(x.a, x.b) for x in sorted(got, key=lambda x: x.i)] == sorted(keys, key=lambda k: (-k[0], k[1])) and sorted(x.i for x in got) == list(range(3000))
    assert ordering.dense_index(spark.createDataFrame([], "a int"), "i", "a").count() == 0


def test_neighbor_sums_send_a_vector_to_a_block_once(spark, monkeypatch):
    """Against plain sums, with a hub in several blocks, a source without a vector, parallel edges, blocks that share tasks and one vector that many batches ask for."""
    import numpy as np

    from graphmill.functions import arrays as A

    r = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in zip(r.integers(0, 40, 600), r.integers(0, 30, 600), strict=True)] + [(k % 40, 99) for k in range(300)] + [(3, 98)] * 50
    x, w = r.standard_normal((39, 5)).astype(np.float32), r.random(39)  # 39 has no vector
    h = spark.createDataFrame([(i, x[i].tolist(), float(w[i])) for i in range(39)], "node_id long, h array<float>, w double")
    frame = spark.createDataFrame(edges, "src long, dst long")
    for limits in ((1 << 23, 1 << 20), (25, 60)):
        monkeypatch.setattr(A, "BLOCK_NUMBERS", limits[0])
        monkeypatch.setattr(A, "BLOCK_EDGES", limits[1])
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        try:
            got = {g.dst: g for g in A.neighbor_sums(frame, h, 5).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        for dst in {b for _, b in edges}:
            of = [a for a, b in edges if b == dst and a < 39]
            assert got[dst].n == len(of) and np.allclose(got[dst].total, sum(x[a].astype(float) * w[a] for a in of))
        assert len(got) == len({b for _, b in edges})


def test_remapped_rows_meet_their_positions_before_vectors(spark):
    from graphmill.operators import fetch

    asked = spark.createDataFrame([(b, p, 3 * p + b) for b in range(2) for p in range(5)], "batch long, pos long, node_id long")
    held = spark.createDataFrame([(n, [float(n), -float(n)]) for n in range(20)], "node_id long, embedding array<double>")
    got = fetch.fetch_remapped(asked, held, 2)
    assert {(r.batch, r.pos): (r.node_id, r.owner, r.embedding) for r in got.collect()} == {(b, p): (3 * p + b, (3 * p + b) % 2, [3.0 * p + b, -3.0 * p - b]) for b in range(2) for p in range(5)}
    last = next(line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)
    assert "node_id" in last and "slot" not in last  # nothing is shuffled by slot once the vectors are there


def under(df, upper: str, lower: str) -> bool:
    """Whether all nodes of the optimised plan that hold ``upper`` lie above all that hold ``lower``."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return max(k for k, x in enumerate(lines) if upper in x) < min(k for k, x in enumerate(lines) if lower in x)


def test_components_are_taken_apart_after_the_sums(spark):
    from graphmill import queries as Q

    for name in ("sage_mean", "sage_gcn_agg", "gcn_norm_sum", "gat_attention_heads"):
        assert under(Q.queries()[name](spark, "/root/testdata/sf0.001"), "Generate posexplode", "Aggregate")


def test_first_components_of_odd_vectors(spark, tmp_path):
    """A null component doesn't count, a short vector has no later components."""
    from graphmill import queries as Q

    d, schema = str(tmp_path), "vec_id long, label int, embedding array<float>"
    spark.createDataFrame([(1, 1, 1, 1), (1, 2, 0, 1), (2, 1, 2, 1), (2, 2, 0, 1)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in range(3)], "p_partkey long").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(0, 1, [1.0] * 8), (1, 1, [2.0, None]), (2, 1, [4.0] * 9)], schema).write.parquet(f"{d}/embeddings.parquet")
    got = {(r.node_id, r.dim): r["mean"] for r in Q.queries()["sage_mean"](spark, d).collect()}
    assert got == {(0, 1): 3.0} | {(0, k): 4.0 for k in range(2, 9)}
    own = {(r.node_id, r.dim): r["mean"] for r in Q.queries()["sage_gcn_agg"](spark, d).collect()}
    assert own[0, 1] == round(7 / 3, 6) and own[0, 2] == round(5 / 3, 6) and own[0, 3] == 2.5 and own[1, 1] == 2.0 and own[1, 2] is None and (1, 3) not in own and len(own) == 18


def test_claims_are_one_number_in_their_order(spark):
    """A level sorts a row for each target and aggregates claims in place; where 62 bits don't hold a claim it stays a struct."""
    rows = [(g, r, p) for g in (0, 1) for r in (0, 1, 6, 7) for p in (0, 3, 4, 15)]
    for most, last, kind in ((7, 15, "bigint"), (7, 1 << 60, "struct<g:bigint,r:bigint,p:bigint>")):
        keyed = spark.createDataFrame(rows, "g long, r long, p long").withColumn("k", G.claim(most, last))
        assert dict(keyed.dtypes)["k"] == kind and [(x.g, x.r, x.p) for x in keyed.orderBy("k").collect()] == rows
    e = spark.createDataFrame([(k, k % 9, 3) for k in range(40)], "edge_id long, src long, dst long")
    assert G.by_target(e)[0].count() == 1


def test_sage_mean_and_sage_gcn_agg_hold_every_component(spark, tmp_path):
    """All components, also of vectors wider than the given ones, with null components and short vectors."""
    from graphmill import queries as Q

    for name in ("sage_mean", "sage_gcn_agg"):
        assert "dim <= 8" not in Q.SQL[name]
    for wide, odd in ((70, False), (11, True)):
        d, schema = str(tmp_path / str(wide)), "vec_id long, label int, embedding array<float>"
        spark.createDataFrame([(1, 1, 1, 1), (1, 2, 0, 1), (2, 1, 2, 1), (2, 2, 0, 1)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{d}/lineitem.parquet")
        spark.createDataFrame([(k,) for k in range(3)], "p_partkey long").write.parquet(f"{d}/part.parquet")
        vectors = [[1.0 + k for k in range(wide)], [2.0, None] if odd else [2.0] * wide, [4.0 - k for k in range(wide)]]
        spark.createDataFrame([(k, 1, v) for k, v in enumerate(vectors)], schema).write.parquet(f"{d}/embeddings.parquet")
        x = [v + [None] * (wide - len(v)) for v in vectors]
        near = [[y for y in (x[1][k], x[2][k]) if y is not None] for k in range(wide)]
        got = {(r.node_id, r.dim): r["mean"] for r in Q.QUERIES["sage_mean"](spark, d).collect()}
        assert got == {(0, k + 1): sum(near[k]) / len(near[k]) for k in range(wide)}
        own = {(r.node_id, r.dim): r["mean"] for r in Q.QUERIES["sage_gcn_agg"](spark, d).collect()}
        counted = [2 if k < len(vectors[1]) else 1 for k in range(wide)]
        assert own == {(0, k + 1): round((x[0][k] + sum(near[k])) / (counted[k] + 1), 6) for k in range(wide)} | {(n, k + 1): v for n in (1, 2) for k, v in enumerate(vectors[n])}
