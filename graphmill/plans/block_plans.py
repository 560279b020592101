"""Whole models over sampled blocks, training and evaluation; weights from a rule, so that SQL can hold them too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill import queries as Q
from graphmill.operators import block_models as B
from graphmill.operators import graph as G
from graphmill.operators import layers as L
from graphmill.plans import layer_plans as P
from graphmill.sources import views as V

HIDDEN, CLASSES, HEADS, FANOUTS = 16, 10, 2, [5, 5]


def ruled(kind: str) -> B.Model:
    """Two layers with the weights of the rule; salts 20 to 27."""
    w, b, wide = P.weights, P.bias, HEADS * HIDDEN
    if kind == "sage":
        layers = [{"own": w(n, m, 20 + 2 * k), "neigh": w(n, m, 21 + 2 * k), "bias": b(m, 20 + 2 * k)} for k, (n, m) in enumerate([(P.DIM, HIDDEN), (HIDDEN, CLASSES)])]
    elif kind == "gcn":
        layers = [{"weight": w(n, m, 20 + 2 * k), "bias": b(m, 20 + 2 * k)} for k, (n, m) in enumerate([(P.DIM, HIDDEN), (HIDDEN, CLASSES)])]
    else:
        layers = [
            {"source": w(n, HEADS * m, 20 + 4 * k), "target": w(n, HEADS * m, 21 + 4 * k), "left": w(HEADS, m, 22 + 4 * k), "right": w(HEADS, m, 23 + 4 * k), "bias": b(HEADS * m, 20 + 4 * k)}
            for k, (n, m) in enumerate([(P.DIM, HIDDEN), (wide, CLASSES)])
        ]
    return B.Model(kind, layers, HEADS if kind == "gat" else 1)


def linear_sql(terms: list[tuple[str, int, int]], columns: int, bias: int | None = None) -> str:
    """Sums of products: (list, rows, salt of its weights) each."""
    sums = " + ".join(f"list_sum(list_transform(range({rows}), lambda i: {x}[i + 1] * {P.w_sql(salt)}))" for x, rows, salt in terms)
    return f"list_transform(range({columns}), lambda j: {sums}{'' if bias is None else ' + ' + P.b_sql(bias)})"


def summed_layer_sql(k: int, kind: str, edges: str, targets: str, rows: int, columns: int) -> str:
    """h{k + 1} (batch, node_id, h) from h{k}: sage or gcn."""
    salt = 20 + 2 * k
    degree = f"i{k} as (select batch, dst, count(*) as n from {edges} group by all), o{k} as (select batch, src, count(*) as n from {edges} group by all)"
    weight = "1.0::double / i.n" if kind == "sage" else "1.0::double / sqrt(i.n * o.n)"
    terms = [("s.h", rows, salt), ("s.m", rows, salt + 1)] if kind == "sage" else [("s.m", rows, salt)]
    z = linear_sql(terms, columns, salt)
    z = f"list_transform({z}, lambda v: greatest(v, 0.0))" if k == 0 else z
    return f"""{degree},
x{k} as (select batch, node_id, generate_subscripts(h, 1)::int as dim, unnest(h) as x from h{k}),
a{k} as (select e.batch, e.dst, x.dim, sum(x.x * {weight}) as m from {edges} e join i{k} i using (batch, dst) join o{k} o using (batch, src) join x{k} x on x.batch = e.batch and x.node_id = e.src group by all),
m{k} as (select batch, dst, list(m order by dim) as m from a{k} group by all),
s{k} as (select t.batch, t.node_id, h.h, coalesce(m.m, list_transform(range({rows}), lambda i: 0.0::double)) as m from {targets} t join h{k} h using (batch, node_id) left join m{k} m on m.batch = t.batch and m.dst = t.node_id),
h{k + 1} as materialized (select s.batch, s.node_id, {z} as h from s{k} s)"""


def gat_layer_sql(k: int, edges: str, targets: str, rows: int, columns: int) -> str:
    """h{k + 1} from h{k}; the last layer is the mean over heads."""
    salt, wide = 20 + 4 * k, HEADS * columns
    side = lambda z, s: f"list_transform(range({HEADS}), lambda q: list_sum(list_transform(range({columns}), lambda c: {z}[q * {columns} + c + 1] * {P.w_sql(s, 'q', 'c')})))"
    biased = f"list_transform(range({wide}), lambda j: coalesce(y.x[j + 1], 0.0) + {P.b_sql(salt)})"
    mean = f"list_transform(range({columns}), lambda c: list_sum(list_transform(range({HEADS}), lambda q: b.h[q * {columns} + c + 1])) / {HEADS})"
    return f"""zs{k} as materialized (select h.batch, h.node_id, {linear_sql([("h.h", rows, salt)], wide)} as z from h{k} h),
zt{k} as materialized (select t.batch, t.node_id, {linear_sql([("h.h", rows, salt + 1)], wide)} as z from {targets} t join h{k} h using (batch, node_id)),
l{k} as materialized (select batch, node_id, z, {side("z", salt + 2)} as l from zs{k}), r{k} as materialized (select batch, node_id, {side("z", salt + 3)} as r from zt{k}),
e{k} as (select e.batch, e.dst, q.q, l.z, l.l[q.q + 1] + r.r[q.q + 1] as s from {edges} e join l{k} l on l.batch = e.batch and l.node_id = e.src join r{k} r on r.batch = e.batch and r.node_id = e.dst cross join (select unnest(range({HEADS})) as q) q),
w{k} as (select batch, dst, q, z, exp(case when s > 0 then s else 0.2 * s end) as w from e{k}),
c{k} as (select batch, dst, q, c.c, sum(w * z[q * {columns} + c.c + 1]) / sum(w) as x from w{k} cross join (select unnest(range({columns})) as c) c group by all),
y{k} as (select batch, dst, list(x order by q, c) as x from c{k} group by all),
v{k} as (select t.batch, t.node_id, {biased} as h from {targets} t left join y{k} y on y.batch = t.batch and y.dst = t.node_id),
h{k + 1} as materialized (select b.batch, b.node_id, {"b.h" if k == 0 else mean} as h from v{k} b)"""


def model_sql(kind: str) -> str:
    """Continues Q.SAMPLE (or ``heldout_sql``): seeds g_seedset, blocks b0 and b1, frontier f1, inputs g_input."""
    start = "h0 as materialized (select i.batch, i.node_id, f.embedding::double[] as h from g_input i join g_features f using (node_id))"
    layer = gat_layer_sql if kind == "gat" else lambda k, *more: summed_layer_sql(k, kind, *more)
    wide = HEADS * HIDDEN if kind == "gat" else HIDDEN
    return f"{start}, {layer(0, 'b0', 'f1', P.DIM, HIDDEN)}, {layer(1, 'b1', 'g_seedset', wide, CLASSES)}"


SCORES = f"select batch, node_id, {P.rounded_sql('h')} as h from h2"


def scores(s, d, kind: str) -> DataFrame:
    blocks = B.sample(Q.batch_nodes(s, d), V.edges(s, d), FANOUTS)
    return P.rounded(B.forward(ruled(kind), blocks, P.vectors(s, d))[0], "batch", "node_id")


@Q.query(SCORES, f"{Q.SAMPLE}, {model_sql('sage')}")
def sage_model(s, d):
    """Class scores of every seed of every batch: two layers over the batch's blocks."""
    return scores(s, d, "sage")


@Q.query(SCORES, f"{Q.SAMPLE}, {model_sql('gcn')}")
def gcn_model(s, d):
    return scores(s, d, "gcn")


@Q.query(f"select batch, node_id, {P.rounded_sql('list_transform(h, lambda v: v - ln(list_sum(list_transform(h, lambda y: exp(y)))))')} as h from h2", f"{Q.SAMPLE}, {model_sql('gat')}")
def gat_model(s, d):
    """Two layers with two heads each, the mean over heads, then log-softmax."""
    blocks = B.sample(Q.batch_nodes(s, d), V.edges(s, d), FANOUTS)
    h = B.forward(ruled("gat"), blocks, P.vectors(s, d))[0]
    return P.rounded(h.withColumn("h", L.log_softmax("h")), "batch", "node_id")


# Evaluation: the test split in order of ids, in batches of 32, through blocks of their own.
HELD_OUT = Q.SAMPLE.replace(
    Q.SAMPLE.split("b1 as materialized")[0],
    "g_n as (select count(*) as n from g_nodes), g_seedset as (select (row_number() over (order by node_id) - 1) // 32 as batch, node_id from g_nodes, g_n where node_id >= floor(n * 0.6) + floor(n * 0.2) and label is not null), ",
)


def held_out(s, d) -> tuple[DataFrame, DataFrame]:
    """(batch, node_id of the labelled test nodes; node_id, label)."""
    nodes = V.nodes(s, d)
    split = G.positional_split(nodes, nodes.count())
    labels = nodes.where("label is not null").select("node_id", "label")
    order = G.dense_index(split.where("split = 'test'").join(labels, "node_id").select("node_id"), "pos", "node_id")
    return order.select(F.floor(F.col("pos") / Q.BATCH).alias("batch"), "node_id"), labels


def accuracy_of(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    right = (F.col("predicted") == F.col("label")).cast("int")
    return predicted.join(labels, "node_id").agg(F.count(F.lit(1)).alias("nodes"), F.round(F.avg(right) * 100, 6).alias("accuracy"))


@Q.query("select count(*) as nodes, round(avg((list_position(h, list_max(h)) - 1 = n.label)::int) * 100, 6) as accuracy from h2 join g_nodes n using (node_id)", f"{HELD_OUT}, {model_sql('sage')}")
def evaluate_blocks(s, d):
    """Accuracy of the ruled model over the labelled test nodes, batch by batch."""
    seeds, labels = held_out(s, d)
    return accuracy_of(B.predict(ruled("sage"), seeds, V.edges(s, d), P.vectors(s, d), FANOUTS), labels)


#: Batch size of the training queries: two GPUs on two machines make a step of 512 nodes.
TRAIN_BATCH = 128


def trained(s, d, kind: str, epochs: int) -> tuple[B.Model, list]:
    train, _, t = Q.train_nodes(s, d)
    order = G.striped(G.train_order(train), TRAIN_BATCH, Q.GPUS, Q.MACHINES, t, drop_last=False)
    seeds = order.select("step", (F.col("step") * 4 + F.col("machine") * 2 + F.col("gpu")).alias("batch"), "node_id")
    labels = V.nodes(s, d).where("label is not null").select("node_id", "label")
    model = B.start(kind, P.DIM, HIDDEN, CLASSES, len(FANOUTS), HEADS)
    return B.train(model, seeds, V.edges(s, d), P.vectors(s, d), labels, FANOUTS, epochs)


@Q.query()
def train_minibatches(s, d):
    """epoch, step, loss: backpropagation through sampled blocks, one Adam step a global batch."""
    said = trained(s, d, "sage", 2)[1]
    return s.createDataFrame([(e, k, round(float(x), 6)) for e, k, x in said], "epoch int, step long, loss double")


@Q.query()
def evaluate_trained(s, d):
    """nodes, accuracy of a trained model over the labelled test nodes."""
    model, _ = trained(s, d, "sage", 1)
    seeds, labels = held_out(s, d)
    return accuracy_of(B.predict(model, seeds, V.edges(s, d), P.vectors(s, d), FANOUTS), labels)


@Q.query(
    "select (select count(*) from g_input) as sampled, (select count(*) from b0) as outer_edges, (select count(*) from b1) as inner_edges, (select count(*) from g_seedset) as seeds",
    Q.SAMPLE,
)
def observed_counters(s, d):
    """What sampling makes, counted by the jobs that make it."""
    seen = B.sample(Q.batch_nodes(s, d), V.edges(s, d), FANOUTS).counters()
    return s.createDataFrame([(seen["nodes"][0], seen["edges"][0], seen["edges"][1], seen["nodes"][-1])], "sampled long, outer_edges long, inner_edges long, seeds long")
