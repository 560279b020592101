"""Stacks of relation layers with a head on parts: every type has its own states, relations go both ways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill import queries as Q
from graphmill.operators import graph as G
from graphmill.operators import hetero as H
from graphmill.plans import layer_plans as P
from graphmill.sources import views as V

WIDE, CLASSES, TARGET = 8, 5, "part"
RELATIONS = Q.TYPES | {"bought_by": ("part", "customer"), "supplies": ("supplier", "part")}
BACK = {"bought_by": "orders", "supplies": "supplied_by"}
SALTS = {rel: 30 + k for k, rel in enumerate(RELATIONS)}


def graph(s, d) -> H.HeteroGraph:
    """The star schema as a graph of four node types; counts come from the tables before any edge is read."""
    counts = {kind: V.read(s, d, kind).count() for kind in Q.KINDS}
    every = V.hetero(s, d)
    edges = {rel: G.cut(every.where(F.col("rel") == rel).select("src", "dst")) for rel in Q.TYPES}  # a relation's edges alone are read wherever it speaks
    edges |= {rel: edges[there].select(F.col("dst").alias("src"), F.col("src").alias("dst")) for rel, there in BACK.items()}
    return H.load(s, H.Schema(counts, RELATIONS), edges, P.type_features(s, d))


def stack(kind: str) -> H.Stack:
    """Two layers with the weights of the rule."""
    layers = []
    for k, rows in enumerate((P.TYPE_DIM, WIDE)):
        params = {}
        for rel, salt in SALTS.items():
            params[rel] = {"weight": P.weights(rows, WIDE, salt + 10 * k), "bias": P.bias(WIDE, salt + 10 * k)}
            if kind == "rgat":
                params[rel] |= {"left": P.weights(P.HEADS, WIDE // P.HEADS, 5), "right": P.weights(P.HEADS, WIDE // P.HEADS, 6)}
        layers.append(params)
    return H.Stack(kind, layers, (P.weights(WIDE, CLASSES, 60), P.bias(CLASSES, 60)), TARGET, P.HEADS)


def scores(s, d, kind: str) -> DataFrame:
    return P.rounded(H.forward(stack(kind), graph(s, d)), "node_id")


SALT_SQL = "(case e.rel " + " ".join(f"when '{rel}' then {salt}" for rel, salt in SALTS.items()) + " end)"
GRAPH_SQL = P.FEATURES_SQL + """, g0 as materialized (select kind, node_id, h from hf),
r as materialized (select rel, sk, src, dk, dst from he union all select 'bought_by', 'part', dst, 'customer', src from he where rel = 'orders' union all select 'supplies', 'supplier', dst, 'part', src from he where rel = 'supplied_by'),
ro as (select rel, src, count(*) as n from r group by all), ri as (select rel, dst, count(*) as n from r group by all)"""


def layer_sql(k: int, kind: str, rows: int) -> str:
    """g{k + 1} (kind, node_id, h) from g{k}."""
    salt = f"({SALT_SQL} + {10 * k})"
    weight = "1.0::double / sqrt(o.n * i.n)" if kind == "rgcn" else "1.0::double"
    x = "e.m" if kind == "rgcn" else f"list_transform(range({rows}), lambda i: (e.m[i + 1] + t.h[i + 1]) / (e.n + 1))"
    h = f"coalesce(v.h, list_transform(range({WIDE}), lambda j: 0.0::double))"
    return f"""u{k} as (select e.rel, e.dk, e.dst, i.n, c.dim, sum(g.h[c.dim] * {weight}) as m from r e join ro o on o.rel = e.rel and o.src = e.src join ri i on i.rel = e.rel and i.dst = e.dst
  join g{k} g on g.kind = e.sk and g.node_id = e.src cross join (select unnest(range(1, {rows + 1})) as dim) c group by all),
l{k} as (select rel, dk, dst, n, list(m order by dim) as m from u{k} group by all),
x{k} as (select e.rel, e.dk, e.dst, {x} as x from l{k} e join g{k} t on t.kind = e.dk and t.node_id = e.dst),
y{k} as (select e.dk, e.dst, {P.product_sql('e.x', rows, WIDE, salt, f' + {P.b_sql(salt)}')} as y from x{k} e),
z{k} as (select dk, dst, j.j, {"avg" if kind == "rgcn" else "sum"}(y[j.j + 1]) as v from y{k} cross join (select unnest(range({WIDE})) as j) j group by all),
v{k} as (select dk, dst, list(v order by j) as h from z{k} group by all),
g{k + 1} as materialized (select f.kind, f.node_id, {h if k else f'list_transform({h}, lambda a: greatest(a, 0.0))'} as h from hf f left join v{k} v on v.dk = f.kind and v.dst = f.node_id)"""


def model_sql(kind: str) -> str:
    return f"{GRAPH_SQL}, {layer_sql(0, kind, P.TYPE_DIM)}, {layer_sql(1, kind, WIDE)}"


SCORES = f"select node_id, {P.rounded_sql(P.product_sql('h', WIDE, CLASSES, 60, ' + ' + P.b_sql(60)))} as h from g2 where kind = '{TARGET}'"


@Q.query(SCORES, model_sql("rgcn"))
def rgcn_model(s, d):
    """Class scores of every part: two layers, means over relations, a linear head."""
    return scores(s, d, "rgcn")


@Q.query(SCORES, model_sql("rsage"))
def rsage_model(s, d):
    return scores(s, d, "rsage")


@Q.query()
def rgat_model(s, d):
    return scores(s, d, "rgat")


@Q.query("select rel, src + case rel when 'orders' then 0 when 'customer_in' then 0 when 'supplies' then c + p when 'supplier_in' then c + p else c end as src, dst + case rel when 'bought_by' then 0 when 'orders' then c when 'supplies' then c when 'supplied_by' then c + p else c + p + u end as dst from r, (select (select count(*) from customer) as c, (select count(*) from part) as p, (select count(*) from supplier) as u)", GRAPH_SQL)
def typed_graph(s, d):
    """All relations, both ways, with the ids of one graph."""
    return graph(s, d).homogeneous()


@Q.query("select 'customer' as kind, count(*) as nodes, count(*) filter (c_custkey not in (select o_custkey from orders join lineitem on l_orderkey = o_orderkey)) as alone from customer")
def typed_isolated_nodes(s, d):
    """Customers, and how many of them no order reaches: nodes come from the counts, so these are there."""
    g = graph(s, d)
    alone = g.nodes["customer"].join(g.edges["bought_by"].select(F.col("dst").alias("node_id")).distinct(), "node_id", "left_anti").agg(F.count(F.lit(1)).alias("alone"))
    return g.nodes["customer"].agg(F.lit("customer").alias("kind"), F.count(F.lit(1)).alias("nodes")).crossJoin(F.broadcast(alone))  # a row each
