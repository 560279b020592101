"""Layers of the models over whole vectors, with weights from a rule, so that SQL can hold them too."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill import queries as Q
from graphmill.functions.ordering import new_folder, written
from graphmill.operators import graph as G
from graphmill.operators import layers as L
from graphmill.operators import training as T
from graphmill.sources import views as V

DIM, OUT, HEADS = 64, 16, 4
TYPE_DIM, TYPE_OUT = 4, 8


def weights(rows: int, columns: int, salt: int) -> np.ndarray:
    i, j = np.arange(rows)[:, None] + 1, np.arange(columns)[None, :] + 1
    return ((i * 31 + j * 17 + salt * 7) % 23 - 11) / 184.0


def bias(columns: int, salt: int) -> np.ndarray:
    return ((np.arange(columns) * 5 + salt) % 7 - 3) / 7.0


def w_sql(salt: int, i: str = "i", j: str = "j") -> str:
    return f"(((({i} + 1) * 31 + ({j} + 1) * 17 + {salt} * 7) % 23 - 11)::double / 184.0)"


def b_sql(salt: int, j: str = "j") -> str:
    return f"((({j} * 5 + {salt}) % 7 - 3)::double / 7.0)"


def product_sql(x: str, rows: int, columns: int, salt: int, with_bias: str = "") -> str:
    return f"list_transform(range({columns}), lambda j: list_sum(list_transform(range({rows}), lambda i: {x}[i + 1] * {w_sql(salt)})){with_bias})"


def rounded_sql(x: str) -> str:
    return f"list_transform({x}, lambda v: round(v, 6) + 0.0)"


def rounded(h: DataFrame, *keys: str) -> DataFrame:
    return h.select(*keys, F.transform("h", lambda x: F.round(x, 6) + F.lit(0.0)).alias("h"))


def tie_safe(h: DataFrame, *keys: str) -> DataFrame:
    """``rounded`` over 12 decimals of each number, ties away from zero, for sums of such decimals that real ties come from: the order of a sum then decides nothing."""
    return rounded(h.select(*keys, F.transform("h", lambda x: F.round(x, 12)).alias("h")), *keys)


def tie_safe_sql(x: str) -> str:
    return f"list_transform({x}, lambda v: round(v::decimal(38, 12), 6)::double + 0.0)"


def vectors(s, d) -> DataFrame:
    return V.features(s, d).select("node_id", F.col("embedding").cast("array<double>").alias("h"))


H = "h as materialized (select node_id, embedding::double[] as h from g_features), hx as materialized (select node_id, generate_subscripts(h, 1)::int as dim, unnest(h) as x from h)"
MEAN = H + ", m1 as (select e.dst, x.dim, avg(x.x) as m from g_edges e join hx x on x.node_id = e.src group by 1, 2), m as (select dst, list(m order by dim) as m from m1 group by 1)"
SAGE = f"select h.node_id, {rounded_sql(f'list_transform(range({OUT}), lambda j: list_sum(list_transform(range({DIM}), lambda i: h.h[i + 1] * {w_sql(1)} + coalesce(m.m[i + 1], 0.0) * {w_sql(2)})) + {b_sql(1)})')} as h from h left join m on m.dst = h.node_id"


@Q.query(SAGE, MEAN)
def sage_layer(s, d):
    return rounded(L.sage_layer(V.pairs(s, d), Q.stored(s, d), weights(DIM, OUT, 1), weights(DIM, OUT, 2), bias(OUT, 1)), "node_id")


NORM = H + ", o as (select src, count(*) as o from g_edges group by 1), n as (select dst, count(*) as n from g_edges group by 1), m1 as (select e.dst, x.dim, sum(x.x / sqrt(o.o * n.n)) as m from g_edges e join o using (src) join n using (dst) join hx x on x.node_id = e.src group by 1, 2), m as (select dst, list(m order by dim) as m from m1 group by 1)"


@Q.query(f"select h.node_id, {rounded_sql(f'list_transform(range({OUT}), lambda j: list_sum(list_transform(range({DIM}), lambda i: coalesce(m.m[i + 1], 0.0) * {w_sql(3)})) + {b_sql(3)})')} as h from h left join m on m.dst = h.node_id", NORM)
def gcn_layer(s, d):
    return rounded(L.gcn_layer(V.pairs(s, d), Q.stored(s, d), weights(DIM, OUT, 3), bias(OUT, 3)), "node_id")


def attention_sql(edges: str, width: int, target: str = "z") -> str:
    """CTEs from z (node_id, z) to a row (dst, head, c, x) for each target, head and component."""
    side = lambda salt: f"list_transform(range({HEADS}), lambda k: list_sum(list_transform(range({width}), lambda c: z[k * {width} + c + 1] * {w_sql(salt, 'k', 'c')})))"
    return f"""zl as materialized (select node_id, z, {side(5)} as l from z), zr as materialized (select node_id, {side(6)} as r from {target}),
sc as (select e.dst, k.k, a.z, a.l[k.k + 1] + b.r[k.k + 1] as e from {edges} e join zl a on a.node_id = e.src join zr b on b.node_id = e.dst cross join (select unnest(range({HEADS})) as k) k),
ex as (select dst, k, z, exp(case when e > 0 then e else 0.2 * e end) as e from sc),
hc as (select dst, k, c.c, sum(e * z[k * {width} + c.c + 1]) / sum(e) as x from ex cross join (select unnest(range({width})) as c) c group by 1, 2, 3)"""


GAT_W = OUT // HEADS
GAT = f"{H}, z as materialized (select node_id, {product_sql('h', DIM, OUT, 4)} as z from h), {attention_sql('g_edges', GAT_W)}, ha as (select dst, list(x order by k, c) as x from hc group by 1)"


@Q.query(f"select h.node_id, {rounded_sql(f'list_transform(range({OUT}), lambda j: coalesce(ha.x[j + 1], 0.0) + {b_sql(4)})')} as h from h left join ha on ha.dst = h.node_id", GAT)
def gat_layer(s, d):
    return rounded(L.gat_layer(G.cut(V.pairs(s, d)), vectors(s, d), weights(DIM, OUT, 4), weights(HEADS, GAT_W, 5), weights(HEADS, GAT_W, 6), bias(OUT, 4)), "node_id")


LAST = f"{GAT}, hm as (select dst, c, avg(x) as x from hc group by 1, 2), hl as (select dst, list(x order by c) as x from hm group by 1), lo as (select h.node_id, list_transform(range({GAT_W}), lambda j: coalesce(hl.x[j + 1], 0.0) + {b_sql(4)}) as x from h left join hl on hl.dst = h.node_id)"


@Q.query(f"select node_id, {rounded_sql('list_transform(x, lambda v: v - ln(list_sum(list_transform(x, lambda y: exp(y)))))')} as h from lo", LAST)
def gat_last_layer(s, d):
    """The last layer: the mean over heads, then log-softmax."""
    out = L.gat_layer(G.cut(V.pairs(s, d)), vectors(s, d), weights(DIM, OUT, 4), weights(HEADS, GAT_W, 5), weights(HEADS, GAT_W, 6), bias(GAT_W, 4), last=True)
    return rounded(out.select("node_id", L.log_softmax("h").alias("h")), "node_id")


@Q.query(f"select node_id, {rounded_sql('list_transform(h, lambda v: greatest(v, 0.0))')} as relu, {rounded_sql('list_transform(h, lambda v: exp(v) / list_sum(list_transform(h, lambda y: exp(y))))')} as shares from h", H)
def vector_functions(s, d):
    six = lambda v: F.transform(v, lambda x: F.round(x, 6) + F.lit(0.0))
    return vectors(s, d).select("node_id", six(L.relu("h")).alias("relu"), six(L.softmax("h")).alias("shares"))


# Models over several relations: features of customers, parts, suppliers and nations are columns of their own tables.
FEATURES_SQL = """hf as materialized (
  select 'customer' as kind, c_custkey as node_id, [c_acctbal / 10000, c_nationkey / 25.0::double, length(c_mktsegment) / 10.0::double, 1.0::double]::double[] as h from customer
  union all select 'part', p_partkey, [p_retailprice / 2000, p_size / 50.0::double, length(p_type) / 25.0::double, 1.0::double]::double[] from part
  union all select 'supplier', s_suppkey, [s_acctbal / 10000, s_nationkey / 25.0::double, length(s_name) / 20.0::double, 1.0::double]::double[] from supplier
  union all select 'nation', n_nationkey::bigint, [n_regionkey / 5.0::double, length(n_name) / 20.0::double, 0.0::double, 1.0::double]::double[] from nation),
he as materialized (select rel, src, dst, case rel when 'orders' then 'customer' when 'supplied_by' then 'part' when 'customer_in' then 'customer' else 'supplier' end as sk,
                    case rel when 'orders' then 'part' when 'supplied_by' then 'supplier' else 'nation' end as dk from g_hetero),
hex as (select e.rel, e.dk, e.src, e.dst, t.dim, f.h[t.dim] as x from he e join hf f on f.kind = e.sk and f.node_id = e.src cross join (select unnest(range(1, 5)) as dim) t)"""


def type_features(s, d) -> dict[str, DataFrame]:
    """node_id, h by node type."""
    real = lambda c, by: F.col(c).cast("double") / F.lit(float(by))
    one, long_ = F.lit(1.0), lambda c, by: F.length(c) / F.lit(float(by))
    return {
        "customer": V.read(s, d, "customer").select(F.col("c_custkey").alias("node_id"), F.array(real("c_acctbal", 10000), real("c_nationkey", 25), long_("c_mktsegment", 10), one).alias("h")),
        "part": V.read(s, d, "part").select(F.col("p_partkey").alias("node_id"), F.array(real("p_retailprice", 2000), real("p_size", 50), long_("p_type", 25), one).alias("h")),
        "supplier": V.read(s, d, "supplier").select(F.col("s_suppkey").alias("node_id"), F.array(real("s_acctbal", 10000), real("s_nationkey", 25), long_("s_name", 20), one).alias("h")),
        "nation": V.read(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("node_id"), F.array(real("n_regionkey", 5), long_("n_name", 20), F.lit(0.0), one).alias("h")),
    }


RELATIONS = ("orders", "supplied_by", "customer_in", "supplier_in")
SALT_SQL = "case rel when 'orders' then 10 when 'supplied_by' then 11 when 'customer_in' then 12 else 13 end"


def by_relation(s, d, layer) -> dict[str, list[DataFrame]]:
    """Vectors of the targets by target type, one frame a relation."""
    edges, h, out = written(V.hetero(s, d), new_folder(s, "relations"), "rel"), type_features(s, d), {}
    for k, rel in enumerate(RELATIONS):
        source, target = Q.TYPES[rel]
        out.setdefault(target, []).append(layer(edges.where(F.col("rel") == rel).select("src", "dst"), h[source], h[target], 10 + k))
    return out


def of_types(parts: dict[str, list[DataFrame]], how: str, digits=rounded) -> DataFrame:
    every = [digits(L.across_relations(p, how), "node_id").select(F.lit(kind).alias("kind"), "node_id", "h") for kind, p in parts.items()]
    out = every[0]
    for e in every[1:]:
        out = out.unionByName(e)
    return out


def over_relations_sql(how: str, digits=rounded_sql) -> str:
    """From rv (rel, dk, dst, v) to a vector a target."""
    return f"select kind, node_id, {digits('h')} as h from (select dk as kind, dst as node_id, list(x order by j) as h from (select dk, dst, j, {how}(v[j + 1]) as x from rv cross join (select unnest(range({TYPE_OUT})) as j) group by 1, 2, 3) group by 1, 2)"


def relation_product_sql(x: str) -> str:
    salt = SALT_SQL
    return f"list_transform(range({TYPE_OUT}), lambda j: list_sum(list_transform(range({TYPE_DIM}), lambda i: {x}[i + 1] * ((((i + 1) * 31 + (j + 1) * 17 + ({salt}) * 7) % 23 - 11)::double / 184.0))) + (((j * 5 + ({salt})) % 7 - 3)::double / 7.0))"


RGCN = FEATURES_SQL + f""", ro as (select rel, src, count(*) as o from he group by 1, 2), ri as (select rel, dst, count(*) as n from he group by 1, 2),
rm as (select x.rel, x.dk, x.dst, x.dim, sum(x.x / sqrt(ro.o * ri.n)) as m from hex x join ro on ro.rel = x.rel and ro.src = x.src join ri on ri.rel = x.rel and ri.dst = x.dst group by 1, 2, 3, 4),
rx as (select rel, dk, dst, list(m order by dim) as x from rm group by 1, 2, 3), rv as (select rel, dk, dst, {relation_product_sql('x')} as v from rx)"""


@Q.query(over_relations_sql("avg"), RGCN)
def rgcn_layer(s, d):
    return of_types(by_relation(s, d, lambda e, h, t, salt: L.relation_gcn(e, h, weights(TYPE_DIM, TYPE_OUT, salt), bias(TYPE_OUT, salt))), "mean")


RSAGE = FEATURES_SQL + f""", rm as (select rel, dk, dst, dim, sum(x) as m, count(*) as n from hex group by 1, 2, 3, 4),
rx as (select r.rel, r.dk, r.dst, list((r.m + f.h[r.dim]) / (r.n + 1) order by r.dim) as x from rm r join hf f on f.kind = r.dk and f.node_id = r.dst group by 1, 2, 3), rv as (select rel, dk, dst, {relation_product_sql('x')} as v from rx)"""


@Q.query(over_relations_sql("sum", tie_safe_sql), RSAGE)
def rsage_layer(s, d):
    """Features are decimals, so that means times weights of 1/184 can lie right between two sixth decimals: both sides round 12 decimals, ties away from zero."""
    return of_types(by_relation(s, d, lambda e, h, t, salt: L.relation_sage(e, h, t, weights(TYPE_DIM, TYPE_OUT, salt), bias(TYPE_OUT, salt))), "sum", tie_safe)


RGAT_W = TYPE_OUT // HEADS


def rgat_sql() -> str:
    """One attention for each relation, summed over the relations of a target."""
    parts, union = [FEATURES_SQL], []
    for k, rel in enumerate(RELATIONS):
        source, target = Q.TYPES[rel]
        z = lambda kind: f"select node_id, {product_sql('h', TYPE_DIM, TYPE_OUT, 10 + k)} as z from hf where kind = '{kind}'"  # noqa: E731, B023
        body = attention_sql("ee", RGAT_W, "zt").replace("zl ", f"zl{k} ").replace("zr ", f"zr{k} ").replace("sc as", f"sc{k} as").replace("from sc)", f"from sc{k})").replace("ex as", f"ex{k} as").replace("from ex ", f"from ex{k} ").replace("hc as", f"hc{k} as").replace("from z)", f"from z{k})").replace("from zt)", f"from zt{k})").replace("ee e", f"ee{k} e")
        parts += [f"z{k} as materialized ({z(source)})", f"zt{k} as materialized ({z(target)})", f"ee{k} as (select src, dst from he where rel = '{rel}')", body, f"rv{k} as (select '{target}' as dk, dst, list(x order by k, c) as x from hc{k} group by 1, 2)"]
        union.append(f"select dk, dst, list_transform(range({TYPE_OUT}), lambda j: x[j + 1] + {b_sql(10 + k)}) as v from rv{k}")
    return ", ".join(parts) + ", rv as (" + " union all ".join(union) + ")"


@Q.query(over_relations_sql("sum"), rgat_sql())
def rgat_layer(s, d):
    def layer(e, h, t, salt):
        out = L.gat_layer(e, h, weights(TYPE_DIM, TYPE_OUT, salt), weights(HEADS, RGAT_W, 5), weights(HEADS, RGAT_W, 6), bias(TYPE_OUT, salt), target=t)
        return out.join(e.select(F.col("dst").alias("node_id")).distinct().hint("merge"), "node_id", "left_semi")  # a relation speaks of its own targets

    return of_types(by_relation(s, d, layer), "sum")


# Training: one SAGE layer as a classifier; loss by epoch and accuracy of the trained model on each split.
CLASSES = 10


def labeled_inputs(s, d) -> DataFrame:
    """node_id, x (the node's vector and the mean of its in-neighbours), label, split."""
    nodes = V.nodes(s, d)
    split = G.positional_split(nodes, nodes.count())
    return T.sage_inputs(V.pairs(s, d), vectors(s, d)).join(nodes.where("label is not null").select("node_id", "label"), "node_id").join(split, "node_id")


@Q.query()
def train_epochs(s, d):
    """epoch, loss: full-batch training over the train split; every epoch is one pass, gradients are summed by tasks."""
    rows = G.cut(labeled_inputs(s, d))
    _, losses = T.train(rows.where("split = 'train'"), 2 * DIM, CLASSES, epochs=5)
    return s.createDataFrame([(k + 1, round(x, 6)) for k, x in enumerate(losses)], "epoch int, loss double")


@Q.query()
def evaluate_model(s, d):
    """split, nodes, accuracy of the trained model."""
    rows = G.cut(labeled_inputs(s, d))
    model, _ = T.train(rows.where("split = 'train'"), 2 * DIM, CLASSES, epochs=5)
    scored = rows.select("split", "label", L.linear("x", *model).alias("z")).withColumn("predicted", F.array_position("z", F.array_max("z")) - 1)
    return scored.groupBy("split").agg(F.count(F.lit(1)).alias("nodes"), F.round(F.avg((F.col("predicted") == F.col("label")).cast("int")) * 100, 6).alias("accuracy"))
