"""Message passing over several relations: by relation first, then across relations of a target type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill import queries as Q
from graphmill.operators import graph as G
from graphmill.sources import views as V

#: The feature of a node of any type, from its id.
SQL = "g_h as materialized (select rel, src, dst, (src % 97)::double / 97 as x, (dst % 97)::double / 97 as y, case rel when 'orders' then 'part' when 'supplied_by' then 'supplier' else 'nation' end as kind from g_hetero)"


def messages(s, d) -> DataFrame:
    """rel, src, dst, x (source feature), y (target feature), kind (target type)."""
    kind = F.create_map(*[F.lit(v) for rel, (_, dst) in Q.TYPES.items() for v in (rel, dst)])[F.col("rel")]
    feature = lambda c: (F.col(c) % 97).cast("double") / 97
    return V.hetero(s, d).select("rel", "src", "dst", feature("src").alias("x"), feature("dst").alias("y"), kind.alias("kind"))


def across(by_rel: DataFrame, how, name: str) -> DataFrame:
    return by_rel.groupBy("kind", F.col("dst").alias("node_id")).agg(F.round(how("v"), 6).alias(name))


@Q.query("select kind, dst as node_id, round(avg(v), 6) as mean from (select h.rel, h.kind, h.dst, sum(h.x / sqrt(o.n * i.n)) as v from g_h h join (select rel, src, count(*) as n from g_h group by 1, 2) o on o.rel = h.rel and o.src = h.src join (select rel, dst, count(*) as n from g_h group by 1, 2) i on i.rel = h.rel and i.dst = h.dst group by 1, 2, 3) group by 1, 2", SQL)
def rgcn_mean(s, d):
    """Degree-normalised sums by relation, averaged."""
    m = G.cut(messages(s, d))
    out = m.groupBy("rel", "src").agg(F.count(F.lit(1)).alias("o"))
    # the in-degree is constant within a group, so it is taken from the group itself
    sums = m.join(out, ["rel", "src"]).groupBy("rel", "kind", "dst").agg((F.sum(F.col("x") / F.sqrt("o")) / F.sqrt(F.count(F.lit(1)))).alias("v"))
    return across(sums, F.avg, "mean")


@Q.query("select kind, dst as node_id, round(sum(v), 6) as total from (select rel, kind, dst, (max(y) + sum(x)) / (count(*) + 1) as v from g_h group by 1, 2, 3) group by 1, 2", SQL)
def rsage_sum(s, d):
    """Means that count the node itself, by relation, summed."""
    return across(messages(s, d).groupBy("rel", "kind", "dst").agg(((F.max("y") + F.sum("x")) / (F.count(F.lit(1)) + 1)).alias("v")), F.sum, "total")


@Q.query("select kind, dst as node_id, round(sum(v), 6) as total from (select rel, kind, dst, sum(exp(z) * x) / sum(exp(z)) as v from (select *, case when x - y > 0 then x - y else 0.2 * (x - y) end as z from g_h) group by 1, 2, 3) group by 1, 2", SQL)
def rgat_sum(s, d):
    """Attention-weighted sums by relation, summed; the softmax needs only two sums a target, no window."""
    gap = F.col("x") - F.col("y")
    e = F.exp(F.when(gap > 0, gap).otherwise(0.2 * gap))
    return across(messages(s, d).groupBy("rel", "kind", "dst").agg((F.sum(e * F.col("x")) / F.sum(e)).alias("v")), F.sum, "total")


@Q.query("select color, list(neigh_color order by rank) || list_transform(range(10 - count(*)), lambda x: 0::bigint) as neighbors, list(affinity order by rank) || list_transform(range(10 - count(*)), lambda x: 0.0::double) as scores from g_aff group by 1", Q.color_sql() + Q.CROSS)
def affinity_matrix(s, d):
    return G.neighbor_matrix(Q.color_affinity(s, d))


@Q.query("select count(*) as nodes, max(color) as colors from g_colors", Q.color_sql())
def color_counts(s, d):
    return Q.colored(s, d)[1].agg(F.count(F.lit(1)).alias("nodes"), F.max("color").alias("colors"))


@Q.query("select b.step, b.pos, b.node_id, n.label from g_batch b join g_nodes n using (node_id)", Q.ORDER)
def batch_labels(s, d):
    return Q.batches(s, d).select("step", "pos", "node_id").join(V.nodes(s, d).select("node_id", "label"), "node_id").select("step", "pos", "node_id", "label")
