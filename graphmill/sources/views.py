"""Graph views over the star-schema tables, and their SQL twins for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.functions.ordering import in_order


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_id, src, dst: consecutive parts of an order. They are written once, so that readers needn't cut them."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"), "l_suppkey", F.lead("l_partkey").over(w).alias("dst")).where("dst is not null")
    return in_order(rows, "edge_id", "l_orderkey", "l_linenumber", "src", "l_suppkey", "dst", keep=["src", "dst"])


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst of every edge, for what needs neither numbers nor an order of edges: nothing is sorted over all edges."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("dst is not null")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, vec_id, label (every fifth node has none)."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    total = vectors.count()
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id")).withColumn("vec_id", F.col("node_id") % total)
    return part.join(vectors, "vec_id").select("node_id", "vec_id", F.when(F.col("node_id") % 5 != 4, F.col("label")).alias("label"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).join(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id").select("node_id", "embedding")


def hetero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rel, src, dst over customers, parts, suppliers and nations."""
    line, order = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    parts = [
        order.join(line, F.col("l_orderkey") == F.col("o_orderkey")).select(F.lit("orders").alias("rel"), F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst")),
        line.select(F.lit("supplied_by").alias("rel"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")),
        read(spark, sf_dir, "customer").select(F.lit("customer_in").alias("rel"), F.col("c_custkey").alias("src"), F.col("c_nationkey").cast("long").alias("dst")),
        read(spark, sf_dir, "supplier").select(F.lit("supplier_in").alias("rel"), F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("long").alias("dst")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """step, node_id, owner: one access an event."""
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.col("user_id").alias("node_id"), (F.col("user_id") % 4).alias("owner"), "ts")


SQL = """
g_line as (
  select l_orderkey, l_linenumber, l_partkey as src, l_suppkey,
         lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as dst from lineitem),
g_edges as (
  select row_number() over (order by l_orderkey, l_linenumber, src, l_suppkey, dst) - 1 as edge_id, src, dst from g_line where dst is not null),
g_nodes as (
  select p.p_partkey as node_id, e.vec_id, case when p.p_partkey % 5 = 4 then null else e.label end as label
  from (select p_partkey, p_partkey % (select count(*) from embeddings) as k from part) p join embeddings e on e.vec_id = p.k),
g_features as (select n.node_id, e.embedding from g_nodes n join embeddings e using (vec_id)),
g_hetero as (
  select 'orders' as rel, o.o_custkey as src, l.l_partkey as dst from orders o join lineitem l on l.l_orderkey = o.o_orderkey
  union all select 'supplied_by', l_partkey, l_suppkey from lineitem
  union all select 'customer_in', c_custkey, c_nationkey::bigint from customer
  union all select 'supplier_in', s_suppkey, s_nationkey::bigint from supplier),
g_access as (select event_id as step, user_id as node_id, user_id % 4 as owner, ts from events)
"""
