"""Readers, sinks, splits by list, parameters, and streamed mini-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill import config
from graphmill import queries as Q
from graphmill.functions.ordering import checkpoint_folder, order_key
from graphmill.operators import graph as G
from graphmill.sources import files
from graphmill.sources import views as V
from graphmill.streaming.cache import run_to_table, stream_trace


def new_folder(s, name: str) -> str:
    return f"{checkpoint_folder(s)}/{name}-{uuid.uuid4().hex}"


def pairs(s, d) -> DataFrame:
    return V.edges(s, d).select(F.col("edge_id").alias("row"), F.array("src", "dst").alias("values"))


@Q.query("select edge_id, src, dst from g_edges")
def coo_rows_file(s, d):
    """Edges through an [E, 2] ``.npy`` file and back."""
    folder = new_folder(s, "coo")
    files.write_npy(pairs(s, d), folder, "int64")
    return files.edges_of(files.read_npy(s, folder))


@Q.query("select edge_id, src, dst from g_edges")
def coo_columns_file(s, d):
    """Edges through a [2, E] ``.npy`` file and back."""
    folder = new_folder(s, "coo")
    files.write_npy(pairs(s, d), folder, "int64", across=True)
    return files.edges_of(files.read_npy(s, folder, across=True))


@Q.query("select node_id, embedding::double[] as embedding from g_features")
def feature_file(s, d):
    """Features through a float32 ``.npy`` file and back."""
    folder = new_folder(s, "features")
    files.write_npy(V.features(s, d).select(F.col("node_id").alias("row"), F.col("embedding").alias("values")), folder, "float32")
    return files.read_npy(s, folder).select(F.col("row").alias("node_id"), F.col("values").alias("embedding"))


@Q.query("select row_number() over (order by dst, edge_id) - 1 as at, dst, src, edge_id from g_edges")
def csc_tables(s, d):
    """The CSC graph written as tables, and its edges read back."""
    folder, edges = new_folder(s, "csc"), V.edges(s, d)
    files.write_csc(G.adjacency(edges), G.indptr(edges, V.nodes(s, d)), folder)
    _, indices = files.read_csc(s, folder)
    return indices.select("at", "dst", "src", "edge_id")


@Q.query("select dst, row_number() over (partition by dst order by edge_id) - 1 as pos, src, edge_id from g_edges where dst in (select node_id from g_batch where step = 0)", Q.ORDER)
def csc_in_edges(s, d):
    """In-edges of the first global batch from the written graph: its blocks alone are read, places follow from ``indptr``."""
    folder, edges = new_folder(s, "csc"), V.edges(s, d)
    files.write_csc(G.adjacency(edges), G.indptr(edges, V.nodes(s, d)), folder)
    return files.in_edges(s, folder, Q.batches(s, d).where("step = 0")).select("dst", "pos", "src", "edge_id")


@Q.query("select color, list(neigh_color order by rank) || list_transform(range(10 - count(*)), lambda x: 0::bigint) as neighbors, list(affinity order by rank) || list_transform(range(10 - count(*)), lambda x: 0.0::double) as scores from g_aff group by 1", Q.color_sql() + Q.CROSS)
def color_neighbor_tables(s, d):
    """Neighbours and scores written as tables and read back."""
    folder = new_folder(s, "colors")
    edges, colors = Q.colored(s, d)
    files.write_colors(colors, V.nodes(s, d), G.neighbor_matrix(G.affinity(edges, colors)), folder)
    _, neighbors, scores = files.read_colors(s, folder)
    return neighbors.join(scores, "color")


@Q.query("select n.node_id, coalesce(c.color, 0) as color from g_nodes n left join g_colors c using (node_id)", Q.color_sql())
def color_tables(s, d):
    """Colors, neighbours and scores written as tables; the colors read back, 0 for none."""
    folder = new_folder(s, "colors")
    edges, colors = Q.colored(s, d)
    colors = G.cut(colors)
    files.write_colors(colors, V.nodes(s, d), G.neighbor_matrix(G.affinity(edges, colors)), folder)
    return files.read_colors(s, folder)[0]


@Q.query("select node_id from g_nodes where node_id % 3 = 0")
def text_node_ids(s, d):
    folder = new_folder(s, "ids")
    V.nodes(s, d).where("node_id % 3 = 0").select(F.concat_ws(" ", F.lit(" "), F.col("node_id").cast("string"), F.col("node_id").cast("string")).alias("value")).write.text(folder)
    return files.read_node_ids(s, folder)


@Q.query("select node_id, list_transform(range(64), lambda i: ('0x' || substr(md5('42|feature|' || node_id || '|' || i), 1, 8))::bigint::double / 4294967296.0::double) as embedding from g_nodes")
def synthetic_features(s, d):
    """64 components between 0 and 1 from a hash of node and place."""
    draw = lambda i: F.conv(F.substring(order_key(G.SEED, "feature", F.col("node_id"), i), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return V.nodes(s, d).select("node_id", F.transform(F.sequence(F.lit(0), F.lit(63)), draw).alias("embedding"))


@Q.query("select node_id, case when node_id % 10 < 6 then 'train' when node_id % 10 < 8 then 'val' when node_id % 10 = 8 then 'test' end as split from g_nodes")
def index_split(s, d):
    """A split given by lists of ids; nodes of no list have none."""
    n = V.nodes(s, d).select("node_id")
    return G.index_split(n, {"train": n.where("node_id % 10 < 6"), "val": n.where("node_id % 10 in (6, 7)"), "test": n.where("node_id % 10 = 8")})


@Q.query("select 'customer' as kind, count(*) as nodes from customer union all select 'part', count(*) from part union all select 'supplier', count(*) from supplier union all select 'nation', count(*) from nation")
def hetero_node_counts(s, d):
    every = None
    for kind in Q.KINDS:
        n = V.read(s, d, kind).agg(F.count(F.lit(1)).alias("nodes")).select(F.lit(kind).alias("kind"), "nodes")
        every = n if every is None else every.unionByName(n)
    return every


@Q.query("select node_id, color, hop from g_colors", Q.color_sql(plain=True))
def color_graph_plain(s, d):
    """Seeds drawn from all nodes, no claims of training nodes at the start."""
    nodes = V.nodes(s, d).select("node_id")
    edges = G.cut(G.normalize_loops(V.edges(s, d), nodes))
    return G.color_graph(edges, G.cut(G.seeds(nodes, nodes, config.SEED_RATE)), None)


@Q.query(
    "select batch, layer, src, dst, edge_id from (select f.batch, 0 as layer, e.src, e.dst, e.edge_id, row_number() over (partition by f.batch, e.dst order by md5('42|layer0|' || f.batch || '|' || e.edge_id), e.edge_id) as r from g_seedset f join g_edges e on e.dst = f.node_id) where r <= 3",
    Q.ORDER + ", g_seedset as (select distinct step * 4 + machine * 2 + gpu as batch, node_id from g_batch)",
)
def sample_one_layer(s, d):
    return G.sample_blocks(Q.batch_nodes(s, d), V.edges(s, d), [3])


@Q.query("select f as fan_out, b as batch, m as most from (values ('5,5', 1024, 36864), ('10,5,5', 1024, 405504), ('2', 8, 24)) t(f, b, m)")
def sampled_bound(s, d):
    rows = [(f, b, config.sampled_bound(b, config.parse_fanout(f))) for f, b in (("5,5", 1024), ("10,5,5", 1024), ("2", 8))]
    return s.createDataFrame(rows, "fan_out string, batch int, most int")


@Q.query("select d as dim, m as cache_mb, c as cache_dim, c * 4 as page_bytes, m * 1048576::bigint // (c * 4) as lines, m * 1048576::bigint // (c * 4) // 32 as sets from (values (64, 512, 128), (128, 4096, 128), (129, 4096, 256), (1024, 16384, 1024)) t(d, m, c)")
def cache_pages(s, d):
    rows = [config.Geometry(m, n) for n, m in ((64, 512), (128, 4096), (129, 4096), (1024, 16384))]
    return s.createDataFrame([(g.dim, g.cache_mb, config.cache_dim(g.dim), g.page_bytes, g.lines, g.sets) for g in rows], "dim int, cache_mb int, cache_dim int, page_bytes int, lines long, sets long")


@Q.query("select e.epoch, b.step, b.machine, b.gpu, count(*) as seeds from g_batch b cross join (select unnest([0, 1]) as epoch) e group by 1, 2, 3, 4", Q.ORDER)
def epoch_counters(s, d):
    """Seeds of every batch by epoch: an epoch begins anew, at step 0."""
    rows = Q.batches(s, d).withColumn("epoch", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.groupBy("epoch", "step", "machine", "gpu").agg(F.count(F.lit(1)).alias("seeds"))


@Q.query("select f.node_id, f.missing from (select node_id, label is null as missing from g_nodes) f")
def unlabeled_nodes(s, d):
    """Labels as floats, NaN for none: both NaN and null count as unlabeled."""
    value = F.when(F.col("label").isNull() & (F.col("node_id") % 2 == 0), F.lit(float("nan"))).otherwise(F.col("label").cast("double"))
    return V.nodes(s, d).select("node_id", value.alias("label")).select("node_id", (~G.labeled("label")).alias("missing"))


@Q.query("select time_bucket(interval 6 hours, ts::timestamp, timestamp '1970-01-01') as start, owner, sum(hit::int)::bigint as hits, count(*) as accesses from g_fold f join (select step as s, ts from g_access) a on a.s = f.step where k > 0 group by 1, 2", Q.TRACE)
def stream_hit_rate_window(s, d):
    """Hits of the streamed cache in windows of six hours of event time."""
    events = s.readStream.schema(V.read(s, d, "events").schema).parquet(f"{d}/events*.parquet")
    trace = run_to_table(stream_trace(events.selectExpr("event_id as step", "user_id as node_id", "user_id % 4 as owner"), 4, 4))
    timed = trace.join(V.read(s, d, "events").select(F.col("event_id").alias("step"), "ts"), "step")
    return timed.groupBy(F.window("ts", "6 hours")["start"].alias("start"), "owner").agg(F.sum(F.col("hit").cast("int")).alias("hits"), F.count(F.lit(1)).alias("accesses"))


@Q.query("select step, pos, node_id, machine, gpu from g_batch", Q.ORDER)
def minibatch_stream(s, d):
    """The epoch's mini-batches as a stream over a table of them, a file a micro-batch."""
    folder, rows = new_folder(s, "batches"), Q.batches(s, d)
    rows.repartitionByRange(4, "step").write.parquet(folder)
    return run_to_table(s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder))
