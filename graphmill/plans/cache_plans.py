"""Cache queries: residency, periodic metadata for the distributor, backends, streamed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill import queries as Q
from graphmill.config import BACKENDS
from graphmill.operators import graph as G
from graphmill.sources import views as V
from graphmill.streaming.cache import run_to_table, stream_trace

WAYS, REFRESH = 4, 1024


def lifetimes(trace: DataFrame, ways: int = WAYS) -> DataFrame:
    """owner, cache_set, node_id, step, evicted: round robin evicts a line at the set's ``ways``-th next miss."""
    w = Window.partitionBy("owner", "cache_set").orderBy("step")
    return trace.where("not hit").select("owner", "cache_set", "node_id", "step", F.lead("step", ways).over(w).alias("evicted"))


@Q.query("select owner, cache_set, node_id from (select *, row_number() over (partition by owner, cache_set order by step desc) as r from g_fold where k > 0 and not hit) where r <= 4", Q.TRACE)
def cache_residents(s, d):
    return lifetimes(Q.cache_trace(s, d)).where("evicted is null").select("owner", "cache_set", "node_id")


MISS = Q.color_sql() + ", " + Q.TRACE + ", g_miss as (select owner, cache_set, node_id, step, row_number() over (partition by owner, cache_set order by step) as m from g_fold where k > 0 and not hit)"


def machine_color(rows: DataFrame, colors: DataFrame, *keys: str) -> DataFrame:
    """Resident lines by machine and color (0: none)."""
    known = rows.join(colors.select("node_id", "color"), "node_id", "left").fillna(0, ["color"])
    return known.groupBy(*keys, F.floor(F.col("owner") / Q.GPUS).alias("machine"), "color").agg(F.count(F.lit(1)).alias("resident"))


@Q.query("select x.owner // 2 as machine, coalesce(c.color, 0) as color, count(*) as resident from (select *, max(m) over (partition by owner, cache_set) as n from g_miss) x left join g_colors c using (node_id) where m > n - 4 group by 1, 2", MISS)
def cache_meta(s, d):
    return machine_color(cache_residents(s, d), Q.colored(s, d)[1])


@Q.query(
    "select t.refresh, m.owner // 2 as machine, coalesce(c.color, 0) as color, count(*) as resident from g_total t join g_miss m on m.owner = t.owner and m.cache_set = t.cache_set and m.m <= t.n and m.m > t.n - 4 left join g_colors c on c.node_id = m.node_id group by 1, 2, 3",
    MISS + ", g_win as (select distinct step // 1024 as refresh from g_access), g_total as (select w.refresh, m.owner, m.cache_set, count(*) as n from g_win w join g_miss m on m.step < (w.refresh + 1) * 1024 group by 1, 2, 3)",
)
def cache_meta_refresh(s, d):
    """What every refresh would publish: the lines resident after each ``REFRESH`` accesses."""
    last = V.accesses(s, d).agg(F.max(F.floor(F.col("step") / REFRESH)).alias("last"))
    lives = lifetimes(Q.cache_trace(s, d)).crossJoin(F.broadcast(last)).withColumn("a", F.floor(F.col("step") / REFRESH))
    b = F.coalesce(F.floor(F.col("evicted") / REFRESH) - 1, F.col("last"))
    seen = lives.withColumn("b", b).where("a <= b").withColumn("refresh", F.explode(F.sequence("a", "b")))
    return machine_color(seen, Q.colored(s, d)[1], "refresh")


def trace_sql(name: str, owner: str, cache_set: str) -> str:
    """The fold of one backend, written for its own owner and set."""
    return f"""{name}_seq as materialized (select step, {owner} as owner, {cache_set} as cache_set, node_id, row_number() over (partition by {owner}, {cache_set} order by step) as k from g_access),
{name} as (
  select owner, cache_set, 0::bigint as k, false as hit, []::bigint[] as lines from (select distinct owner, cache_set from {name}_seq)
  union all
  select q.owner, q.cache_set, q.k, list_contains(f.lines, q.node_id),
         case when list_contains(f.lines, q.node_id) then f.lines when len(f.lines) < 4 then list_append(f.lines, q.node_id) else list_append(f.lines[2:], q.node_id) end
  from {name} f join {name}_seq q on q.owner = f.owner and q.cache_set = f.cache_set and q.k = f.k + 1)"""


@Q.query(
    "select backend, sum(hit::int)::bigint as hits, sum(1 - hit::int)::bigint as misses from (select 'nvshmem' as backend, hit from d_fold where k > 0 union all select 'nccl', hit from d_fold where k > 0 union all select 'isolated', hit from i_fold where k > 0) group by 1",
    trace_sql("d_fold", "node_id % 4", "node_id // 4 % 4") + ", " + trace_sql("i_fold", "step % 4", "node_id % 4"),
)
def cache_backends(s, d):
    """Hits when ids are routed to their owner's cache (two transports, one cache), and when each requester asks its own."""
    rows = V.accesses(s, d).select("step", "node_id", "owner")
    every = None
    for backend in BACKENDS:
        asked = rows.withColumn("owner", F.col("step") % 4) if backend == "isolated" else rows
        trace = G.cache_trace(asked, 4, WAYS, 4, backend).select(F.lit(backend).alias("backend"), F.col("hit").cast("int").alias("hit"))
        every = trace if every is None else every.unionByName(trace)
    return every.groupBy("backend").agg(F.sum("hit").alias("hits"), F.sum(1 - F.col("hit")).alias("misses"))


@Q.query("select step, owner, cache_set, node_id, hit from g_fold where k > 0", Q.TRACE)
def cache_stream(s, d):
    events = s.readStream.schema(V.read(s, d, "events").schema).parquet(f"{d}/events*.parquet")
    rows = events.selectExpr("event_id as step", "user_id as node_id", "user_id % 4 as owner")
    return run_to_table(stream_trace(rows, 4, WAYS))


@Q.query(
    "select 'striped' as method, round(sum(s.score), 3) as score from g_scores s join g_batch b on b.pos = s.pos and b.machine = s.machine union all select 'affinity', round(sum(s.score), 3) from g_scores s join g_go g on g.pos = s.pos and g.machine = s.machine",
    Q.color_sql() + Q.CROSS + Q.GREEDY,
)
def distribution_compare(s, d):
    """The affinity that either distribution reaches, over the epoch."""
    scores = G.cut(Q.scored(s, d))
    ways = [("striped", Q.batches(s, d)), ("affinity", G.distribute(scores, Q.BATCH * Q.GPUS, Q.BATCH, Q.MACHINES))]
    sums = [w.select("pos", "machine").join(scores, ["pos", "machine"]).agg(F.lit(name).alias("method"), F.round(F.sum("score"), 3).alias("score")) for name, w in ways]
    return sums[0].unionByName(sums[1])
