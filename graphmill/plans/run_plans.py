"""Runs driven by settings over a graph that a session prepares once for each folder of tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from graphmill import queries as Q
from graphmill.config import Settings
from graphmill.operators import graph as G
from graphmill.operators import runs as R
from graphmill.plans import layer_plans as P
from graphmill.plans.source_plans import new_folder
from graphmill.sources import views as V

#: Eight ranks of 16 nodes; the fan-outs differ by layer.
SETTINGS = {"fan_out": "4,3", "num_layers": 2, "batch_size": 16, "gpus": 2, "machines": 4, "hidden_channels": 16, "num_heads": 2, "epochs": 2, "top": 6}
NODE_COLOR, BASELINE = (Settings(distribution=name, **SETTINGS) for name in ("node_color", "baseline"))
CLASSES = 10
_prepared: dict[tuple[str, str], R.Prepared] = {}


def still_there(made: R.Prepared) -> bool:
    try:
        made.labels()
    except AnalysisException:  # the folder was cleared
        return False
    return True


def graph(s, d) -> R.Prepared:
    """The prepared graph of a folder; a session writes it when it is first asked for, and later queries read it while its folder stands."""
    key = (s.sparkContext.applicationId, d)
    if key not in _prepared or not still_there(_prepared[key]):
        nodes = G.cut(V.nodes(s, d).select("node_id", "label"))
        split = G.positional_split(nodes, nodes.count()).join(nodes, "node_id")
        _prepared[key] = R.prepare(split, V.edges(s, d), new_folder(s, "prepared"))
    return _prepared[key]


def every(x: str) -> str:
    return f"list_transform(range({NODE_COLOR.machines}), lambda i: {x})"


def batches_sql(s: Settings) -> str:
    """Striped batches, scores by machine, and the greedy choice row after row within a global batch."""
    open_scores = every(f"case when g.fill[i + 1] < {s.domain_batch} then w.s[i + 1] else -1 end")
    best = f"list_position({open_scores}, list_max({open_scores}))"
    return f"""r_order as (select row_number() over (order by md5('42|perm|' || node_id), node_id) - 1 as pos, node_id from g_train join g_nodes using (node_id) where label is not null),
r_batch as materialized (select pos // {s.global_batch} as step, pos, node_id, pos % {s.global_batch} // {s.domain_batch} as machine, pos % {s.domain_batch} // {s.batch_size} as gpu
  from r_order where pos // {s.global_batch} < (select count(*) // {s.global_batch} - 1 from r_order)),
r_res as (select color, color % {s.machines} as machine, count(*) as resident from g_colors group by 1),
r_per as (select a.color, r.machine, sum(r.resident * a.affinity) as score from g_aff a join r_res r on r.color = a.neigh_color where a.rank <= {s.top} group by 1, 2),
r_wide as materialized (select step, pos, node_id, list(score order by machine) as s from (
  select b.step, b.pos, b.node_id, m.machine, round(coalesce(p.score, 0.0), 6) as score from r_batch b cross join (select unnest(range({s.machines})) as machine) m
  left join g_colors c on c.node_id = b.node_id left join r_per p on p.color = c.color and p.machine = m.machine) group by 1, 2, 3),
r_go as (
  select step, -1::bigint as seen, null::bigint as pos, null::bigint as node_id, null::bigint as machine, null::bigint as slot, {every('0::bigint')} as fill from (select distinct step from r_wide)
  union all
  select step, seen, pos, node_id, m - 1, fill[m], {every('fill[i + 1] + (i + 1 = m)::bigint')} from (
    select w.step, g.seen + 1 as seen, w.pos, w.node_id, g.fill, {best} as m from r_go g join r_wide w on w.step = g.step and w.pos = g.step * {s.global_batch} + g.seen + 1)),
r_dealt as materialized (select step, pos, node_id, machine, slot // {s.batch_size} as gpu, (step * {s.machines} + machine) * {s.gpus} + slot // {s.batch_size} as batch from r_go where seen >= 0)"""


DEALT = Q.color_sql() + Q.CROSS + ", " + batches_sql(NODE_COLOR)


@Q.query(
    f"select 'node_color' as distribution, step, pos, node_id, machine, gpu, batch from r_dealt union all select 'baseline', step, pos, node_id, machine, gpu, (step * {BASELINE.machines} + machine) * {BASELINE.gpus} + gpu from r_batch",
    DEALT,
)
def run_batches(s, d):
    """The batches of an epoch by both distributions, from the prepared graph."""
    named = [R.batches(graph(s, d), x).withColumn("distribution", F.lit(x.distribution)) for x in (NODE_COLOR, BASELINE)]
    return named[0].unionByName(named[1])


def layer_sql(k: int, frontier: str) -> str:
    return f"""r_b{k} as materialized (select batch, src, dst from (select f.batch, e.src, e.dst, row_number() over (partition by f.batch, e.dst order by md5('42|layer{k}|' || f.batch || '|' || e.edge_id), e.edge_id) as r
  from {frontier} f join g_norm e on e.dst = f.node_id) where r <= {NODE_COLOR.fanouts[k]})"""


SAMPLED = f"{DEALT}, r_seed as (select distinct batch, node_id from r_dealt), {layer_sql(1, 'r_seed')}, r_f as (select batch, node_id from r_seed union select batch, src from r_b1), {layer_sql(0, 'r_f')}"


@Q.query("select 1 as layer, batch, src, dst from r_b1 union all select 0, batch, src, dst from r_b0", SAMPLED)
def run_blocks(s, d):
    """Blocks of an epoch, sampled from the blocks of the written graph that hold the frontiers."""
    made = R.blocks(graph(s, d), NODE_COLOR)
    layers = [e.select(F.lit(k).alias("layer"), "batch", "src", "dst") for k, e in enumerate(made.edges)]
    return layers[1].unionByName(layers[0])


@Q.query()
def run_training(s, d):
    """epoch, step, loss, sampled_nodes, sampled_edges (of the epoch), tested, accuracy (of the run): one run of the settings."""
    said = R.run(graph(s, d), P.vectors(s, d), P.DIM, CLASSES, NODE_COLOR)
    rows = [(e, k, round(float(x), 6), said.sampled[e - 1]["nodes"][0], sum(said.sampled[e - 1]["edges"]), said.tested, said.accuracy) for e, k, x in said.losses]
    return s.createDataFrame(rows, "epoch int, step long, loss double, sampled_nodes long, sampled_edges long, tested long, accuracy double")
