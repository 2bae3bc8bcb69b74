"""Users as discovery cases over candidate recovery graphs that follow from `nation` and `region`."""

from __future__ import annotations

from traceless.plans.catalog import projection

#: Candidate graphs, by number; the last one has no edge.
GRAPHS = ("h0", "h1", "h2", "h3", "h4", "h5")
BUCKETS = 3

# A nation is a hop from its own region to another; the first region is where copies start
# and the last one is where none may arrive.  Nations share operations by number.
projection(
    "hyp_hops",
    """
    select n_nationkey as k, lower(n_name) as edge_id, lower(a.r_name) as source_id, lower(b.r_name) as target_id,
      'o' || cast(n_nationkey % 7 as string) as operation_id
    from {nation} join {region} a on n_regionkey = a.r_regionkey
    join {region} b on b.r_regionkey = (n_regionkey + 1 + n_nationkey % 3) % 5
    """,
)
projection(
    "hyp_edges",
    """
    select 'h' || cast(g.g as string) as graph_id, edge_id, source_id, target_id, operation_id
    from {hyp_hops} join (select distinct n_nationkey % 6 as g from {nation}) g on g.g < 5 and k % 5 in (g.g, (g.g + 2) % 5)
    """,
)
projection(
    "hyp_nodes",
    """
    select 'h' || cast(g.g as string) as graph_id, lower(r_name) as node_id, r_regionkey = 0 as is_initial, r_regionkey = 4 as is_residual
    from {region} cross join (select distinct n_nationkey % 6 as g from {nation}) g
    """,
)
# Probe p runs every p-th operation and costs as much as it runs.
projection("probe_ops", "select distinct 'p' || cast(a.n_nationkey + 1 as string) as probe_id, 'o' || cast(b.n_nationkey as string) as operation_id from {nation} a cross join {nation} b where a.n_nationkey < 7 and b.n_nationkey < 7 and b.n_nationkey % (a.n_nationkey + 1) = 0")
projection("probes", f"select probe_id, {BUCKETS} as time_buckets, cast(count(*) as int) as declared_cost from {{probe_ops}} group by probe_id")
projection("probe_checkpoints", "select probe_id, lower(r_name) as node_id from {probes} cross join {region} where r_regionkey > 0")

projection(
    "probe_steps",
    "select e.graph_id, o.probe_id, e.source_id, e.target_id from {hyp_edges} e join {probe_ops} o on o.operation_id = e.operation_id",
)
projection(
    "arrivals",
    """
    select graph_id, probe_id, node_id, min(bucket) as bucket from (
      select graph_id, probe_id, target_id as node_id, 1 as bucket from {probe_steps} where source_id in (select lower(r_name) from {region} where r_regionkey = 0)
      union all
      select b.graph_id, b.probe_id, b.target_id, 2 from {probe_steps} a join {probe_steps} b
        on a.graph_id = b.graph_id and a.probe_id = b.probe_id and a.target_id = b.source_id where a.source_id in (select lower(r_name) from {region} where r_regionkey = 0)
      union all
      select c.graph_id, c.probe_id, c.target_id, 3 from {probe_steps} a join {probe_steps} b
        on a.graph_id = b.graph_id and a.probe_id = b.probe_id and a.target_id = b.source_id join {probe_steps} c
        on c.graph_id = b.graph_id and c.probe_id = b.probe_id and b.target_id = c.source_id where a.source_id in (select lower(r_name) from {region} where r_regionkey = 0)) x
    group by graph_id, probe_id, node_id
    """,
)
projection(
    "trace_table",
    """
    select g.graph_id, c.probe_id, t.bucket, c.node_id, coalesce(a.bucket <= t.bucket, false) as bit
    from (select distinct graph_id from {hyp_nodes}) g cross join {probe_checkpoints} c
    cross join (select 1 as bucket union all select 2 union all select 3) t
    left join {arrivals} a on a.graph_id = g.graph_id and a.probe_id = c.probe_id and a.node_id = c.node_id
    """,
    written=True,
)
projection(
    "discovery_cases",
    """
    select 'u' || cast(user_id as string) as case_id, user_id as k,
      'h' || cast(user_id % 6 as string) as truth_graph,
      user_id % 50 <> 0 as truth_known, user_id % 40 <> 1 as evidence_ok, case when user_id % 30 = 7 then 1 else 0 end as budget
    from (select distinct user_id from {events}) u
    """,
    written=True,
)
projection(
    "truth_traces",
    """
    select c.case_id, t.probe_id, t.bucket, t.node_id,
      case when not c.truth_known and t.bucket = 2 and t.node_id = 'asia' then not t.bit
           when c.k % 30 = 7 and t.bucket = 3 and t.node_id = 'europe' then not t.bit else t.bit end as bit
    from {discovery_cases} c join {trace_table} t on t.graph_id = c.truth_graph
    """,
    written=True,
)
projection(
    "executed_probes",
    """
    select distinct 'u' || cast(user_id as string) as case_id,
      'p' || cast(event_id % 7 + 1 as string) as probe_id
    from {events} where event_type = 'error' and value < 30
    """,
    written=True,
)
projection(
    "traces",
    "select t.case_id, t.probe_id, t.bucket, t.node_id, t.bit from {truth_traces} t join {executed_probes} e on e.case_id = t.case_id and e.probe_id = t.probe_id",
)
