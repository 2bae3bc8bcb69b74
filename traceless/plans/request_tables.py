"""Deletion requests of customers as typed path graphs with actions and channels."""

from __future__ import annotations

from traceless.plans import lineage_tables  # noqa: F401
from traceless.plans.catalog import projection

projection(
    "pnodes",
    """
    select subject_id as request_id, artifact_id as node_id, 'ARTIFACT' as kind, subject_id,
      case when parent_id is null then case when k % 4 = 0 then 'CLOSED' when k % 9 = 1 then 'UNKNOWN' else 'ACTIVE' end
           when artifact_id like 'o%' then case k % 5 when 0 then 'ACTIVE' when 1 then 'UNKNOWN' else 'CLOSED' end
           else case k % 17 when 0 then 'ACTIVE' when 1 then 'UNKNOWN' else 'CLOSED' end end as state,
      artifact_id like 'l%' and k % 17 = 0 as active_sink, k
    from {lineage_base}
    union all
    select 's' || cast(c_custkey as string), 'r' || cast(n_regionkey as string), 'SERVICE', '', 'ACTIVE', true, cast(n_regionkey as bigint)
    from {customer} join {nation} on n_nationkey = c_nationkey
    """,
    written=True,
)
projection(
    "pedges",
    """
    select subject_id as request_id, parent_id || '->' || artifact_id || ':MATERIAL:' || subject_id as edge_id,
      parent_id as source_id, artifact_id as target_id, 'MATERIAL' as kind,
      case when k % 37 = 5 then 'UNKNOWN' when k % 41 = 6 then 'CLOSED' else 'ACTIVE' end as state,
      k % 3 = 0 as request_scoped, subject_id
    from {lineage_base} where parent_id is not null
    union all
    select b.subject_id, b.artifact_id || '->r' || cast(n_regionkey as string) || ':PROCESSING:shared', b.artifact_id,
      'r' || cast(n_regionkey as string), 'PROCESSING', case when k % 43 = 5 then 'UNKNOWN' else 'ACTIVE' end, false, ''
    from {lineage_base} b join {customer} on 's' || cast(c_custkey as string) = b.subject_id
    join {nation} on n_nationkey = c_nationkey
    where b.artifact_id like 'l%' and b.k % 11 = 0
    """,
    written=True,
)
projection(
    "returned_share",
    """
    select 's' || cast(o_custkey as string) as request_id, count(*) as n, count(*) filter (where rf = 'R') as returned
    from {lines} join {orders} on l_orderkey = o_orderkey group by o_custkey
    """,
    written=True,
)
_Z = 1.959963984540054
projection(
    "channels",
    f"""
    select request_id, 'storage' as name, '' as stratum, cast(returned as double) / n as value,
      (cast(returned as double) / n + {_Z * _Z}e0 / (2 * n) + {_Z}e0 * sqrt(cast(returned as double) / n * (1 - cast(returned as double) / n) / n + {_Z * _Z}e0 / (4e0 * n * n))) / (1 + {_Z * _Z}e0 / n) as upper_bound,
      0.5e0 as threshold, n >= 5 as known, true as mandatory
    from {{returned_share}}
    union all
    select request_id, 'identity', 'face', 0.1e0, case when n % 4 = 0 then 0.9e0 else 0.2e0 end, 0.3e0, n % 5 <> 1, true from {{returned_share}}
    union all
    select request_id, 'drift', '', 0.4e0, 0.6e0, 0.5e0, true, false from {{returned_share}} where n % 2 = 0
    """,
)
projection(
    "decided_channels",
    """
    select request_id, name, stratum, mandatory,
      case when not known then 'UNKNOWN' when upper_bound <= threshold then 'PASS' else 'FAIL' end as decision
    from {channels}
    """,
    written=True,
)
projection(
    "requests",
    "select 's' || cast(c_custkey as string) as request_id, 's' || cast(c_custkey as string) as subject_id from {customer}",
)
projection(
    "request_nodes",
    """
    select 's' || cast(c_custkey as string) as request_id, 'c' || cast(c_custkey as string) as node_id, 'source' as role from {customer}
    union all
    select request_id, node_id, 'sink' from {pnodes} where node_id like 'l%' or node_id like 'r%'
    """,
)
projection(
    "request_channels",
    """
    select request_id, 'storage' as name from {requests} union all select request_id, 'identity' from {requests}
    """,
)
projection(
    "pactions",
    """
    select request_id, request_id || '/' || action as action_id, cast(cost as bigint) as cost, permitted
    from {requests} cross join (
      select 'a-close-root' as action, 4 as cost, true as permitted union all select 'b-purge-orders', 7, true
      union all select 'c-purge-lines', 5, true union all select 'd-cut-region', 3, true
      union all select 'e-retrain', 6, true union all select 'f-forbidden', 1, false) a
    """,
)
projection(
    "ptransitions",
    """
    select request_id, request_id || '/a-close-root' as action_id, 'NODE' as target, node_id as target_id, 'CLOSED' as result_state, true as verified
    from {pnodes} where node_id like 'c%'
    union all
    select request_id, request_id || '/b-purge-orders', 'NODE', node_id, 'CLOSED', k % 7 <> 2 from {pnodes} where node_id like 'o%' and state <> 'CLOSED'
    union all
    select request_id, request_id || '/c-purge-lines', 'NODE', node_id, case when k % 19 = 4 then 'UNKNOWN' else 'CLOSED' end, true
    from {pnodes} where node_id like 'l%' and state <> 'CLOSED'
    union all
    select request_id, request_id || '/d-cut-region', 'EDGE', edge_id, 'CLOSED', true from {pedges} where target_id like 'r%'
    union all
    select request_id, request_id || '/d-cut-region', 'NODE', node_id, 'CLOSED', true from {pnodes} where node_id like 'r%'
    union all
    select request_id, request_id || '/e-retrain', 'NODE', node_id, 'ACTIVE', true from {pnodes} where node_id like 'o%' and k % 50 = 3
    """,
    written=True,
)
projection(
    "paction_channels",
    """
    select request_id, request_id || '/e-retrain' as action_id, 'identity' as name, 'face' as stratum, true as mandatory, 'PASS' as decision from {requests}
    union all
    select request_id, request_id || '/c-purge-lines', 'storage', '', true, case when request_id like '%9' then 'FAIL' else 'PASS' end from {requests}
    union all
    select request_id, request_id || '/f-forbidden', 'storage', '', true, 'PASS' from {requests}
    """,
)
