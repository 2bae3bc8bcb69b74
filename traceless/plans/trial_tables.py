"""Orders and line items as method trials, measurements, losses and scores."""

from __future__ import annotations

from traceless.plans.catalog import projection

projection(
    "trials",
    """
    select l_orderkey as case_id, method, family, o_orderkey % 5 as seed,
      count(*) filter (where rf = 'R') > 0 as truth_positive,
      count(*) filter (where rf = 'R' and found) = 0 as declared_complete,
      cast(o_totalprice as double) / 1000 as runtime_ms,
      cast(count(*) filter (where found) as bigint) as cost,
      array_agg(l_linenumber) filter (where rf = 'R') as truth_ids,
      array_agg(l_linenumber) filter (where found and (rf = 'R' or pk % 3 = 0)) as detected_ids,
      case when o_orderkey % 997 = 3 then 'timeout' else '' end as exception
    from (
      select l.*, o.*, m.method, r_name as family,
        case m.method when 'graph' then pk % 29 <> 0 when 'checklist' then pk % 2 = 0 else pk % 7 = 0 and l_linenumber < 3 end as found
      from {lines} l join {orders} o on l_orderkey = o_orderkey
      join {customer} on c_custkey = o_custkey join {nation} on n_nationkey = c_nationkey
      join {region} on r_regionkey = n_regionkey
      cross join (select 'graph' as method union all select 'checklist' union all select 'receipt') m) x
    group by l_orderkey, method, family, o_orderkey, o_totalprice
    """,
    written=True,
)
projection(
    "verdict_trials",
    """
    select case_id, method, family, case when case_id % 4 = 0 then 'plan' else 'audit' end as task,
      case when truth_positive then case when case_id % 9 = 1 then 'UNVERIFIED' else 'INCOMPLETE' end else 'COMPLETE' end as truth_verdict,
      case when exception <> '' then 'UNVERIFIED' when declared_complete then 'COMPLETE'
           when case_id % 11 = 1 then 'UNVERIFIED' else 'INCOMPLETE' end as verdict, cost, exception
    from {trials}
    """,
)
projection(
    "measurements",
    """
    select p_partkey as seed, strategy,
      case strategy when 'targeted' then cast(0.01 + p_size / 500.0 as double) else 0.2 + p_retailprice / 1000 end as seconds,
      cast(case strategy when 'targeted' then 100 * p_size else 1000 * p_size + 40000 end as bigint) as bytes_rewritten,
      case when p_partkey % 1499 = 7 then 'UNVERIFIED' else 'COMPLETE' end as verdict,
      cast(249 - case when p_partkey % 1201 = 5 then 1 else 0 end as bigint) as retained_count,
      cast(249 as bigint) as expected_retained_count,
      cast(case strategy when 'targeted' then p_size / 1000.0 else 0.0 end as double) as model_weight_delta
    from {part} cross join (select 'targeted' as strategy union all select 'rebuild') s
    """,
)
projection(
    "attack_trials",
    """
    select o_orderkey as seed, o_custkey as subject, method,
      cast(o_totalprice as double) / 1.0e6 + bump * (o_orderkey % 7) / 100.0 as lira,
      cast(o_totalprice as double) / 2.0e6 + bump * (o_orderkey % 11) / 200.0 as energy,
      cast(o_orderkey % 97 as double) / 100 - bump * (o_custkey % 5) / 100.0 as margin,
      cast(o_custkey % 89 as double) / 100 + bump * (o_orderkey % 3) / 50.0 as nearest
    from {orders} cross join (select 'exact' as method, 0 as bump union all select 'selective', 1 union all select 'stale', 4) m
    """,
)
projection(
    "model_losses",
    """
    select l_suppkey % 8 as trial, model, channel, l_orderkey * 8 + l_linenumber as row_id,
      cast(0.5 + (l_orderkey * 31 + l_linenumber * 17) % 101 / 100.0
        + case when channel in ('forget', 'forget_perturbed') then effect * (2 + l_suppkey % 3) / 2.0 else effect * 0.01 end as double) as nll
    from (
      select l_orderkey, l_linenumber, sk as l_suppkey,
        case l_linenumber % 6 when 0 then 'forget' when 1 then 'forget_perturbed' when 2 then 'holdout'
          when 3 then 'retain' when 4 then 'retain_perturbed' else 'world_facts' end as channel
      from {lines}) l
    cross join (select 'base' as model, 1.5 as effect union all select 'target', 0.0 union all select 'exact', 1.2
      union all select 'candidate', 1.1 union all select 'candidate_reloaded', 1.1) m
    """,
)
projection(
    "membership_scores",
    """
    select o_orderkey as sample_id, o_orderpriority as grp, o_orderstatus = 'F' as is_member,
      floor(cast(o_totalprice as double) / 5000) + case when o_orderstatus = 'F' then o_orderkey % 5 else 0 end as score
    from {orders}
    """,
)
projection(
    "path_points",
    """
    select 'p' || cast(c_custkey % 50 as string) || '-' || cast(c_nationkey as string) as path_id,
      c_custkey as alpha, c_custkey % 7 <> 3 and c_acctbal > -500 as feasible,
      cast(c_acctbal as double) / 1000 as minimum_margin, 1.0 + c_custkey % 13 as minimum_speedup,
      cast(c_custkey % 17 as double) / 10 as worst_exact_gap
    from {customer}
    """,
)
