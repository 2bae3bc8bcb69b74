"""Suppliers as recovery workflows: facts, transitions, sensors, controls, scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceless.plans.catalog import projection, table

# Shipping routes: crates that lie about go to one of two docks, by a hub or past it to the store.
# The first eight nations name the routes; keys and remainders give their ends.
projection(
    "workflow_steps",
    """
    select n_nationkey as n, 'ship-' || lower(n_name) as transition_id,
      case when n_nationkey < 4 then 'crate-' || cast(n_nationkey as string) when n_nationkey = 4 then 'dock-0' when n_nationkey = 6 then 'hub' else 'dock-1' end as req,
      case when n_nationkey < 4 then 'dock-' || cast(n_nationkey % 2 as string) when n_nationkey < 6 then 'hub' else 'store' end as adds,
      case when n_nationkey < 4 then 'gate-' || cast(n_nationkey % 3 as string) else 'line' end as sensor_id,
      case when n_nationkey between 1 and 3 then cast(n_nationkey - 1 as int) else -1 end as optional_bit
    from {nation} where n_nationkey < 8
    """,
)
projection(
    "workflow_transitions",
    """
    select 'v' || cast(s_suppkey as string) as case_id, transition_id, req, adds, sensor_id, optional_bit, s_suppkey as k, n
    from {supplier} cross join {workflow_steps}
    """,
)
projection(
    "workflow_observations",
    """
    select case_id, 'obs-' || transition_id as obs_id, sensor_id, case when k % 31 = 9 and n = 4 then 'unlisted-route' else transition_id end as transition_id,
      not (k % 12 = 7 and n = 6) as verified
    from {workflow_transitions} where not (k % 17 = 5 and n = 0)
    """,
)
projection(
    "workflow_guards",
    """
    select 'seal-' || cast(n as string) as control_id, 2 + (5 * n) % 4 as cost, transition_id as guarded from {workflow_steps} where n < 4
    union all select 'shut-' || req, 6, string_agg(transition_id, ',') from {workflow_steps} where req = 'dock-1' group by req
    union all select 'shut-hub', 7, string_agg(transition_id, ',') from {workflow_steps} where req = 'hub' or adds = 'hub'
    union all select 'recall-all', 21, string_agg(transition_id, ',') from {workflow_steps} where n < 4
    """,
)
projection(
    "workflow_controls",
    """
    select 'v' || cast(s_suppkey as string) as case_id, control_id, cast(cost + s_suppkey % 3 as bigint) as cost,
      not (s_suppkey % 9 = 4 and control_id = 'shut-hub') as permitted, guarded
    from {supplier} cross join {workflow_guards}
    """,
)
projection(
    "workflow_initial",
    """
    select 'v' || cast(s_suppkey as string) as case_id, req as fact, optional_bit from {supplier} cross join {workflow_steps}
    where n < 4 and not (n = 0 and s_suppkey % 5 = 0)
    union all
    select 'v' || cast(s_suppkey as string), 'store', -1 from {supplier} where s_suppkey % 23 = 6
    """,
)
projection(
    "workflow_residual",
    """
    select distinct 'v' || cast(s_suppkey as string) as case_id, adds as fact from {supplier} cross join {workflow_steps}
    where adds = 'store' or (adds = 'hub' and s_suppkey % 2 = 0)
    """,
)
projection(
    "cycle_transitions",
    """
    select 'y' || cast(s_suppkey as string) as case_id, transition_id, req, adds, removes, forbids from {supplier} cross join (
      select 't1' as transition_id, '' as req, 'a' as adds, '' as removes, 'b' as forbids, 1 as i
      union all select 't2', 'a', 'b', 'a', '', 2
      union all select 't3', 'b', 'c', '', '', 3
      union all select 't4', 'c', 'leak', '', 'a,b', 5
      union all select 't5', 'c', 'd', 'b', '', 7
      union all select 't6', 'a,d', 'leak', '', '', 11
      union all select 't7', 'd', 'e', 'c', 'a', 13) t
    where s_suppkey % i <> 1 or i < 3
    """,
)


def names(column: str) -> Column:
    """Comma-separated names as a sorted array; an empty text is an empty array."""
    return F.array_sort(F.filter(F.split(column, ","), lambda x: x != ""))


def workflow(spark: SparkSession, sf_dir: str):
    """Base case tables with array columns."""
    t = lambda n: table(spark, sf_dir, n)
    transitions = t("workflow_transitions").select(
        "case_id", "transition_id", names("req").alias("requires"), names("adds").alias("adds"), "optional_bit"
    )
    controls = t("workflow_controls").withColumn("guarded", names("guarded"))
    return transitions, t("workflow_initial"), t("workflow_residual"), t("workflow_observations"), controls


def required_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "workflow_transitions").select("case_id", "sensor_id").distinct()
