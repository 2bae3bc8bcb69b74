"""Recovery workflows of suppliers: coverage, regeneration, control plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceless.operators import temporal as E
from traceless.plans.catalog import projection, table
from traceless.plans.recovery_tables import names, required_sensors, workflow
from traceless.plans.workspace import shuffled
from traceless.queries.registry import query

_COVERAGE = {
    "sensors": "select distinct case_id, sensor_id from {workflow_transitions}",
    "gaps": """select case_id, 'missing' as gap, sensor_id as item from {sensors} s where not exists (select 1 from {workflow_observations} o where o.case_id = s.case_id and o.sensor_id = s.sensor_id and verified)
        union all select case_id, 'unobserved', transition_id from {workflow_transitions} t where not exists (select 1 from {workflow_observations} o where o.case_id = t.case_id and o.transition_id = t.transition_id and verified)
        union all select distinct case_id, 'unregistered', transition_id from {workflow_observations} o where not exists (select 1 from {workflow_transitions} t where o.case_id = t.case_id and o.transition_id = t.transition_id)
        union all select case_id, 'unverified', obs_id from {workflow_observations} where not verified""",
    "covered": """select c.case_id, count(g.item) = 0 as complete,
        coalesce(string_agg(item, '>' order by item) filter (gap = 'missing'), '') as missing_sensors, coalesce(string_agg(item, '>' order by item) filter (gap = 'unobserved'), '') as unobserved,
        coalesce(string_agg(item, '>' order by item) filter (gap = 'unregistered'), '') as unregistered, coalesce(string_agg(item, '>' order by item) filter (gap = 'unverified'), '') as unverified
        from (select distinct case_id from {workflow_transitions}) c left join {gaps} g using (case_id) group by c.case_id""",
}


def case_coverage(spark, sf):
    transitions, _, _, observations, _ = workflow(spark, sf)
    return E.coverage(transitions, required_sensors(spark, sf), observations)


@query("transition_coverage", "select * from {covered}", _COVERAGE)
def transition_coverage(spark, sf):
    lists = ["missing_sensors", "unobserved", "unregistered", "unverified"]
    return case_coverage(spark, sf).select("case_id", "complete", *[F.array_join(c, ">").alias(c) for c in lists])


# Simple runs with list states; monotone cases only, so runs are finite.
_RUNS = {
    "resid": "select {keys}, list(distinct fact) as facts from {residual_facts} group by {keys}",
    "runs": """select c.*, [] ::varchar[] as path, list_has_any(c.state, coalesce(r.facts, [])) as hit from {case_states} c left join {resid} r using ({keys})
        union all select {rkeys}, list_sort(list_distinct(list_append(r.state, t.adds))), list_append(r.path, t.transition_id), list_contains(d.facts, t.adds) or r.hit
        from {runs} r join {steps} t using ({keys}) left join {resid} d using ({keys}) where not r.hit and list_contains(r.state, t.req) and not list_contains(r.state, t.adds)""",
    "firsts": "select {keys}, state, arg_min(path, (len(path), path)) as path, bool_or(hit) as hit from {runs} group by {keys}, state",
    "hits": "select {keys}, arg_min(struct_pack(path := path, state := state), (len(path), path)) as w from {firsts} where hit group by {keys}",
    "reported": """select {keys}, c.complete as coverage_complete, h.w is not null as risk_any,
        case when h.w is not null and len(h.w.path) = 0 then 'SNAPSHOT_INCOMPLETE' when h.w is not null then 'REGENERATION_RISK' when c.complete then 'RSE_VERIFIED' else 'INCOMPLETE_COVERAGE' end as verdict,
        h.w.path as witness, (select count(*) from {firsts} f where {fkeys} and (h.w is null or (len(f.path), f.path) <= (len(h.w.path), h.w.path))) as reachable_states
        from {covered_cases} c left join {hits} h using ({keys})""",
}


def _runs(keys: list[str]) -> dict[str, str]:
    k = ", ".join(keys)
    fkeys = " and ".join(f"f.{x} = c.{x}" for x in keys)
    rkeys = ", ".join(f"r.{x}" for x in keys)
    return {
        name: text.replace("{keys}", k).replace("{rkeys}", rkeys).replace("{fkeys}", fkeys)
        for name, text in _RUNS.items()
    }


_CASE_BASE = {
    "residual_facts": "select case_id, fact from {workflow_residual}",
    "case_states": "select case_id, coalesce(list_sort(list(fact) filter (fact is not null)), []) as state from (select distinct case_id from {workflow_transitions}) left join {workflow_initial} using (case_id) group by case_id",
    "steps": "select case_id, transition_id, req, adds from {workflow_transitions}",
    "covered_cases": "select case_id, complete from {covered}",
}


@query(
    "regeneration_analysis",
    "select case_id, verdict, coverage_complete, array_to_string(witness, '>') as witness, reachable_states from {reported}",
    {**_COVERAGE, **_CASE_BASE, **_runs(["case_id"])},
)
def regeneration_analysis(spark, sf):
    transitions, initial, residual, _, _ = workflow(spark, sf)
    reports = E.regeneration(transitions, initial, residual, case_coverage(spark, sf))
    return reports.select("case_id", "verdict", "coverage_complete", F.array_join("witness", ">").alias("witness"), "reachable_states")


def cycle_cases(spark, sf):
    raw = table(spark, sf, "cycle_transitions")
    transitions = raw.select(
        "case_id", "transition_id", *[names(c).alias(n) for c, n in (("req", "requires"), ("adds", "adds"), ("removes", "removes"), ("forbids", "forbids"))]
    )
    cases = raw.select("case_id").distinct()
    initial = cases.select("case_id", F.lit("seed").alias("fact"))
    residual = cases.select("case_id", F.lit("leak").alias("fact"))
    return transitions, initial, residual, cases.withColumn("complete", F.lit(True))


@query("regeneration_with_removals")
def regeneration_with_removals(spark, sf):
    reports = E.regeneration(*cycle_cases(spark, sf))
    return reports.select("case_id", "verdict", F.array_join("witness", ">").alias("witness"), "reachable_states", "limit_exceeded")


@query(
    "fact_closure",
    "select case_id, fact from {closed}",
    {
        "closed": """select case_id, fact from {workflow_initial} union select c.case_id, t.adds from {closed} c join {workflow_transitions} t on t.case_id = c.case_id and t.req = c.fact""",
    },
)
def fact_closure(spark, sf):
    transitions, initial, _, _, _ = workflow(spark, sf)
    return E.fact_closure(transitions, initial)


_SUBSETS = {
    "options": "select case_id, control_id, cost, guarded, row_number() over (partition by case_id order by control_id) - 1 as idx from {workflow_controls} where permitted",
    "masks": """select s.case_id, m.mask, coalesce(sum(o.cost), 0)::bigint as cost, coalesce(list(o.control_id order by o.control_id) filter (o.control_id is not null), []) as ids,
        coalesce(list_distinct(flatten(list(string_split(o.guarded, ',')) filter (o.guarded is not null))), []) as guarded
        from (select distinct case_id from {workflow_transitions}) s cross join (select unnest(range(0, 128)) as mask) m left join {options} o on o.case_id = s.case_id and (m.mask >> o.idx) & 1 = 1
        where m.mask < (1 << (select count(*) from {options} x where x.case_id = s.case_id)) group by all""",
}
_CASE_PLAN = {
    **_COVERAGE,
    **_SUBSETS,
    "mfacts": """select m.case_id, m.mask, i.fact from {masks} m join {workflow_initial} i using (case_id)
        union select f.case_id, f.mask, t.adds from {mfacts} f join {masks} m on m.case_id = f.case_id and m.mask = f.mask join {workflow_transitions} t on t.case_id = f.case_id and t.req = f.fact and not list_contains(m.guarded, t.transition_id)""",
    "safe": """select case_id, mask from {masks} except select f.case_id, f.mask from {mfacts} f join {workflow_residual} r on r.case_id = f.case_id and r.fact = f.fact""",
    "case_plan": """select c.case_id, case when complete then coalesce(b.ids, []) else [] end as control_ids, case when complete then coalesce(b.cost, 0) else 0 end as total_cost,
        case when not complete then 'UNVERIFIED' when b is null then 'INFEASIBLE' else 'OPTIMAL' end as status from {covered} c left join (
          select case_id, arg_min(struct_pack(ids := ids, cost := cost), (cost, len(ids), ids)) as b from {safe} join {masks} using (case_id, mask) group by case_id) using (case_id)""",
}


@query("minimum_cost_controls", "select case_id, array_to_string(control_ids, '>') as control_ids, total_cost, status from {case_plan}", _CASE_PLAN)
def minimum_cost_controls(spark, sf):
    transitions, initial, residual, _, controls = workflow(spark, sf)
    plan = E.min_cost_controls(transitions, initial, residual, case_coverage(spark, sf), controls)
    return plan.withColumn("control_ids", F.array_join("control_ids", ">"))


def scenarios(spark, sf):
    transitions, initial, residual, observations, controls = workflow(spark, sf)
    t = E.fan_out_scenarios(transitions, 3)
    i = E.fan_out_scenarios(initial, 3)
    ids = t.select("case_id", "scenario_id", "mutation_count").distinct()
    r = residual.join(shuffled(ids.select("case_id", "scenario_id")), "case_id")
    base = case_coverage(spark, sf).select("case_id", "complete")
    return t, i, r, ids.join(shuffled(base), "case_id"), controls


_SCENARIO = {
    **_COVERAGE,
    "scen": "select unnest(range(0, 8)) as s",
    "scen_steps": "select case_id, lpad(bin(s), 3, '0') as scenario_id, bit_count(s)::bigint as mutation_count, transition_id, req, adds from {workflow_transitions}, {scen} where optional_bit < 0 or (s >> greatest(optional_bit, 0)) & 1 = 1",
    "scen_initial": "select case_id, lpad(bin(s), 3, '0') as scenario_id, fact from {workflow_initial}, {scen} where optional_bit < 0 or (s >> greatest(optional_bit, 0)) & 1 = 1",
    "scen_cases": "select distinct case_id, scenario_id, mutation_count from {scen_steps}",
    "residual_facts": "select c.case_id, c.scenario_id, fact from {scen_cases} c join {workflow_residual} using (case_id)",
    "case_states": "select case_id, scenario_id, coalesce(list_sort(list(fact) filter (fact is not null)), []) as state from {scen_cases} left join {scen_initial} using (case_id, scenario_id) group by all",
    "steps": "select case_id, scenario_id, transition_id, req, adds from {scen_steps}",
    "covered_cases": "select case_id, scenario_id, complete from {scen_cases} join {covered} using (case_id)",
    **_runs(["case_id", "scenario_id"]),
}


@query(
    "scenario_fan_out",
    "select case_id, scenario_id, mutation_count, count(*) as transitions from {scen_steps} group by all",
    {k: _SCENARIO[k] for k in ("scen", "scen_steps")},
)
def scenario_fan_out(spark, sf):
    t = E.fan_out_scenarios(workflow(spark, sf)[0], 3)
    return t.groupBy("case_id", "scenario_id", "mutation_count").agg(F.count(F.lit(1)).alias("transitions"))


@query(
    "adversarial_witness",
    """select case_id, w.scenario_id, w.mutation_count, array_to_string(w.witness, '>') as witness from (select case_id,
         arg_min(struct_pack(scenario_id := scenario_id, mutation_count := mutation_count, witness := witness), (len(witness), mutation_count, scenario_id, witness)) as w
         from {reported} join {scen_cases} using (case_id, scenario_id) where verdict = 'REGENERATION_RISK' group by case_id)""",
    _SCENARIO,
)
def adversarial_witness(spark, sf):
    t, i, r, c, _ = scenarios(spark, sf)
    reports = E.regeneration(t, i, r, c, ["case_id", "scenario_id"])
    joined = reports.join(shuffled(c.select("case_id", "scenario_id", "mutation_count")), ["case_id", "scenario_id"])
    return E.shortest_adversarial_witness(joined).withColumn("witness", F.array_join("witness", ">"))


_ROBUST = {
    **{k: _SCENARIO[k] for k in ("scen", "scen_steps", "scen_initial", "scen_cases")},
    **_CASE_PLAN,
    "sfacts": """select m.case_id, i.scenario_id, m.mask, i.fact from {masks} m join {scen_initial} i using (case_id)
        union select f.case_id, f.scenario_id, f.mask, t.adds from {sfacts} f join {masks} m on m.case_id = f.case_id and m.mask = f.mask
          join {scen_steps} t on t.case_id = f.case_id and t.scenario_id = f.scenario_id and t.req = f.fact and not list_contains(m.guarded, t.transition_id)""",
    "rsafe": "select case_id, mask from {masks} except select f.case_id, f.mask from {sfacts} f join {workflow_residual} r on r.case_id = f.case_id and r.fact = f.fact",
    "robust_plan": """select c.case_id, case when complete then coalesce(b.ids, []) else [] end as control_ids, case when complete then coalesce(b.cost, 0) else 0 end as total_cost,
        case when not complete then 'UNVERIFIED' when b is null then 'INFEASIBLE' else 'OPTIMAL' end as status from {covered} c left join (
          select case_id, arg_min(struct_pack(ids := ids, cost := cost), (cost, len(ids), ids)) as b from {rsafe} join {masks} using (case_id, mask) group by case_id) using (case_id)""",
    "nsafe": "select case_id, mask from {masks} except select f.case_id, f.mask from {sfacts} f join {workflow_residual} r on r.case_id = f.case_id and r.fact = f.fact where f.scenario_id = '000'",
    "nominal_plan": """select c.case_id, case when complete then coalesce(b.cost, 0) else 0 end as total_cost,
        case when not complete then 'UNVERIFIED' when b is null then 'INFEASIBLE' else 'OPTIMAL' end as status from {covered} c left join (
          select case_id, arg_min(struct_pack(ids := ids, cost := cost), (cost, len(ids), ids)) as b from {nsafe} join {masks} using (case_id, mask) group by case_id) using (case_id)""",
}


@query("robust_controls", "select case_id, array_to_string(control_ids, '>') as control_ids, total_cost, status from {robust_plan}", _ROBUST)
def robust_controls(spark, sf):
    t, i, r, c, controls = scenarios(spark, sf)
    return E.robust_controls(t, i, r, c, controls).withColumn("control_ids", F.array_join("control_ids", ">"))


@query(
    "robustness_premium",
    """select case_id, n.total_cost as nominal_cost, n.status as nominal_status, r.total_cost as robust_cost, r.status as robust_status, r.total_cost - n.total_cost as premium
       from {nominal_plan} n join {robust_plan} r using (case_id)""",
    _ROBUST,
)
def robustness_premium(spark, sf):
    t, i, r, c, controls = scenarios(spark, sf)
    nominal = lambda df: df.where("scenario_id = '000'").drop("scenario_id", "mutation_count")
    steps = nominal(t)
    # Only controls that guard a transition of the nominal scenario matter there.
    present = steps.groupBy("case_id").agg(F.collect_set("transition_id").alias("present"))
    relevant = controls.join(present, "case_id").withColumn("guarded", F.array_intersect("guarded", "present")).where(F.size("guarded") > 0).drop("present")
    plan = E.min_cost_controls(steps, nominal(i), nominal(r), nominal(c), relevant)
    return E.robustness_premium(plan, E.robust_controls(t, i, r, c, controls))


_CONTEXT = """select c_custkey as k, 's' || c_custkey as request_id, 's' || c_custkey as certificate_id, c_custkey % 41 <> 3 as signature_ok, case when c_custkey % 37 = 2 then 200 else 10 end as issued_epoch,
    case when c_custkey % 31 = 4 then 50 else 1000 end as not_after_epoch, case when c_custkey % 5 = 0 then 'INCOMPLETE' else 'COMPLETE_WITHIN_ENVELOPE' end as declared from customer"""


@query(
    "certificate_checks",
    """select certificate_id, case when status is null then 'VALID' else status end as status, coalesce(reason, 'signature, replay, commitments, and time window are valid') as reason from (
       select certificate_id, case when not signature_ok or issued_epoch > 100 then 'INVALID' when not_after_epoch < 100 or k % 29 = 5 or k % 23 = 6 or k % 53 = 7 then 'EXPIRED' when k % 19 = 8 or (declared = 'COMPLETE_WITHIN_ENVELOPE' and k % 17 = 9) then 'INVALID' end as status,
         case when not signature_ok then 'invalid signature' when issued_epoch > 100 then 'certificate is not active' when not_after_epoch < 100 then 'time window expired'
              when k % 29 = 5 then 'topology commitment changed' when k % 23 = 6 then 'model set commitment changed' when k % 53 = 7 then 'action signature commitment changed'
              when k % 19 = 8 then 'declared verdict differs from independent replay' when declared = 'COMPLETE_WITHIN_ENVELOPE' and k % 17 = 9 then 'complete verdict has an undischarged obligation' end as reason from {certs})""",
    {"certs": _CONTEXT},
)
def certificate_checks(spark, sf):
    k = F.col("c_custkey")
    rid = F.concat(F.lit("s"), k.cast("string"))
    declared = F.when(k % 5 == 0, "INCOMPLETE").otherwise("COMPLETE_WITHIN_ENVELOPE")
    hashes = [column for _, column in E.COMMITMENTS]
    certs = table(spark, sf, "customer").select(
        rid.alias("request_id"),
        rid.alias("certificate_id"),
        (k % 41 != 3).alias("signature_ok"),
        F.when(k % 37 == 2, 200).otherwise(10).alias("issued_epoch"),
        F.when(k % 31 == 4, 50).otherwise(1000).alias("not_after_epoch"),
        declared.alias("declared_verdict"),
        *[F.sha2(F.concat(F.lit(h), rid), 256).alias(h) for h in hashes],
    )
    drift = {"topology_hash": (29, 5), "model_set_hash": (23, 6), "action_signature_hash": (53, 7)}
    context = table(spark, sf, "customer").select(
        rid.alias("request_id"),
        F.when(k % 19 == 8, "UNVERIFIED").otherwise(declared).alias("replayed_verdict"),
        (k % 17 != 9).alias("obligations_met"),
        *[
            F.sha2(F.concat(F.lit(h), rid, F.when(k % drift[h][0] == drift[h][1], "x").otherwise("") if h in drift else F.lit("")), 256).alias(h)
            for h in hashes
        ],
    )
    return E.check_certificates(certs, context, 100)


projection(
    "temporal_trials",
    """
    select s_suppkey as case_id, case s_suppkey % 5 when 0 then 'safe' when 1 then 'coverage_fault' else 'risk' end as split,
      case s_suppkey % 5 when 0 then case when s_suppkey % 45 = 0 then 'INCOMPLETE_COVERAGE' else 'RSE_VERIFIED' end when 1 then 'INCOMPLETE_COVERAGE' else 'REGENERATION_RISK' end as verdict,
      case when s_suppkey % 7 <> 3 then 'COMPLETE' else 'INCOMPLETE' end as snapshot_verdict, s_suppkey % 3 <> 2 as regenerated_without_control,
      case when s_suppkey % 2 = 0 then 'INCOMPLETE' else 'COMPLETE' end as carrier_verdict, s_suppkey % 89 = 2 as regenerated_after_control, cast(s_suppkey % 12 as bigint) as selected_cost
    from {supplier}
    """,
)
_TEMPORAL_GATES = [
    ("risk_case_count", "risk_case_count", ">=", 1),
    ("safe_specificity_count", "safe_specificity_count", ">=", 1),
    ("recurrence_after_control_count", "recurrence_after_control_count", "<=", 0),
    ("maximum_selected_cost", "maximum_selected_cost", "<=", 11),
]


@query(
    "temporal_lab_metrics",
    """select count(*) filter (split = 'risk') as risk_case_count, count(*) filter (split = 'safe') as safe_case_count, count(*) filter (split = 'coverage_fault') as coverage_fault_case_count,
         count(*) filter (split = 'risk' and verdict = 'REGENERATION_RISK') as risk_detection_count, count(*) filter (split = 'safe' and verdict = 'RSE_VERIFIED') as safe_specificity_count,
         count(*) filter (split = 'coverage_fault' and verdict = 'INCOMPLETE_COVERAGE') as coverage_fail_closed_count, count(*) filter (split = 'risk' and snapshot_verdict = 'COMPLETE' and regenerated_without_control) as snapshot_false_complete_count,
         count(*) filter (split = 'safe' and carrier_verdict = 'INCOMPLETE') as carrier_false_incomplete_count, count(*) filter (split = 'risk' and regenerated_after_control) as recurrence_after_control_count,
         coalesce(max(selected_cost) filter (split = 'risk'), 0) as maximum_selected_cost from {temporal_trials}""",
)
def temporal_lab_metrics(spark, sf):
    from traceless.operators.outcomes import temporal_metrics

    return temporal_metrics(table(spark, sf, "temporal_trials"))


@query(
    "temporal_lab_gates",
    """select 'risk_case_count' as gate, rc::double as observed, 1.0::double as threshold, rc >= 1 as passed from {m} union all select 'safe_specificity_count', ss, 1.0, ss >= 1 from {m}
       union all select 'recurrence_after_control_count', ra, 0.0, ra <= 0 from {m} union all select 'maximum_selected_cost', mc, 11.0, mc <= 11 from {m}""",
    {
        "m": "select count(*) filter (split = 'risk') as rc, count(*) filter (split = 'safe' and verdict = 'RSE_VERIFIED') as ss, count(*) filter (split = 'risk' and regenerated_after_control) as ra, coalesce(max(selected_cost) filter (split = 'risk'), 0) as mc from {temporal_trials}"
    },
)
def temporal_lab_gates(spark, sf):
    from traceless.operators.outcomes import gate_rows, temporal_metrics

    return gate_rows(temporal_metrics(table(spark, sf, "temporal_trials")), _TEMPORAL_GATES)
