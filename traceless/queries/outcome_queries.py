"""Trial, measurement and loss statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceless.operators import influence as M
from traceless.operators import outcomes as O
from traceless.plans import trial_tables  # noqa: F401
from traceless.plans.catalog import table
from traceless.queries.registry import query

REPLICATES = 40
SEED = 7


def rounded(df, digits: int = 6):
    """Doubles rounded so that summation order does not show."""
    return df.select(
        *[
            (F.round(F.col(n), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(n)
            for n, t in df.dtypes
        ]
    )


def duck_wilson(k: str, n: str, side: str) -> str:
    z = 1.959963984540054
    sign = "-" if side == "low" else "+"
    value = (
        f"(({k} / cast({n} as double)) + {z * z} / (2.0 * {n}) {sign} {z} * sqrt(({k} / cast({n} as double)) * (1 - {k} / cast({n} as double)) / {n}"
        f" + {z * z} / (4.0 * {n} * {n}))) / (1 + {z * z} / {n})"
    )
    bound = f"greatest(0.0, {value})" if side == "low" else f"least(1.0, {value})"
    return f"case when {n} > 0 then {bound} end"


def duck_draw(*parts: str) -> str:
    state = "cast(20011 as bigint)"
    for part in parts:
        state = f"(({state} * 48271 + (cast({part} as bigint) % 2147483647) * 69621) % 2147483647)"
    for _ in range(2):
        state = f"(({state} * {state} + 12345) % 2147483647)"
    return f"({state} % 1000000)"


def duck_weight(u: str) -> str:
    steps = (367879, 735759, 919699, 981012, 996340, 999406, 999917, 999990)
    return "(" + " + ".join(f"case when {u} >= {b} then 1 else 0 end" for b in steps) + ")"


_RATES = """
    select {by}, round(fn / nullif(tp + fn, 0), 6) as false_complete_rate, round(tp / nullif(tp + fn, 0), 6) as recall,
      round(tp / nullif(tp + fp, 0), 6) as precision, round(fp / nullif(fp + tn, 0), 6) as false_alarm_rate,
      round(found / nullif(nodes, 0), 6) as exact_node_recall
"""


def _cells(weight: str) -> str:
    w = weight
    return (
        f"cast(sum({w}) filter (truth_positive and not declared_complete) as double) as tp,"
        f" cast(sum({w}) filter (truth_positive and declared_complete) as double) as fn,"
        f" cast(sum({w}) filter (not truth_positive and declared_complete) as double) as tn,"
        f" cast(sum({w}) filter (not truth_positive and not declared_complete) as double) as fp,"
        f" cast(sum({w} * len(coalesce(truth_ids, []))) as double) as nodes,"
        f" cast(sum({w} * len(list_intersect(coalesce(truth_ids, []), coalesce(detected_ids, [])))) as double) as found"
    )


@query(
    "outcome_report",
    f"""select method, family, trials, cast(coalesce(tp, 0) as bigint) as true_positive, cast(coalesce(fn, 0) as bigint) as false_negative,
         cast(coalesce(tn, 0) as bigint) as true_negative, cast(coalesce(fp, 0) as bigint) as false_positive,
         cast(coalesce(tp, 0) + coalesce(fn, 0) as bigint) as positive_trials,
         round(coalesce(fn, 0) / nullif(coalesce(tp, 0) + coalesce(fn, 0), 0), 6) as false_complete_rate,
         round(coalesce(tp, 0) / nullif(coalesce(tp, 0) + coalesce(fn, 0), 0), 6) as recall,
         round(coalesce(tp, 0) / nullif(coalesce(tp, 0) + coalesce(fp, 0), 0), 6) as precision,
         round(coalesce(fp, 0) / nullif(coalesce(fp, 0) + coalesce(tn, 0), 0), 6) as false_alarm_rate,
         round(found / nullif(nodes, 0), 6) as exact_node_recall, round(rt, 6) as mean_runtime_ms, round(mc, 6) as mean_cost
       from (select method, family, count(*) as trials, avg(runtime_ms) as rt, avg(cost) as mc, {_cells('1')} from {{trials}} group by all)""",
)
def outcome_report(spark, sf):
    return rounded(O.outcome_report(table(spark, sf, "trials"), ["method", "family"]))


@query(
    "outcome_bootstrap",
    """select method, metric, round(est[round_even((len(est) - 1) * 0.025, 0)::int + 1], 6) as low,
         round(est[round_even((len(est) - 1) * 0.975, 0)::int + 1], 6) as high
       from (select method, metric, list_sort(list(estimate) filter (estimate is not null)) as est
             from (unpivot (select method, replicate, fn / nullif(tp + fn, 0) as false_complete_rate, tp / nullif(tp + fn, 0) as recall,
                      tp / nullif(tp + fp, 0) as precision, fp / nullif(fp + tn, 0) as false_alarm_rate,
                      found / nullif(nodes, 0) as exact_node_recall from {sums})
                   on false_complete_rate, recall, precision, false_alarm_rate, exact_node_recall into name metric value estimate)
             group by all)""",
    {
        "drawn": f"""select t.*, replicate, {duck_weight(duck_draw(str(SEED), 'replicate', 'case_id'))} as w
                     from {{trials}} t, (select unnest(range(1, {REPLICATES} + 1)) as replicate)""",
        "sums": "select method, replicate, "
        + ", ".join(
            f"coalesce(sum(w) filter ({test}), 0)::double as {name}"
            for name, test in {
                "tp": "truth_positive and not declared_complete",
                "fn": "truth_positive and declared_complete",
                "tn": "not truth_positive and declared_complete",
                "fp": "not truth_positive and not declared_complete",
            }.items()
        )
        + """, sum(w * len(coalesce(truth_ids, [])))::double as nodes,
            sum(w * len(list_intersect(coalesce(truth_ids, []), coalesce(detected_ids, []))))::double as found
            from {drawn} group by all""",
    },
)
def outcome_bootstrap(spark, sf):
    return rounded(O.bootstrap_outcomes(table(spark, sf, "trials"), ["method"], "case_id", REPLICATES, SEED))


def _duck_mean_ci(source: str, by: list[str], key: str, value: str) -> tuple[str, dict[str, str]]:
    cols = ", ".join(by)
    lead = f"{cols}, " if by else ""
    ctes = {
        "drawn_means": f"""select {lead}replicate, sum(w * {value}) / sum(w) as m from (
              select *, {duck_weight(duck_draw(str(SEED), 'replicate', key))} as w
              from {{{source}}}, (select unnest(range(1, {REPLICATES} + 1)) as replicate)) where w > 0 group by {lead}replicate""",
        "mean_ci": f"""select p.*, round(low, 6) as low, round(high, 6) as high from
              (select {lead}count({value}) as n, round(avg({value}), 6) as mean from {{{source}}} {'group by all' if by else ''}) p
              join (select {lead}quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from {{drawn_means}} {'group by ' + cols if by else ''}) q
              {'using (' + cols + ')' if by else 'on true'}""",
    }
    return "select * from {mean_ci}", ctes


_sql, _ctes = _duck_mean_ci("verdict_cost", ["method"], "case_id", "cost")


@query("bootstrap_mean_interval", _sql, {"verdict_cost": "select method, case_id, cost::double as cost from {trials}", **_ctes})
def bootstrap_mean_interval(spark, sf):
    trials = table(spark, sf, "trials").withColumn("cost", F.col("cost").cast("double"))
    return rounded(O.bootstrap_mean(trials, ["method"], "case_id", "cost", REPLICATES, SEED))


@query(
    "wilson_intervals",
    f"""select n_regionkey, k, n, round({duck_wilson('k', 'n', 'low')}, 6) as low, round({duck_wilson('k', 'n', 'high')}, 6) as high
        from (select n_regionkey, count(*) filter (c_acctbal < 0) as k, count(*) as n
              from customer join nation on c_nationkey = n_nationkey group by 1)""",
)
def wilson_intervals(spark, sf):
    from traceless.functions.statistics import wilson95

    joined = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = joined.groupBy("n_regionkey").agg(
        F.count_if(F.col("c_acctbal") < 0).alias("k"), F.count(F.lit(1)).alias("n")
    )
    interval = wilson95(F.col("k"), F.col("n"))
    return rounded(counts.select("*", interval["low"].alias("low"), interval["high"].alias("high")))


_OPEN = "truth_verdict <> 'COMPLETE'"


@query(
    "benchmark_metrics",
    f"""select task, method, trials, truth_noncomplete, false_complete, detected_noncomplete, round(mc, 6) as mean_cost,
          round(false_complete / nullif(truth_noncomplete, 0)::double, 6) as false_complete_rate,
          round(detected_noncomplete / nullif(truth_noncomplete, 0)::double, 6) as noncomplete_recall,
          round({duck_wilson('false_complete', 'truth_noncomplete', 'low')}, 6) as wilson_low,
          round({duck_wilson('false_complete', 'truth_noncomplete', 'high')}, 6) as wilson_high
        from (select task, method, count(*) as trials, count(*) filter ({_OPEN}) as truth_noncomplete,
          count(*) filter ({_OPEN} and verdict = 'COMPLETE') as false_complete,
          count(*) filter ({_OPEN} and verdict <> 'COMPLETE') as detected_noncomplete, avg(cost) as mc
          from {{verdict_trials}} group by all)""",
)
def benchmark_metrics(spark, sf):
    return rounded(O.benchmark_metrics(table(spark, sf, "verdict_trials")))


@query(
    "holdout_score",
    f"""select method, family, trials, noncomplete, false_complete, exceptions, noncomplete - false_complete as detected_noncomplete,
          round(false_complete / nullif(noncomplete, 0)::double, 6) as false_complete_rate,
          round(true_complete / nullif(trials - noncomplete, 0)::double, 6) as specificity,
          round({duck_wilson('false_complete', 'noncomplete', 'high')}, 6) as wilson_high,
          case when false_complete = 0 and exceptions = 0 and coalesce({duck_wilson('false_complete', 'noncomplete', 'high')} <= 0.05, false) then 'PASS' else 'FAIL' end as decision
        from (select method, family, count(*) as trials, count(*) filter ({_OPEN}) as noncomplete,
          count(*) filter ({_OPEN} and verdict = 'COMPLETE') as false_complete,
          count(*) filter (not {_OPEN} and verdict = 'COMPLETE') as true_complete, count(*) filter (exception <> '') as exceptions
          from {{verdict_trials}} group by rollup (method, family) having grouping(method) = 0)""",
)
def holdout_score(spark, sf):
    return rounded(O.score_holdout(table(spark, sf, "verdict_trials")))


_PREDICTION_GATES = [
    ("case_count", "case_count", ">=", 50),
    ("distinct_families", "distinct_families", ">=", 3),
    ("false_complete_wilson95_upper", "false_complete_wilson95_upper", "<=", 0.05),
    ("exact_path_rate", "exact_path_rate", ">=", 0.9),
    ("noncomplete_count", "noncomplete_count", ">=", 20),
    ("verdict_accuracy", "verdict_accuracy", ">=", 0.8),
]


def duck_gates(row: str, gates) -> str:
    parts = [
        f"select '{g}' as gate, round({m}::double, 6) as observed, {float(b)}::double as threshold, coalesce({m} {'=' if op == '==' else op} {float(b)}, false) as passed from {row}"
        for g, m, op, b in gates
    ]
    return " union all ".join(parts)


@query(
    "blind_predictions",
    duck_gates("{scored}", _PREDICTION_GATES),
    {
        "counted": """select count(*) as case_count, count(distinct family) as distinct_families, count(*) filter (truth_verdict <> 'COMPLETE') as noncomplete_count,
             count(*) filter (truth_verdict <> 'COMPLETE' and verdict = 'COMPLETE') as false_complete,
             avg((verdict = truth_verdict)::int) as verdict_accuracy,
             count(*) filter (truth_positive and len(truth_ids) = len(coalesce(detected_ids, [])) and list_sort(truth_ids) = list_sort(coalesce(detected_ids, []))) / count(*) filter (truth_positive)::double as exact_path_rate
             from {verdict_trials} join (select case_id, method, truth_positive, truth_ids, detected_ids from {trials}) using (case_id, method) where method = 'graph'""",
        "scored": f"select *, {duck_wilson('false_complete', 'noncomplete_count', 'high')} as false_complete_wilson95_upper from {{counted}}",
    },
)
def blind_predictions(spark, sf):
    records = table(spark, sf, "verdict_trials").where("method = 'graph'")
    trials = table(spark, sf, "trials").where("method = 'graph'")
    empty = F.array().cast("array<int>")
    paths = trials.select(
        "case_id",
        F.when(F.col("truth_positive"), F.array_sort("truth_ids")).alias("expected_path"),
        F.array_sort(F.coalesce("detected_ids", empty)).alias("shortest_path"),
    )
    predictions = records.select("case_id", "verdict").join(paths.select("case_id", "shortest_path"), "case_id")
    truth = records.select("case_id", "family", "truth_verdict").join(paths.select("case_id", "expected_path"), "case_id")
    return rounded(O.score_predictions(predictions, truth, _PREDICTION_GATES))


@query(
    "paired_speedup",
    f"""select broken_pairs, pairs, round(gm, 6) as geometric_mean, targeted_bytes, rebuild_bytes, round(cr, 6) as complete_rate,
          maximum_model_weight_delta, round(loss, 6) as maximum_retained_loss_rate,
          round(1 - targeted_bytes / rebuild_bytes, 6) as bytes_reduction, round(ms[floor(0.025 * (len(ms) - 1))::int + 1], 6) as low,
          round(ms[floor(0.975 * (len(ms) - 1))::int + 1], 6) as high
        from (select count(*) filter (fast is null or slow is null) as broken_pairs, count(*) as pairs, exp(avg(lr)) as gm, sum(tb)::bigint as targeted_bytes,
                sum(rb)::bigint as rebuild_bytes, sum(done) / sum(n) as cr, round(max(delta), 6) as maximum_model_weight_delta, max(loss) as loss from {{pairs}}),
          (select list_sort(list(m)) as ms from (select replicate, exp(sum(w * lr) / sum(w)) as m from (
             select lr, replicate, {duck_weight(duck_draw(str(SEED), 'replicate', 'seed'))} as w from {{pairs}}, (select unnest(range(1, {REPLICATES} + 1)) as replicate))
             where w > 0 group by replicate))""",
    {
        "pairs": """select seed, max(seconds) filter (strategy = 'targeted') as fast, max(seconds) filter (strategy = 'rebuild') as slow, ln(slow / fast) as lr,
              sum(bytes_rewritten) filter (strategy = 'targeted') as tb, sum(bytes_rewritten) filter (strategy = 'rebuild') as rb, count(*) as n,
              count(*) filter (verdict = 'COMPLETE') as done, max(model_weight_delta) as delta, max(1 - retained_count / expected_retained_count::double) as loss
              from {measurements} group by seed"""
    },
)
def paired_speedup(spark, sf):
    return rounded(O.paired_summary(table(spark, sf, "measurements"), REPLICATES, SEED))


_ATTACKS = ["lira", "energy", "margin", "nearest"]
_sql, _ctes = _duck_mean_ci("differences", ["metric"], "seed", "difference")


@query(
    "paired_attack_differences",
    _sql,
    {
        "attack_long": "select * from (unpivot {attack_trials} on lira, energy, margin, nearest into name metric value value)",
        "differences": """select a.seed, a.metric, a.value - b.value as difference from {attack_long} a join {attack_long} b
             using (seed, subject, metric) where a.method = 'selective' and b.method = 'exact'""",
        **_ctes,
    },
)
def paired_attack_differences(spark, sf):
    trials = table(spark, sf, "attack_trials")
    return rounded(O.paired_differences(trials, ["seed", "subject"], _ATTACKS, "selective", "exact", REPLICATES, SEED))


_sql, _ctes = _duck_mean_ci("attack_long", ["method", "metric"], "seed", "value")
_SUMMARY_CTES = {
    "attack_long": "select * from (unpivot {attack_trials} on lira, energy, margin, nearest into name metric value value)",
    **_ctes,
    "summary": """select c.*, round(s.std, 6) as std from {mean_ci} c join (select method, metric, stddev_samp(value) as std from {attack_long} group by all) s using (method, metric)""",
}


@query("metric_summary", "select * from {summary}", _SUMMARY_CTES)
def metric_summary(spark, sf):
    return rounded(O.metric_summary(table(spark, sf, "attack_trials"), "seed", _ATTACKS, REPLICATES, SEED))


@query(
    "endpoint_ratios",
    """select round(cl / greatest(sl, 1e-12), 6) as lira_ratio_to_stale, round(abs(ce - xe), 6) as energy_gap_to_exact, round(se - xe, 6) as energy_stale_minus_exact from (
         select avg(lira) filter (method = 'selective') as cl, avg(lira) filter (method = 'stale') as sl, avg(energy) filter (method = 'selective') as ce,
           avg(energy) filter (method = 'exact') as xe, avg(energy) filter (method = 'stale') as se from {attack_trials})""",
)
def endpoint_ratios(spark, sf):
    summary = O.unpivot(table(spark, sf, "attack_trials"), ["method"], _ATTACKS).groupBy("method", "metric").agg(
        F.avg("value").alias("mean")
    )
    return rounded(O.endpoints(summary, "selective", "exact", "stale", ["lira"], ["energy"]))


_LOSS_GATES = [
    ("target_memorization", "target_memorization_gain", ">=", 0.5),
    ("exact_reference_forgets", "exact_forgetting_lift", ">=", 0.3),
    ("candidate_recovers_exact_effect", "candidate_exact_normalized_recovery", ">=", 0.7),
    ("candidate_does_not_overscrub", "candidate_exact_normalized_recovery", "<=", 1.3),
    ("candidate_matches_exact_forget", "candidate_exact_forget_nll_gap", "<=", 0.25),
    ("candidate_matches_exact_perturbed", "candidate_exact_perturbed_nll_gap", "<=", 0.25),
    ("candidate_preserves_retain", "candidate_exact_retain_nll_gap", "<=", 0.1),
    ("candidate_matches_exact_membership", "candidate_exact_mia_auc_gap", "<=", 0.02),
    ("candidate_preserves_world_utility", "candidate_world_utility_nll_degradation", "<=", 0.1),
    ("candidate_survives_reload_without_recurrence", "retained_recurrence_after_reload", "<=", 0.01),
]
_UNLEARNING = """
    select m.*, a.exact_mia_auc, a.candidate_mia_auc, abs(a.candidate_mia_auc - a.exact_mia_auc) as candidate_exact_mia_auc_gap,
      case when exact_forgetting_lift > 0 then candidate_forgetting_lift / exact_forgetting_lift end as candidate_exact_normalized_recovery
    from (select trial, {avg} from {{model_losses}} group by trial) m join (
      select trial, max(auc) filter (model = 'exact') as exact_mia_auc, max(auc) filter (model = 'candidate') as candidate_mia_auc from {{loss_auc}} group by trial) a using (trial)
"""


def _avg(model: str, channel: str) -> str:
    return f"avg(nll) filter (model = '{model}' and channel = '{channel}')"


_UNLEARNING = _UNLEARNING.replace(
    "{avg}",
    f"""{_avg('base', 'forget')} - {_avg('target', 'forget')} as target_memorization_gain,
    {_avg('exact', 'forget')} - {_avg('target', 'forget')} as exact_forgetting_lift,
    {_avg('candidate', 'forget')} - {_avg('target', 'forget')} as candidate_forgetting_lift,
    abs({_avg('candidate', 'forget')} - {_avg('exact', 'forget')}) as candidate_exact_forget_nll_gap,
    abs({_avg('candidate', 'forget_perturbed')} - {_avg('exact', 'forget_perturbed')}) as candidate_exact_perturbed_nll_gap,
    abs({_avg('candidate', 'retain')} - {_avg('exact', 'retain')}) as candidate_exact_retain_nll_gap,
    {_avg('candidate', 'world_facts')} - {_avg('target', 'world_facts')} as candidate_world_utility_nll_degradation,
    abs({_avg('candidate_reloaded', 'forget')} - {_avg('candidate', 'forget')}) as retained_recurrence_after_reload""",
).replace("{{", "{").replace("}}", "}")
_AUC_BY = """
    select {by}, sum(members * (cum_others - others + others / 2.0)) / (sum(members) * sum(others))::double as auc,
      sum(members)::bigint as members, sum(others)::bigint as others from (
      select *, sum(others) over (partition by {by} order by score rows unbounded preceding) as cum_others from (
        select {by}, score, count(*) filter (is_member) as members, count(*) filter (not is_member) as others from {source} group by {by}, score))
    group by {by}
"""


def duck_auc(by: str, source: str) -> str:
    return _AUC_BY.replace("{by}", by).replace("{source}", "{" + source + "}")


LOSS_CTES = {
    "loss_scores": """select trial, model, round(-nll, 9) as score, channel = 'forget' as is_member from {model_losses}
        where channel in ('forget', 'holdout') and model in ('exact', 'candidate')""",
    "loss_auc": duck_auc("trial, model", "loss_scores"),
    "unlearning": _UNLEARNING,
}


def unlearning_metrics(spark, sf):
    losses = table(spark, sf, "model_losses")
    scores = losses.where("channel in ('forget', 'holdout') and model in ('exact', 'candidate')").select(
        "trial", "model", F.round(-F.col("nll"), 9).alias("score"), (F.col("channel") == "forget").alias("is_member")
    )
    return O.score_unlearning(losses, M.roc_auc(scores, ["trial", "model"]))


def _rounded_star(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 6) as {c}" for c in columns)


_LOSS_METRICS = [
    "target_memorization_gain",
    "exact_forgetting_lift",
    "candidate_forgetting_lift",
    "candidate_exact_forget_nll_gap",
    "candidate_exact_perturbed_nll_gap",
    "candidate_exact_retain_nll_gap",
    "candidate_world_utility_nll_degradation",
    "retained_recurrence_after_reload",
    "exact_mia_auc",
    "candidate_mia_auc",
    "candidate_exact_mia_auc_gap",
    "candidate_exact_normalized_recovery",
]


@query("unlearning_metrics", f"select trial, {_rounded_star(_LOSS_METRICS)} from {{unlearning}}", LOSS_CTES)
def unlearning_query(spark, sf):
    return rounded(unlearning_metrics(spark, sf))


_WORST = "select " + ", ".join(
    f"{'min' if op == '>=' else 'max'}({m}) as {g}" for g, m, op, _ in _LOSS_GATES
) + " from {unlearning}"


@query(
    "unlearning_gates",
    duck_gates("{worst}", [(g, g, op, b) for g, _, op, b in _LOSS_GATES]),
    {**LOSS_CTES, "worst": _WORST},
)
def unlearning_gates(spark, sf):
    return rounded(O.gate_trials(unlearning_metrics(spark, sf), _LOSS_GATES))


@query(
    "unlearning_metric_ranges",
    "select metric, round(min(value), 6) as min, round(avg(value), 6) as mean, round(max(value), 6) as max from "
    f"(unpivot {{unlearning}} on {', '.join(_LOSS_METRICS)} into name metric value value) group by metric",
    LOSS_CTES,
)
def unlearning_metric_ranges(spark, sf):
    long = O.unpivot(unlearning_metrics(spark, sf), ["trial"], _LOSS_METRICS)
    return rounded(
        long.groupBy("metric").agg(F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max"))
    )


_MARGIN_SQL = " union all ".join(
    f"select trial, '{g}' as gate, round(({m} - {b}) * {1 if op == '>=' else -1} / {max(abs(b), 1e-12)}, 6) as margin from {{unlearning}}"
    for g, m, op, b in _LOSS_GATES
)


@query("gate_margins", f"select trial, gate, margin + 0.0 as margin from ({_MARGIN_SQL})", LOSS_CTES)
def gate_margins(spark, sf):
    return rounded(O.gate_margins(unlearning_metrics(spark, sf), _LOSS_GATES, ["trial"]))


_GAPS = {"candidate_exact_perturbed_nll_gap": 0.25, "candidate_exact_retain_nll_gap": 0.1, "candidate_exact_mia_auc_gap": 0.02}


@query(
    "path_point_summary",
    """select path, round(minimum_margin, 6) as minimum_margin, minimum_speedup, round(worst_exact_gap, 6) as worst_exact_gap, minimum_margin >= 0 as feasible
       from (select trial % 4 as path, min(margin) as minimum_margin from {margins} group by 1) join (
         select trial % 4 as path, min(1.0 + trial) as minimum_speedup,
           max(greatest(candidate_exact_perturbed_nll_gap / 0.25, candidate_exact_retain_nll_gap / 0.1, candidate_exact_mia_auc_gap / 0.02)) as worst_exact_gap
         from {unlearning} group by 1) using (path)""",
    {**LOSS_CTES, "margins": _MARGIN_SQL},
)
def path_point_summary(spark, sf):
    trials = unlearning_metrics(spark, sf).withColumns(
        {"path": F.col("trial") % 4, "speedup": (1.0 + F.col("trial")).cast("double")}
    )
    return rounded(O.path_points(trials, _LOSS_GATES, ["path"], "speedup", _GAPS))


@query(
    "candidate_selection",
    """select candidate_id, round(violation, 6) as violation from (
         select candidate_id, greatest(0.0, 0.9 - recovery_min) / 0.9 + greatest(0.0, world_max - 0.02) / 0.02 + greatest(0.0, author_max - 0.05) / 0.05 as violation
         , recovery_min, world_max, author_max, speedup_min from {candidates})
       order by violation, -recovery_min, greatest(world_max, author_max), -speedup_min, candidate_id limit 1""",
    {
        "candidates": """select 'n' || c_nationkey as candidate_id, min((c_custkey % 50) / 100.0 + 0.6) as recovery_min, max(c_acctbal) / 300000 as world_max,
            max(c_custkey % 31) / 400.0 as author_max, min(1.0 + c_custkey % 5) as speedup_min from customer group by c_nationkey"""
    },
)
def candidate_selection(spark, sf):
    summaries = table(spark, sf, "customer").groupBy("c_nationkey").agg(
        F.concat(F.lit("n"), F.first("c_nationkey").cast("string")).alias("candidate_id"),
        F.min((F.col("c_custkey") % 50) / 100.0 + 0.6).alias("recovery_min"),
        (F.max("c_acctbal") / 300000).alias("world_max"),
        (F.max(F.col("c_custkey") % 31) / 400.0).alias("author_max"),
        F.min(1.0 + F.col("c_custkey") % 5).alias("speedup_min"),
    )
    return rounded(O.select_candidate(summaries, 0.9, 0.02, 0.05))


_SEQ_GATES = [
    ("retained_accuracy_delta", "retained_accuracy_delta", ">=", -0.01),
    ("forgotten_auc_gap", "forgotten_auc_gap", "<=", 0.9),
    ("max_privacy_upper_ci", "max_privacy_upper_ci", "<=", 0.02),
]
_sql, _ctes = _duck_mean_ci("differences", ["metric"], "seed", "difference")


@query(
    "release_sequence_gates",
    duck_gates("{sequence_row}", [("all_deleted_absent", "all_deleted_absent", "==", 1.0), *[(g, g, op, b) for g, _, op, b in _SEQ_GATES]]),
    {
        "attack_long": "select * from (unpivot {attack_trials} on lira, energy, margin, nearest into name metric value value)",
        "differences": """select a.seed, a.metric, a.value - b.value as difference from {attack_long} a join {attack_long} b
             using (seed, subject, metric) where a.method = 'selective' and b.method = 'exact'""",
        **_ctes,
        "sequence_row": """select bool_and(o_orderkey % 983 <> 977)::int as all_deleted_absent, min(o_custkey % 7 / 1000.0 - 0.004) as retained_accuracy_delta,
             max(o_orderkey % 61 / 100.0) as forgotten_auc_gap, (select max(high) from {mean_ci}) as max_privacy_upper_ci from orders""",
    },
)
def release_sequence_gates(spark, sf):
    steps = table(spark, sf, "orders").select(
        (F.col("o_orderkey") % 983 != 977).alias("deleted_class_absent"),
        (F.col("o_custkey") % 7 / 1000.0 - 0.004).alias("retained_accuracy_delta"),
        (F.col("o_orderkey") % 61 / 100.0).alias("forgotten_auc_gap"),
    )
    trials = table(spark, sf, "attack_trials")
    privacy = O.paired_differences(trials, ["seed", "subject"], _ATTACKS, "selective", "exact", REPLICATES, SEED)
    return rounded(O.sequence_gates(steps, _SEQ_GATES, privacy))


@query(
    "reconcile_results",
    """select seed, metric, case when l is null then 'missing left' when r is null then 'missing right'
         when abs(l - r) <= greatest(1e-6 * greatest(abs(l), abs(r)), 1e-9) then 'equal' else 'different' end as outcome, round(abs(l - r), 6) as difference
       from (select seed, metric, value as l from {attack_long} where method = 'exact') full join
            (select seed, metric, value + case when seed % 401 = 3 then 0.5 else 0 end as r from {attack_long} where method = 'exact' and seed % 307 <> 5) using (seed, metric)""",
    {"attack_long": "select * from (unpivot {attack_trials} on lira, energy, margin, nearest into name metric value value)"},
)
def reconcile_results(spark, sf):
    exact = O.unpivot(table(spark, sf, "attack_trials").where("method = 'exact'"), ["seed"], _ATTACKS)
    published = exact.where("seed % 307 <> 5").withColumn(
        "value", F.col("value") + F.when(F.col("seed") % 401 == 3, 0.5).otherwise(0.0)
    )
    return rounded(O.reconcile(exact, published, ["seed", "metric"], 1e-6, 1e-9))


_SWEEP = """select o_custkey as subject, o_custkey % 9 <> 4 as passed, 0.8 + o_custkey % 13 / 100.0 as exact_accuracy,
    (o_custkey % 7 - 3) / 100.0 as accuracy_delta, o_custkey % 101 / 101.0 as stale_probability from (select distinct o_custkey from orders)"""


def _sweep(spark, sf):
    return table(spark, sf, "orders").select("o_custkey").distinct().select(
        F.col("o_custkey").alias("subject"),
        (F.col("o_custkey") % 9 != 4).alias("passed"),
        (0.8 + F.col("o_custkey") % 13 / 100.0).alias("exact_accuracy"),
        ((F.col("o_custkey") % 7 - 3) / 100.0).alias("accuracy_delta"),
        (F.col("o_custkey") % 101 / 101.0).alias("stale_probability"),
    )


@query(
    "subject_sweep",
    """select count(*) as subjects, count(*) filter (passed) as passed_subjects, round(avg(exact_accuracy), 6) as exact_accuracy_mean,
         round(min(exact_accuracy), 6) as exact_accuracy_min, round(avg(accuracy_delta), 6) as accuracy_delta_mean, round(min(accuracy_delta), 6) as accuracy_delta_min,
         round(max(stale_probability), 6) as stale_probability_max, round(quantile_cont(stale_probability, 0.5), 6) as stale_probability_median,
         round(min(stale_probability), 6) as stale_probability_min from {sweep}""",
    {"sweep": _SWEEP},
)
def subject_sweep(spark, sf):
    return rounded(O.sweep_summary(_sweep(spark, sf)))


@query("sweep_failed_subjects", "select subject from {sweep} where not passed", {"sweep": _SWEEP})
def sweep_failed_subjects(spark, sf):
    return O.failed_subjects(_sweep(spark, sf))


@query(
    "token_contrast",
    """select token, forget_count, utility_count, round(contrast, 6) as contrast, position from (
         select *, row_number() over (order by contrast desc, forget_count desc, token) as position, count(*) over () as n from (
           select f.token, f.n as forget_count, coalesce(u.n, 0) as utility_count, f.n / (coalesce(u.n, 0) + 1.0) as contrast
           from (select token, count(*) as n from {words} where forget group by token having count(*) >= 3) f left join
                (select token, count(*) as n from {words} where not forget group by token) u on f.token = u.token))
       where position <= greatest(1, ceil(n * 0.05))""",
    {
        "words": """select * from (select toxic = 1 as forget, unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\x0B]+')) as token from documents join labels using (doc_id)) where token <> ''""",
    },
)
def token_contrast(spark, sf):
    labelled = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels"), "doc_id")
    return rounded(O.token_contrast(labelled.where("toxic = 1"), labelled.where("toxic <> 1"), 3, 0.05))


_FAMILIES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_TRANSFER = """select case_id, family, case when case_id % 4 = 0 then 'none' when case_id % 4 = 1 then 'coverage_fault' when case_id % 4 = 2 then 'derivative' else 'recovery' end as fault_state,
    case when fault_state = 'none' then 'COMPLETE' when fault_state = 'coverage_fault' then 'UNVERIFIED' else 'INCOMPLETE' end as truth, case when case_id % 211 = 5 then 'COMPLETE' else truth end as full_verdict,
    case_id % 3 <> 0 as native_complete, case_id % 5 <> 0 as typed_complete, case_id % 331 = 2 as post_control_recurrence, case_id % 337 = 2 as retained_loss,
    case_id % 347 <> 2 as oracle_match, case when case_id % 353 = 2 then 'bb' else 'aa' end as core_sha256, case_id % 359 <> 2 as process_observed from {trials} where method = 'graph'"""
_TRANSFER_GATES = [
    ("case_count", "case_count", ">=", 10),
    ("family_count", "family_count", "==", 5),
    ("false_complete", "false_complete", "<=", 0),
    ("coverage_fail_closed", "coverage_fail_closed", ">=", 1),
    ("post_control_recurrence", "post_control_recurrence", "<=", 0),
    ("retained_loss", "retained_loss", "<=", 0),
    ("native_false_complete_each_family", "native_false_complete_min", ">=", 1),
    ("specificity_drop", "specificity_drop", "<=", 0.05),
    ("oracle_mismatch", "oracle_mismatch", "<=", 0),
    ("core_diff", "core_diff", "<=", 0),
    ("process_observed", "unobserved_process", "==", 0),
]


def transfer_records(spark, sf):
    k = F.col("case_id")
    fault = F.when(k % 4 == 0, "none").when(k % 4 == 1, "coverage_fault").when(k % 4 == 2, "derivative").otherwise("recovery")
    base = table(spark, sf, "trials").where("method = 'graph'").select("case_id", "family", fault.alias("fault_state"))
    truth = (
        F.when(F.col("fault_state") == "none", "COMPLETE")
        .when(F.col("fault_state") == "coverage_fault", "UNVERIFIED")
        .otherwise("INCOMPLETE")
    )
    return base.withColumn("truth", truth).select(
        "*",
        F.when(k % 211 == 5, "COMPLETE").otherwise(F.col("truth")).alias("full_verdict"),
        (k % 3 != 0).alias("native_complete"),
        (k % 5 != 0).alias("typed_complete"),
        (k % 331 == 2).alias("post_control_recurrence"),
        (k % 337 == 2).alias("retained_loss"),
        (k % 347 != 2).alias("oracle_match"),
        F.when(k % 353 == 2, "bb").otherwise("aa").alias("core_sha256"),
        (k % 359 != 2).alias("process_observed"),
    )


@query(
    "transfer_gates",
    duck_gates("{transfer_row}", _TRANSFER_GATES),
    {
        "transfer": _TRANSFER,
        "transfer_row": """select count(*) as case_count, count(distinct family) as family_count, count(*) filter (truth <> 'COMPLETE' and full_verdict = 'COMPLETE') as false_complete,
            count(*) filter (fault_state = 'coverage_fault' and full_verdict = 'UNVERIFIED') as coverage_fail_closed, count(*) filter (post_control_recurrence) as post_control_recurrence,
            count(*) filter (retained_loss) as retained_loss, (select min(n) from (select count(*) filter (native_complete and truth <> 'COMPLETE') as n from {transfer} group by family)) as native_false_complete_min,
            greatest(0.0, count(*) filter (truth = 'COMPLETE' and typed_complete) / count(*) filter (truth = 'COMPLETE')::double - count(*) filter (truth = 'COMPLETE' and full_verdict = 'COMPLETE') / count(*) filter (truth = 'COMPLETE')::double) as specificity_drop,
            count(*) filter (not oracle_match) as oracle_mismatch, count(*) filter (core_sha256 <> 'aa') as core_diff, count(*) filter (not process_observed) as unobserved_process from {transfer}""",
    },
)
def transfer_gates(spark, sf):
    return rounded(O.gate_rows(O.transfer_summary(transfer_records(spark, sf), _FAMILIES, "aa"), _TRANSFER_GATES))


@query(
    "safe_policy",
    """select family, case when ok then 'selective' else 'rebuild' end as selected_method, case when ok then 'CANDIDATE_ACCEPTED' else 'SAFE_FALLBACK' end as decision from (
         select family, bool_and(r) as ok from (select r_name as family, avg(c_acctbal) <= 4600 and avg(c_custkey % 10 / 100.0) <= 0.046 as r
           from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by r_name) group by family)""",
)
def safe_policy(spark, sf):
    joined = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
        .join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    )
    evidence = joined.groupBy(F.col("r_name").alias("family")).agg(
        F.avg("c_acctbal").alias("balance"), F.avg(F.col("c_custkey") % 10 / 100.0).alias("share")
    )
    gates = [("balance", "balance", "<=", 4600.0), ("share", "share", "<=", 0.046)]
    return O.safe_policy(evidence, gates, "selective", "rebuild")
