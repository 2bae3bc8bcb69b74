"""Benchmark, privacy and unlearning statistics over trial tables."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceless.functions.statistics import (
    linear_quantile,
    mix,
    nearest_rank,
    poisson_weight,
    ratio,
    scramble,
    wilson95,
)
from traceless.operators.ranking import exact_percentile
from traceless.plans.workspace import Stored

Gate = tuple[str, str, str, float]  # gate name, metric column, "<=" / ">=" / "==", threshold


def _passes(value: Column, op: str, threshold: float) -> Column:
    bound = F.lit(float(threshold))
    test = {"<=": value <= bound, ">=": value >= bound, "==": value == bound}[op]
    return F.coalesce(test, F.lit(False))


def gate_rows(df: DataFrame, gates: Sequence[Gate], keep: Sequence[str] = ()) -> DataFrame:
    """One row per gate with its observed value; a missing value fails."""
    rows = [
        F.struct(
            F.lit(name).alias("gate"),
            F.col(metric).cast("double").alias("observed"),
            F.lit(float(bound)).alias("threshold"),
            _passes(F.col(metric).cast("double"), op, bound).alias("passed"),
        )
        for name, metric, op, bound in gates
    ]
    return df.select(*keep, F.inline(F.array(*rows)))


def gate_decision(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """PASS when every gate of a group holds."""
    return rows.groupBy(*keep).agg(
        F.when(F.bool_and("passed"), "PASS").otherwise("FAIL").alias("decision"),
        F.count_if(~F.col("passed")).alias("failed_gates"),
    )


# --- confusion reports -------------------------------------------------------


def _cells() -> dict[str, Column]:
    truth, declared = F.col("truth_positive"), F.col("declared_complete")
    return {
        "true_positive": truth & ~declared,
        "false_negative": truth & declared,
        "true_negative": ~truth & declared,
        "false_positive": ~truth & ~declared,
    }


def _rates() -> dict[str, Column]:
    tp, fn = F.col("true_positive"), F.col("false_negative")
    tn, fp = F.col("true_negative"), F.col("false_positive")
    return {
        "false_complete_rate": ratio(fn, tp + fn),
        "recall": ratio(tp, tp + fn),
        "precision": ratio(tp, tp + fp),
        "false_alarm_rate": ratio(fp, fp + tn),
        "exact_node_recall": ratio(F.col("found_nodes"), F.col("truth_nodes")),
    }


def _node_counts(trials: DataFrame) -> DataFrame:
    """Distinct true artifacts and how many of them were found; null arrays count as empty."""
    truth = F.array_distinct("truth_ids")
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return trials.withColumns({"n_truth": size(truth), "n_found": size(F.array_intersect(truth, "detected_ids"))})


def outcome_report(trials: DataFrame, by: Sequence[str]) -> DataFrame:
    """Confusion counts and rates per group; a positive trial has a residual."""
    counts = [F.count_if(test).alias(name) for name, test in _cells().items()]
    report = (
        _node_counts(trials)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("trials"),
            *counts,
            F.sum("n_truth").alias("truth_nodes"),
            F.sum("n_found").alias("found_nodes"),
            F.avg("runtime_ms").alias("mean_runtime_ms"),
            F.avg("cost").alias("mean_cost"),
        )
        .withColumn("positive_trials", F.col("true_positive") + F.col("false_negative"))
    )
    return report.withColumns(_rates()).drop("truth_nodes", "found_nodes")


def resampled(df: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """Each row once per replicate with its Poisson(1) weight ``w``.

    Weights come from a hash of (seed, replicate, key), so no draw table is
    shuffled: replicates are formed by the map side of the following aggregate.
    """
    copies = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    # One column per step: the optimizer keeps them apart, so no step is computed twice.
    staged = copies.withColumn("_mixed", mix(F.lit(seed), F.col("replicate"), F.col(key)))
    for _ in range(2):
        staged = staged.withColumn("_mixed", scramble(F.col("_mixed")))
    staged = staged.withColumn("_uniform", F.pmod("_mixed", F.lit(1_000_000)))
    return staged.withColumn("w", poisson_weight(F.col("_uniform"))).drop("_mixed", "_uniform")


def bootstrap_outcomes(
    trials: DataFrame, by: Sequence[str], key: str, replicates: int, seed: int
) -> DataFrame:
    """Nearest-rank 95 % resampling interval of every outcome rate."""
    cells = _cells()
    narrow = _node_counts(trials).select(*by, key, "truth_positive", "declared_complete", "n_truth", "n_found")
    sums = (
        resampled(narrow, key, replicates, seed)
        .groupBy(*by, "replicate")
        .agg(
            *[F.sum(F.when(test, F.col("w")).otherwise(0)).alias(name) for name, test in cells.items()],
            F.sum(F.col("w") * F.col("n_truth")).alias("truth_nodes"),
            F.sum(F.col("w") * F.col("n_found")).alias("found_nodes"),
        )
    )
    rates = _rates()
    long = sums.select(
        *by,
        F.inline(
            F.array(*[F.struct(F.lit(n).alias("metric"), c.alias("estimate")) for n, c in rates.items()])
        ),
    )
    values = long.groupBy(*by, "metric").agg(F.collect_list("estimate").alias("estimates"))
    return values.select(
        *by,
        "metric",
        nearest_rank(F.col("estimates"), 0.025).alias("low"),
        nearest_rank(F.col("estimates"), 0.975).alias("high"),
    )


def bootstrap_mean(
    df: DataFrame, by: Sequence[str], key: str, value: str, replicates: int, seed: int, confidence: float = 0.95
) -> DataFrame:
    """Mean and linearly interpolated resampling interval per group."""
    tail = (1 - confidence) / 2
    point = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    means = (
        resampled(df.select(*by, key, value), key, replicates, seed)
        .groupBy(*by, "replicate")
        .agg(F.try_divide(F.sum(F.col("w") * F.col(value)), F.sum("w")).alias("m"))
        .groupBy(*by)
        .agg(F.collect_list("m").alias("ms"))
    )
    joined = point.join(means, list(by)) if by else point.crossJoin(means)
    return joined.select(
        *by,
        "n",
        "mean",
        linear_quantile(F.col("ms"), tail).alias("low"),
        linear_quantile(F.col("ms"), 1 - tail).alias("high"),
    )


# --- verdict benchmarks ------------------------------------------------------


def benchmark_metrics(records: DataFrame, by: Sequence[str] = ("task", "method")) -> DataFrame:
    """False completes, recall and Wilson interval per group of verdict records."""
    open_truth = F.col("truth_verdict") != "COMPLETE"
    said = F.col("verdict") == "COMPLETE"
    counts = records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trials"),
        F.count_if(open_truth).alias("truth_noncomplete"),
        F.count_if(open_truth & said).alias("false_complete"),
        F.count_if(open_truth & ~said).alias("detected_noncomplete"),
        F.avg("cost").alias("mean_cost"),
    )
    interval = wilson95(F.col("false_complete"), F.col("truth_noncomplete"))
    return counts.select(
        "*",
        ratio(F.col("false_complete"), F.col("truth_noncomplete")).alias("false_complete_rate"),
        ratio(F.col("detected_noncomplete"), F.col("truth_noncomplete")).alias("noncomplete_recall"),
        interval["low"].alias("wilson_low"),
        interval["high"].alias("wilson_high"),
    )


def score_holdout(records: DataFrame, max_upper: float = 0.05) -> DataFrame:
    """Scores per method and family, with the pass rule; the total has a null family."""
    open_truth = F.col("truth_verdict") != "COMPLETE"
    said = F.col("verdict") == "COMPLETE"
    counts = records.rollup("method", "family").agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("trials"),
        F.count_if(open_truth).alias("noncomplete"),
        F.count_if(open_truth & said).alias("false_complete"),
        F.count_if(~open_truth & said).alias("true_complete"),
        F.count_if(F.col("exception") != "").alias("exceptions"),
    )
    upper = wilson95(F.col("false_complete"), F.col("noncomplete"))["high"]
    passed = (
        (F.col("false_complete") == 0)
        & F.coalesce(upper <= max_upper, F.lit(False))
        & (F.col("exceptions") == 0)
    )
    return counts.where(F.col("level") < 3).select(
        "method",
        "family",
        "trials",
        "noncomplete",
        "false_complete",
        "exceptions",
        (F.col("noncomplete") - F.col("false_complete")).alias("detected_noncomplete"),
        ratio(F.col("false_complete"), F.col("noncomplete")).alias("false_complete_rate"),
        ratio(F.col("true_complete"), F.col("trials") - F.col("noncomplete")).alias("specificity"),
        upper.alias("wilson_high"),
        F.when(passed, "PASS").otherwise("FAIL").alias("decision"),
    )


def missing_records(records: DataFrame) -> DataFrame:
    """(case, method) pairs that are absent or recorded more than once."""
    methods = records.select("method").distinct()
    expected = records.select("case_id").distinct().crossJoin(methods)
    seen = records.groupBy("case_id", "method").count()
    return (
        expected.join(seen, ["case_id", "method"], "left")
        .select("case_id", "method", F.coalesce("count", F.lit(0)).alias("records"))
        .where(F.col("records") != 1)
    )


def score_predictions(predictions: DataFrame, truth: DataFrame, gates: Sequence[Gate]) -> DataFrame:
    """Blind predictions against truth: accuracy, exact paths, false completes, gates."""
    joined = predictions.join(truth, "case_id")
    open_truth = F.col("truth_verdict") != "COMPLETE"
    has_path = F.col("expected_path").isNotNull()
    counts = joined.agg(
        F.count(F.lit(1)).alias("case_count"),
        F.countDistinct("family").alias("distinct_families"),
        F.count_if(open_truth).alias("noncomplete_count"),
        F.count_if(open_truth & (F.col("verdict") == "COMPLETE")).alias("false_complete"),
        F.avg((F.col("verdict") == F.col("truth_verdict")).cast("double")).alias("verdict_accuracy"),
        ratio(
            F.count_if(has_path & F.col("expected_path").eqNullSafe(F.col("shortest_path"))), F.count_if(has_path)
        ).alias("exact_path_rate"),
    )
    upper = wilson95(F.col("false_complete"), F.col("noncomplete_count"))["high"]
    return gate_rows(counts.withColumn("false_complete_wilson95_upper", upper), gates)


def score_survey(answers: DataFrame, gold: DataFrame, endpoints: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Accuracy per endpoint with Wilson interval; ``endpoints`` maps to (answer, gold) columns."""
    joined = answers.join(gold, "card_id")
    pairs = [
        F.struct(
            F.lit(name).alias("endpoint"), F.coalesce(F.col(a) == F.col(g), F.lit(False)).alias("right")
        )
        for name, (a, g) in endpoints.items()
    ]
    counts = (
        joined.select(F.inline(F.array(*pairs)))
        .groupBy("endpoint")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("right")).alias("correct"))
    )
    interval = wilson95(F.col("correct"), F.col("total"))
    return counts.select(
        "*",
        ratio(F.col("correct"), F.col("total")).alias("accuracy"),
        interval["low"].alias("wilson_low"),
        interval["high"].alias("wilson_high"),
    )


def survey_decision(
    scores: DataFrame, answers: DataFrame, min_participants: int = 10, min_accuracy: float = 0.8
) -> DataFrame:
    """Sample size, median time in seconds and the overall decision."""
    median = exact_percentile(answers, [], "completion_ms", 0.5, "median")
    people = answers.agg(F.countDistinct("participant_id").alias("participants")).crossJoin(
        F.broadcast(median.select((F.col("median") / 1000.0).alias("median_seconds")))
    )
    lowest = scores.agg(F.min("accuracy").alias("lowest"))
    return people.crossJoin(F.broadcast(lowest)).select(
        "participants",
        "median_seconds",
        F.when(F.col("participants") < min_participants, "INSUFFICIENT_SAMPLE")
        .when(F.col("lowest") >= min_accuracy, "PASS")
        .otherwise("FAIL")
        .alias("decision"),
    )


# --- paired measurements -----------------------------------------------------


def paired_summary(measurements: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Speed-up of the targeted over the rebuild strategy, bytes saved, losses."""
    pairs = measurements.groupBy("seed").agg(
        F.max(F.when(F.col("strategy") == "targeted", F.col("seconds"))).alias("fast"),
        F.max(F.when(F.col("strategy") == "rebuild", F.col("seconds"))).alias("slow"),
        F.sum(F.when(F.col("strategy") == "targeted", F.col("bytes_rewritten"))).alias("targeted_bytes"),
        F.sum(F.when(F.col("strategy") == "rebuild", F.col("bytes_rewritten"))).alias("rebuild_bytes"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("verdict") == "COMPLETE").alias("complete"),
        F.max("model_weight_delta").alias("delta"),
        F.max(1 - F.col("retained_count") / F.col("expected_retained_count")).alias("loss"),
    )
    pairs = pairs.withColumn("log_ratio", F.ln(F.col("slow") / F.col("fast")))
    total = pairs.agg(
        F.count_if(F.col("fast").isNull() | F.col("slow").isNull() | (F.col("rows") != 2)).alias("broken_pairs"),
        F.count(F.lit(1)).alias("pairs"),
        F.exp(F.avg("log_ratio")).alias("geometric_mean"),
        F.sum("targeted_bytes").alias("targeted_bytes"),
        F.sum("rebuild_bytes").alias("rebuild_bytes"),
        (F.sum("complete") / F.sum("rows")).alias("complete_rate"),
        F.max("delta").alias("maximum_model_weight_delta"),
        F.max("loss").alias("maximum_retained_loss_rate"),
    )
    means = (
        resampled(pairs.select("seed", "log_ratio"), "seed", replicates, seed)
        .groupBy("replicate")
        .agg(F.exp(F.try_divide(F.sum(F.col("w") * F.col("log_ratio")), F.sum("w"))).alias("m"))
        .agg(F.array_sort(F.collect_list("m")).alias("ms"))
    )

    def at(p: float) -> Column:
        return F.element_at("ms", F.floor(p * (F.size("ms") - 1)).cast("int") + 1)

    return total.crossJoin(F.broadcast(means)).select(
        *total.columns,
        (1 - ratio(F.col("targeted_bytes"), F.col("rebuild_bytes"))).alias("bytes_reduction"),
        at(0.025).alias("low"),
        at(0.975).alias("high"),
    )


def unpivot(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.unpivot(list(keys), list(metrics), "metric", "value")


def paired_differences(
    trials: DataFrame, keys: Sequence[str], attacks: Sequence[str], method: str, reference: str, replicates: int, seed: int
) -> DataFrame:
    """Mean difference to the exact reference per attack, with interval."""
    both = trials.where(F.col("method").isin(method, reference))
    sided = unpivot(both, [*keys, "method"], attacks).groupBy(*keys, "metric").agg(
        F.max(F.when(F.col("method") == method, F.col("value"))).alias("a"),
        F.max(F.when(F.col("method") == reference, F.col("value"))).alias("b"),
    )
    differences = sided.where(F.col("a").isNotNull()).select(
        *keys, "metric", (F.col("a") - F.col("b")).alias("difference")
    )
    return bootstrap_mean(differences, ["metric"], keys[0], "difference", replicates, seed)


def metric_summary(
    trials: DataFrame, key: str, metrics: Sequence[str], replicates: int, seed: int
) -> DataFrame:
    """Mean, sample deviation and interval per (method, metric)."""
    long = unpivot(trials, ["method", key], metrics)
    spread = long.groupBy("method", "metric").agg(F.stddev_samp("value").alias("std"))
    return bootstrap_mean(long, ["method", "metric"], key, "value", replicates, seed).join(
        spread, ["method", "metric"]
    )


def endpoints(
    summary: DataFrame, candidate: str, exact: str, stale: str, ratios: Sequence[str], gaps: Sequence[str]
) -> DataFrame:
    """Candidate means relative to the stale model and as gaps to the exact one, in one row."""

    def mean_of(method: str, metric: str) -> Column:
        hit = (F.col("method") == method) & (F.col("metric") == metric)
        return F.max(F.when(hit, F.col("mean")))

    return summary.agg(
        *[
            (mean_of(candidate, m) / F.greatest(mean_of(stale, m), F.lit(1e-12))).alias(f"{m}_ratio_to_stale")
            for m in ratios
        ],
        *[F.abs(mean_of(candidate, m) - mean_of(exact, m)).alias(f"{m}_gap_to_exact") for m in gaps],
        *[(mean_of(stale, m) - mean_of(exact, m)).alias(f"{m}_stale_minus_exact") for m in gaps],
    )


# --- unlearning losses -------------------------------------------------------


def score_unlearning(losses: DataFrame, auc: DataFrame) -> DataFrame:
    """Lifts, gaps and membership AUC per trial; ``auc`` holds (trial, model, auc)."""

    def mean_of(model: str, channel: str) -> Column:
        hit = (F.col("model") == model) & (F.col("channel") == channel)
        return F.avg(F.when(hit, F.col("nll")))

    means = losses.groupBy("trial").agg(
        (mean_of("base", "forget") - mean_of("target", "forget")).alias("target_memorization_gain"),
        (mean_of("exact", "forget") - mean_of("target", "forget")).alias("exact_forgetting_lift"),
        (mean_of("candidate", "forget") - mean_of("target", "forget")).alias("candidate_forgetting_lift"),
        *[
            F.abs(mean_of("candidate", channel) - mean_of("exact", channel)).alias(f"candidate_exact_{name}_nll_gap")
            for name, channel in (("forget", "forget"), ("perturbed", "forget_perturbed"), ("retain", "retain"))
        ],
        (mean_of("candidate", "world_facts") - mean_of("target", "world_facts")).alias(
            "candidate_world_utility_nll_degradation"
        ),
        F.abs(mean_of("candidate_reloaded", "forget") - mean_of("candidate", "forget")).alias(
            "retained_recurrence_after_reload"
        ),
    )
    sides = auc.groupBy("trial").agg(
        F.max(F.when(F.col("model") == "exact", F.col("auc"))).alias("exact_mia_auc"),
        F.max(F.when(F.col("model") == "candidate", F.col("auc"))).alias("candidate_mia_auc"),
    )
    recovery = ratio(F.col("candidate_forgetting_lift"), F.col("exact_forgetting_lift"))
    return means.join(sides, "trial").select(
        "*",
        F.abs(F.col("candidate_mia_auc") - F.col("exact_mia_auc")).alias("candidate_exact_mia_auc_gap"),
        F.when(F.col("exact_forgetting_lift") > 0, recovery).alias("candidate_exact_normalized_recovery"),
    )


def worst_case(trials: DataFrame, gates: Sequence[Gate], keep: Sequence[str] = ()) -> DataFrame:
    """One value per gated metric: the minimum for ``>=`` gates, the maximum for ``<=`` gates."""
    worst = [
        (F.min(metric) if op == ">=" else F.max(metric)).alias(name) for name, metric, op, _ in gates
    ]
    return trials.groupBy(*keep).agg(*worst)


def gate_trials(trials: DataFrame, gates: Sequence[Gate], keep: Sequence[str] = ()) -> DataFrame:
    """Worst-case gates over all trials of a group."""
    renamed = [(name, name, op, bound) for name, _, op, bound in gates]
    return gate_rows(worst_case(trials, gates, keep), renamed, keep)


def summarize_metrics(trials: DataFrame, metrics: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Minimum, mean and maximum of every metric."""
    return (
        unpivot(trials, keep or ["trial"], metrics)
        .groupBy(*keep, "metric")
        .agg(F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max"))
    )


def gate_margins(trials: DataFrame, gates: Sequence[Gate], keys: Sequence[str]) -> DataFrame:
    """Signed margin of every gate, scaled by its threshold; non-negative means passed."""
    rows = []
    for name, metric, op, bound in gates:
        value, scale = F.col(metric).cast("double"), max(abs(bound), 1e-12)
        distance = value - F.lit(float(bound)) if op == ">=" else F.lit(float(bound)) - value
        rows.append(F.struct(F.lit(name).alias("gate"), (distance / F.lit(scale)).alias("margin")))
    return trials.select(*keys, F.inline(F.array(*rows)))


def path_points(
    trials: DataFrame, gates: Sequence[Gate], keys: Sequence[str], speedup: str, gaps: Mapping[str, float]
) -> DataFrame:
    """Smallest margin, smallest speed-up and largest scaled exact gap per path point."""
    smallest = gate_margins(trials, gates, keys).groupBy(*keys).agg(F.min("margin").alias("minimum_margin"))
    scaled = F.greatest(*[F.col(m) / F.lit(max(abs(t), 1e-12)) for m, t in gaps.items()])
    rest = trials.groupBy(*keys).agg(
        F.min(speedup).alias("minimum_speedup"), F.max(scaled).alias("worst_exact_gap")
    )
    return smallest.join(rest, list(keys)).withColumn("feasible", F.col("minimum_margin") >= 0)


def select_candidate(summaries: DataFrame, recovery_min: float, world_max: float, author_max: float) -> DataFrame:
    """Candidate with the smallest scaled violation, then the declared preference order."""

    def over(value: Column, bound: float, sign: int) -> Column:
        excess = (value - bound) if sign > 0 else (F.lit(bound) - value)
        return F.greatest(F.lit(0.0), excess) / F.lit(max(abs(bound), 1e-12))

    violation = (
        over(F.col("recovery_min"), recovery_min, -1)
        + over(F.col("world_max"), world_max, 1)
        + over(F.col("author_max"), author_max, 1)
    )
    key = F.struct(
        violation.alias("violation"),
        (-F.col("recovery_min")).alias("recovery"),
        F.greatest("world_max", "author_max").alias("utility"),
        (-F.col("speedup_min")).alias("speed"),
        "candidate_id",
    )
    return summaries.agg(F.min(key).alias("best")).select("best.candidate_id", "best.violation")


# --- other summaries ---------------------------------------------------------


def reconcile(
    left: DataFrame, right: DataFrame, keys: Sequence[str], relative: float = 1e-10, absolute: float = 1e-12
) -> DataFrame:
    """Rows of two long (keys, value) tables that are missing on a side or not close."""
    a = left.withColumnRenamed("value", "left_value").withColumn("in_left", F.lit(True))
    b = right.withColumnRenamed("value", "right_value").withColumn("in_right", F.lit(True))
    difference = F.abs(F.col("left_value") - F.col("right_value"))
    bound = F.greatest(
        F.lit(relative) * F.greatest(F.abs("left_value"), F.abs("right_value")), F.lit(absolute)
    )
    outcome = (
        F.when(F.col("in_left").isNull(), "missing left")
        .when(F.col("in_right").isNull(), "missing right")
        .when(F.coalesce(difference <= bound, F.lit(False)), "equal")
        .otherwise("different")
    )
    return a.join(b, list(keys), "full_outer").select(
        *keys, outcome.alias("outcome"), difference.alias("difference")
    )


def token_contrast(forget: DataFrame, utility: DataFrame, min_frequency: int, fraction: float) -> DataFrame:
    """Tokens over-represented in the forget texts; the top fraction (at least one) is kept."""
    from traceless.operators.ranking import group_rank

    def counts(df: DataFrame, name: str) -> DataFrame:
        words = df.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("token"))
        return words.where(F.col("token") != "").groupBy("token").agg(F.count(F.lit(1)).alias(name))

    table = counts(forget, "forget_count").where(F.col("forget_count") >= min_frequency).join(
        counts(utility, "utility_count"), "token", "left"
    )
    scored = table.select(
        "token",
        "forget_count",
        F.coalesce("utility_count", F.lit(0)).alias("utility_count"),
    ).withColumn("contrast", F.col("forget_count") / (F.col("utility_count") + 1))
    ranked = group_rank(
        scored.withColumn("all", F.lit(0)),
        ["all"],
        [F.desc("contrast"), F.desc("forget_count"), F.asc("token")],
        "position",
    )
    total = scored.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * fraction)).alias("kept"))
    return ranked.crossJoin(F.broadcast(total)).where(F.col("position") <= F.col("kept")).drop("kept", "all")


def transfer_summary(records: DataFrame, families: Sequence[str], core: str) -> DataFrame:
    """All counts of the service-transfer study in one row."""
    unsafe = F.col("truth") != "COMPLETE"
    safe = ~unsafe
    native = [
        F.count_if(F.col("native_complete") & unsafe & (F.col("family") == f)) for f in families
    ]
    spec = lambda test: F.coalesce(ratio(F.count_if(safe & test), F.count_if(safe)), F.lit(0.0))
    drop = spec(F.col("typed_complete")) - spec(F.col("full_verdict") == "COMPLETE")
    return records.agg(
        F.count(F.lit(1)).alias("case_count"),
        F.countDistinct("family").alias("family_count"),
        F.count_if(unsafe & (F.col("full_verdict") == "COMPLETE")).alias("false_complete"),
        F.count_if((F.col("fault_state") == "coverage_fault") & (F.col("full_verdict") == "UNVERIFIED")).alias(
            "coverage_fail_closed"
        ),
        F.count_if("post_control_recurrence").alias("post_control_recurrence"),
        F.count_if("retained_loss").alias("retained_loss"),
        functools.reduce(lambda a, b: F.least(a, b), native[1:], native[0]).alias("native_false_complete_min"),
        F.greatest(F.lit(0.0), drop).alias("specificity_drop"),
        F.count_if(~F.col("oracle_match")).alias("oracle_mismatch"),
        F.count_if(F.col("core_sha256") != core).alias("core_diff"),
        F.count_if(~F.col("process_observed")).alias("unobserved_process"),
    )


def temporal_metrics(trials: DataFrame) -> DataFrame:
    """Detection, specificity and fail-closed counts per split, in one row."""
    risk, safe, fault = (F.col("split") == s for s in ("risk", "safe", "coverage_fault"))
    verdict = F.col("verdict")
    return trials.agg(
        F.count_if(risk).alias("risk_case_count"),
        F.count_if(safe).alias("safe_case_count"),
        F.count_if(fault).alias("coverage_fault_case_count"),
        F.count_if(risk & (verdict == "REGENERATION_RISK")).alias("risk_detection_count"),
        F.count_if(safe & (verdict == "RSE_VERIFIED")).alias("safe_specificity_count"),
        F.count_if(fault & (verdict == "INCOMPLETE_COVERAGE")).alias("coverage_fail_closed_count"),
        F.count_if(risk & (F.col("snapshot_verdict") == "COMPLETE") & F.col("regenerated_without_control")).alias(
            "snapshot_false_complete_count"
        ),
        F.count_if(safe & (F.col("carrier_verdict") == "INCOMPLETE")).alias("carrier_false_incomplete_count"),
        F.count_if(risk & F.col("regenerated_after_control")).alias("recurrence_after_control_count"),
        F.coalesce(F.max(F.when(risk, F.col("selected_cost"))), F.lit(0)).alias("maximum_selected_cost"),
    )


def sweep_summary(rows: DataFrame) -> DataFrame:
    """Extremes and means over a per-subject sweep."""
    rows = Stored(rows, "sweep").df
    median = exact_percentile(rows, [], "stale_probability", 0.5, "stale_probability_median")
    return rows.agg(
        F.count(F.lit(1)).alias("subjects"),
        F.count_if("passed").alias("passed_subjects"),
        F.avg("exact_accuracy").alias("exact_accuracy_mean"),
        F.min("exact_accuracy").alias("exact_accuracy_min"),
        F.avg("accuracy_delta").alias("accuracy_delta_mean"),
        F.min("accuracy_delta").alias("accuracy_delta_min"),
        F.max("stale_probability").alias("stale_probability_max"),
        F.min("stale_probability").alias("stale_probability_min"),
    ).crossJoin(F.broadcast(median))


def failed_subjects(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("passed")).select("subject")


def sequence_gates(trials: DataFrame, gates: Sequence[Gate], privacy: DataFrame) -> DataFrame:
    """Gates over a release sequence; ``privacy`` holds one ``high`` per attack."""
    worst = worst_case(trials, [g for g in gates if g[0] != "max_privacy_upper_ci"])
    absent = trials.agg(F.bool_and("deleted_class_absent").cast("double").alias("all_deleted_absent"))
    upper = privacy.agg(F.max("high").alias("max_privacy_upper_ci"))
    row = worst.crossJoin(F.broadcast(absent)).crossJoin(F.broadcast(upper))
    renamed: Iterable[Gate] = [(g[0], g[0], g[2], g[3]) for g in gates]
    return gate_rows(row, [("all_deleted_absent", "all_deleted_absent", "==", 1.0), *renamed])


def safe_policy(evidence: DataFrame, gates: Sequence[Gate], candidate: str, fallback: str) -> DataFrame:
    """Accept the candidate only if every gate holds, else fall back."""
    return gate_decision(gate_rows(evidence, gates, ["family"]), ["family"]).select(
        "family",
        F.when(F.col("decision") == "PASS", candidate).otherwise(fallback).alias("selected_method"),
        F.when(F.col("decision") == "PASS", "CANDIDATE_ACCEPTED").otherwise("SAFE_FALLBACK").alias("decision"),
    )
