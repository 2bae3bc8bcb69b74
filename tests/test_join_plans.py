"""Tables with a row or more per case are never broadcast, however small their files are."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from traceless.operators import discovery as D
from traceless.operators import temporal as E
from traceless.plans.workspace import stored


@pytest.fixture
def plans(monkeypatch):
    """Executed plans of all tables that the operators write."""
    seen = []

    def spy(module):
        kept = module.Stored

        def written(df, label):
            seen.append(df._jdf.queryExecution().executedPlan().toString())
            return kept(df, label)

        monkeypatch.setattr(module, "Stored", written)

    spy(D)
    spy(E)
    return seen


def broadcast_cases(plans, key="case_id"):
    """Broadcast joins on the key of the cases."""
    return [line for plan in plans for line in plan.split("\n") if re.search(rf"BroadcastHashJoin \[{key}#", line)]


def catalogue(spark):
    predicted = spark.createDataFrame(
        [("g0", "p0", 0), ("g1", "p0", 1), ("g2", "p0", 1), ("g0", "p1", 0), ("g1", "p1", 0), ("g2", "p1", 1)],
        "graph_id string, probe_id string, trace long",
    )
    probes = spark.createDataFrame([("p0", 1, 1), ("p1", 1, 1)], "probe_id string, time_buckets int, declared_cost int")
    cases = spark.range(300).select(
        F.concat(F.lit("c"), "id").alias("case_id"), F.lit(True).alias("evidence_ok"), F.lit(0).alias("budget"), (F.col("id") % 3).alias("g")
    )
    truth = cases.select("case_id", F.concat(F.lit("g"), "g").alias("graph_id")).join(predicted, "graph_id").drop("graph_id")
    return predicted, probes, cases.drop("g"), stored(truth, "truth")


def test_discovery_and_its_check_shuffle_their_cases(spark, plans):
    predicted, probes, cases, truth = catalogue(spark)
    for strategy in ("minimax", "random"):
        log = D.discover(predicted, probes, cases, truth, strategy)
        last = log.groupBy("case_id").agg(F.max_by("graphs", "step").alias("graphs"))
        assert {tuple(r[0]) for r in last.select("graphs").distinct().collect()} == {("g0",), ("g1",), ("g2",)}
        if strategy == "minimax":
            every = F.array(F.lit("g0"), F.lit("g1"), F.lit("g2"))
            recorded = log.select("case_id", "step", "probe_id", "trace", every.alias("before_graphs"), F.col("graphs").alias("after_graphs"))
            checked = D.verify_discovery_log(recorded, predicted, probes, cases)
            assert checked.where("after_ok and probe_ok").count() == log.count()
    assert plans and not broadcast_cases(plans)


def test_policy_replay_shuffles_its_cases(spark, plans):
    _, _, cases, truth = catalogue(spark)
    policy = spark.createDataFrame(
        [("root", None, "p0", 2), ("a", "act", None, None)], "state string, action string, probe_id string, declared_cost long"
    )
    branches = spark.createDataFrame([("root", 0, "a"), ("root", 1, "a")], "state string, trace long, next_state string")
    out = D.replay_policy(policy, branches, cases.select("case_id", F.lit("root").alias("state")), truth)
    assert out.where("action = 'act' and cost = 2").count() == 300
    assert plans and not broadcast_cases(plans)


def test_traces_are_packed_by_a_broadcast_of_the_checkpoints(spark):
    checkpoints = spark.createDataFrame([("p0", "n0"), ("p0", "n1"), ("p1", "n0")], "probe_id string, node_id string")
    crossed = checkpoints.select("probe_id").distinct().crossJoin(checkpoints.select("node_id").distinct())
    rows = [(i, "p0", 1, f"n{i % 2}", True) for i in range(300)]
    traces = stored(spark.createDataFrame(rows, "case_id long, probe_id string, bucket int, node_id string, bit boolean"), "traces")
    packed = D.pack_traces(traces, crossed, ["case_id"])
    joins = [line for line in packed._jdf.queryExecution().executedPlan().toString().split("\n") if "HashJoin" in line or "SortMergeJoin" in line]
    assert any("BroadcastHashJoin" in line and "BuildRight" in line for line in joins)
    assert packed.where("trace = case_id % 2 + 1").count() == 300


def test_regeneration_shuffles_its_cases(spark, plans):
    cases = spark.range(300).select(F.concat(F.lit("c"), "id").alias("case_id"), F.lit(True).alias("complete"))
    steps = cases.select("case_id", F.lit("t").alias("transition_id"), F.array(F.lit("a")).alias("requires"), F.array(F.lit("b")).alias("adds"))
    fact = lambda name: cases.select("case_id", F.lit(name).alias("fact"))
    out = E.regeneration(steps, fact("a"), fact("b"), cases)
    assert out.where("verdict = 'REGENERATION_RISK' and reachable_states = 2").count() == 300
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert not broadcast_cases(plans)
