"""Planners build their labels only over what some choice of actions leaves open."""

from __future__ import annotations

from traceless.operators import pathgraph as G
from traceless.operators import remediation as P


def graph(spark):
    nodes = [("a", "ACTIVE"), ("b", "CLOSED"), ("c", "UNKNOWN"), ("d", "CLOSED"), ("e", "ACTIVE")]
    edges = [("a", "b", "ACTIVE", False), ("b", "c", "ACTIVE", False), ("a", "d", "ACTIVE", False), ("d", "c", "ACTIVE", True),
             ("e", "d", "ACTIVE", True), ("a", "c", "CLOSED", False), ("c", "e", "CLOSED", False)]
    return G.PathGraph(
        spark.createDataFrame([("r", n, "", s) for n, s in nodes], "request_id string, node_id string, subject_id string, state string"),
        spark.createDataFrame(
            [("r", f"{s}{t}", s, t, state, scoped, "u") for s, t, state, scoped in edges],
            "request_id string, edge_id string, source_id string, target_id string, state string, request_scoped boolean, subject_id string",
        ),
        spark.createDataFrame([("r", "storage", "", True, "PASS")], "request_id string, name string, stratum string, mandatory boolean, decision string"),
        spark.createDataFrame([("r", "u")], "request_id string, subject_id string"),
        spark.createDataFrame([("r", "a", "source"), ("r", "e", "sink"), ("r", "d", "sink")], "request_id string, node_id string, role string"),
        spark.createDataFrame([("r", "storage")], "request_id string, name string"),
    )


def transitions(spark):
    rows = [("r", "x", "NODE", "b", "ACTIVE", True), ("r", "x", "EDGE", "ce", "CLOSED", False), ("r", "y", "NODE", "e", "CLOSED", True),
            ("r", "y", "EDGE", "ac", "CLOSED", True)]
    return spark.createDataFrame(rows, "request_id string, action_id string, target string, target_id string, result_state string, verified boolean")


def test_only_what_actions_may_open_is_kept(spark):
    kept = G.openable(graph(spark), transitions(spark))
    assert sorted(r.node_id for r in kept.nodes.collect()) == ["a", "b", "c", "e"]
    # ed is scoped: its source is a start although its target stays closed.
    assert sorted(r.edge_id for r in kept.edges.collect()) == ["ab", "bc", "ce", "ed"]
    assert sorted((r.node_id, r.role) for r in kept.request_nodes.collect()) == [("a", "source"), ("e", "sink")]


def test_planners_label_the_open_part_only(spark, monkeypatch):
    written = {}

    class Spy(G.Stored):
        def __init__(self, df, label):
            super().__init__(df, label)
            written.setdefault(label, []).append(self.df.count())

    monkeypatch.setattr(G, "Stored", Spy)
    actions = spark.createDataFrame([("r", "x", 1, True), ("r", "y", 2, True)], "request_id string, action_id string, cost long, permitted boolean")
    none = spark.createDataFrame([], "request_id string, action_id string, name string, stratum string, mandatory boolean, decision string")
    best = P.min_cost_actions(graph(spark), actions, transitions(spark), none).collect()[0]
    assert (best.action_ids, best.total_cost, best.verdict) == (["y"], 2, "COMPLETE")
    greedy = P.greedy_actions(graph(spark), actions, transitions(spark), none).collect()[0]
    assert (greedy.action_ids, greedy.verdict) == (["y"], "COMPLETE")
    # Of five nodes and seven edges.
    assert set(written["variant-nodes"]) <= {4, 0} and set(written["variant-edges"]) <= {4, 0}


def test_a_graph_is_searched_once(spark, monkeypatch):
    from traceless.operators import closure

    labels = []

    class Spy(closure.Stored):
        def __init__(self, df, label):
            labels.append(label)
            super().__init__(df, label)

    monkeypatch.setattr(closure, "Stored", Spy)
    one = graph(spark)
    verdicts = [G.evaluate_requests(one).collect() for _ in range(2)]
    assert verdicts[0] == verdicts[1] and verdicts[0][0].verdict == "INCOMPLETE"
    assert labels.count("reach-0") == 1
    # Other states are another graph with its own search.
    shut = G.apply_actions(one, spark.createDataFrame([("r", "y")], "request_id string, action_id string"), transitions(spark),
                           spark.createDataFrame([], "request_id string, action_id string, name string, stratum string, mandatory boolean, decision string"))
    assert G.evaluate_requests(shut).collect()[0].verdict == "COMPLETE"


def test_changed_nodes_are_written_once(spark):
    shut = G.apply_actions(graph(spark), spark.createDataFrame([("r", "y")], "request_id string, action_id string"), transitions(spark),
                           spark.createDataFrame([], "request_id string, action_id string, name string, stratum string, mandatory boolean, decision string"))
    # before, every reader joined nodes and effects again
    assert shut.nodes.inputFiles() and "Join" not in shut.nodes._jdf.queryExecution().executedPlan().toString()


def test_greedy_plans_of_one_block_are_labelled_once(spark, monkeypatch):
    from traceless.queries.request_queries import actions as given
    from traceless.queries.request_queries import path_graph

    labels = []

    class Spy(G.Stored):
        def __init__(self, df, label):
            labels.append(label)
            super().__init__(df, label)

    sf = "/root/testdata/sf0.001"
    acts, moves, channels = given(spark, sf)
    monkeypatch.setattr(G, "Stored", Spy)
    once = sorted(P.greedy_actions(path_graph(spark, sf), acts, moves, channels).collect())
    assert labels.count("variant-nodes") == 1
    assert max(len(r.action_ids) for r in once) > 1
    # In rounds, as requests with more actions are planned.
    assert sorted(P.greedy_actions(path_graph(spark, sf), acts, moves, channels, limit=2).collect()) == once
    assert labels.count("variant-nodes") > 3
