"""Typed path graphs per request: reachability, actions, channels, verdicts.

All frames are keyed by ``request_id``.  Node and edge states are ACTIVE,
CLOSED or UNKNOWN; a walk that touches anything UNKNOWN is uncertain.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass, replace
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceless.functions.lattice import ALL, both, either, has, without
from traceless.operators.closure import Adjacency, levels
from traceless.plans.workspace import Stored, shuffled, union_stored


@dataclass(frozen=True)
class PathGraph:
    nodes: DataFrame  # request_id, node_id, subject_id, state
    edges: DataFrame  # request_id, edge_id, source_id, target_id, state, request_scoped, subject_id
    channels: DataFrame  # request_id, name, stratum, mandatory, decision
    requests: DataFrame  # request_id, subject_id
    request_nodes: DataFrame  # request_id, node_id, role
    request_channels: DataFrame  # request_id, name

    @functools.cached_property
    def reached(self) -> DataFrame:
        """:func:`reached_nodes`, whose levels are written tables, once for each graph."""
        return _reached_nodes(self)


def channel_decision(channels: DataFrame) -> DataFrame:
    """PASS when the upper bound stays within the threshold; UNKNOWN without a measurement."""
    measured = F.when(F.col("upper_bound") <= F.col("threshold"), "PASS").otherwise("FAIL")
    return channels.withColumn("decision", F.when(F.col("known"), measured).otherwise("UNKNOWN"))


def request_starts(graph: PathGraph) -> DataFrame:
    """Start nodes: open nodes of the subject, declared sources, sources of open scoped edges."""
    owner = graph.requests.select("request_id", F.col("subject_id").alias("owner"))
    mine = F.col("subject_id") == F.col("owner")
    is_open = F.col("state") != "CLOSED"
    own_nodes = graph.nodes.where(is_open).join(owner, "request_id").where(mine)
    scoped = graph.edges.where(is_open & F.col("request_scoped")).join(owner, "request_id").where(mine)
    declared = graph.request_nodes.where(F.col("role") == "source")
    return (
        own_nodes.select("request_id", "node_id")
        .unionByName(declared.select("request_id", "node_id"))
        .unionByName(scoped.select("request_id", F.col("source_id").alias("node_id")))
        .distinct()
    )


def open_edges(graph: PathGraph) -> DataFrame:
    """Edges that a walk may use, with the uncertainty they add."""
    target = graph.nodes.where(F.col("state") != "CLOSED").select(
        "request_id", F.col("node_id").alias("target_id"), F.col("state").alias("target_state")
    )
    uncertain = (F.col("state") == "UNKNOWN") | (F.col("target_state") == "UNKNOWN")
    return (
        graph.edges.where(F.col("state") != "CLOSED")
        .select("request_id", "source_id", "target_id", "state")
        .join(target, ["request_id", "target_id"])
        .groupBy("request_id", "source_id", "target_id", uncertain.alias("edge_uncertain"))
        .agg(F.lit(1).alias("one"))
        .drop("one")
    )


def classify_reachability(graph: PathGraph) -> DataFrame:
    """Per reached sink: certain walk, uncertain walk and the shortest walk.

    The state of the search is (request, node, uncertain), so ``has_unknown`` says
    that a walk over an uncertain node or edge reaches the sink, whether or not it
    repeats a node.  The shortest walk of a sink never repeats one.
    """
    sinks = graph.request_nodes.where(F.col("role") == "sink").select("request_id", "node_id")
    return (
        reached_nodes(graph).join(sinks, ["request_id", "node_id"], "left_semi")
        .groupBy("request_id", "node_id")
        .agg(
            F.bool_or(~F.col("uncertain")).alias("has_active"),
            F.bool_or("uncertain").alias("has_unknown"),
            F.min(F.struct(F.size("path").alias("length"), "path")).alias("shortest"),
        )
    )


def reached_nodes(graph: PathGraph) -> DataFrame:
    """``request_id, node_id, uncertain, path``: every open node with its shortest certain and uncertain walk."""
    return graph.reached


def _reached_nodes(graph: PathGraph) -> DataFrame:
    keys = ["request_id", "node_id", "uncertain"]
    edges = Adjacency(open_edges(graph), ["request_id", "source_id"], "target_id")
    seed = (
        request_starts(graph)
        .join(graph.nodes.where(F.col("state") != "CLOSED"), ["request_id", "node_id"])
        .select(
            "request_id",
            "node_id",
            (F.col("state") == "UNKNOWN").alias("uncertain"),
            F.array("node_id").alias("path"),
        )
    )

    def step(frontier: DataFrame) -> DataFrame:
        grown = edges.join(frontier.withColumnRenamed("node_id", "source_id"))
        return (
            grown.withColumn("uncertain", F.col("uncertain") | F.col("edge_uncertain"))
            .groupBy("request_id", F.col("target_id").alias("node_id"), "uncertain")
            .agg(F.min("path").alias("path"))
            .withColumn("path", F.concat("path", F.array("node_id")))
        )

    return union_stored(levels(seed, step, keys, "reach"))


def enumerate_paths(graph: PathGraph) -> DataFrame:
    """Every simple path from a start to a sink, with its certainty.

    Only needed for violation counts.  A simple path ends on its own, so the loop
    runs until none grows any more.
    """
    edges = Adjacency(open_edges(graph), ["request_id", "source_id"], "target_id")
    starts = request_starts(graph).join(
        graph.nodes.where(F.col("state") != "CLOSED"), ["request_id", "node_id"]
    )
    frontier = Stored(
        starts.select(
            "request_id",
            F.col("node_id").alias("source_id"),
            F.array("node_id").alias("path"),
            (F.col("state") == "UNKNOWN").alias("uncertain"),
        ),
        "simple-0",
    )
    found = [frontier]
    for depth in count(1):
        grown = (
            edges.join(found[-1].df)
            .where(~F.array_contains("path", F.col("target_id")))
            .select(
                "request_id",
                F.col("target_id").alias("source_id"),
                F.concat("path", F.array("target_id")).alias("path"),
                (F.col("uncertain") | F.col("edge_uncertain")).alias("uncertain"),
            )
            .distinct()
        )
        level = Stored(grown, f"simple-{depth}")
        if level.is_empty():
            break
        found.append(level)
    sinks = graph.request_nodes.where(F.col("role") == "sink").select(
        "request_id", F.col("node_id").alias("source_id")
    )
    return (
        union_stored(found)
        .join(sinks, ["request_id", "source_id"], "left_semi")
        .select("request_id", F.col("source_id").alias("sink_id"), "path", "uncertain")
    )


# --- actions -----------------------------------------------------------------


def apply_actions(graph: PathGraph, selected: DataFrame, transitions: DataFrame, channels: DataFrame) -> PathGraph:
    """Graph after the selected actions; on one target the largest action id wins.

    Its nodes are a written table: a search reads them three times.
    """
    keys = ["request_id", "action_id"]
    effects = transitions.join(selected.select(*keys), keys, "left_semi").withColumn(
        "outcome", F.when(F.col("verified"), F.col("result_state")).otherwise("UNKNOWN")
    )
    last = effects.groupBy("request_id", "target", "target_id").agg(
        F.max(F.struct("action_id", "outcome")).alias("last")
    )
    outcome = F.coalesce("last.outcome", "state")

    def changed(df: DataFrame, kind: str, id_col: str) -> DataFrame:
        mine = last.where(F.col("target") == kind).select(
            "request_id", F.col("target_id").alias(id_col), "last"
        )
        return df.join(mine, ["request_id", id_col], "left").withColumn("state", outcome).drop("last")

    nodes = changed(graph.nodes, "NODE", "node_id")
    if "active_sink" in nodes.columns:
        nodes = nodes.withColumn("active_sink", F.col("active_sink") & (F.col("state") != "CLOSED"))
    results = channels.join(selected.select(*keys), keys, "left_semi").select(
        "request_id", "name", "stratum", "action_id", "mandatory", "decision"
    )
    merged = (
        graph.channels.select(
            "request_id", "name", "stratum", F.lit("").alias("action_id"), "mandatory", "decision"
        )
        .unionByName(results)
        .groupBy("request_id", "name", "stratum")
        .agg(F.max(F.struct("action_id", "mandatory", "decision")).alias("c"))
        .select("request_id", "name", "stratum", "c.mandatory", "c.decision")
    )
    return replace(graph, nodes=Stored(nodes, "changed-nodes").df, edges=changed(graph.edges, "EDGE", "edge_id"), channels=merged)


def _label() -> Column:
    return F.when(F.col("stratum") == "", F.col("name")).otherwise(F.concat("name", F.lit("@"), "stratum"))


def compose_channels(channels: DataFrame, requests: DataFrame, required: DataFrame) -> DataFrame:
    """Channel verdict per request with sorted failed, unknown and missing labels."""
    mandatory = channels.where("mandatory")
    label = _label()
    summary = mandatory.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("decision") == "FAIL", label))).alias("failed"),
        F.array_sort(F.collect_list(F.when(F.col("decision") == "UNKNOWN", label))).alias("unknown"),
    )
    absent = (
        required.select("request_id", "name")
        .distinct()
        .join(mandatory.select("request_id", "name"), ["request_id", "name"], "left_anti")
        .groupBy("request_id")
        .agg(F.array_sort(F.collect_list("name")).alias("missing"))
    )
    none = F.array().cast("array<string>")
    joined = (
        requests.select("request_id")
        .join(summary, "request_id", "left")
        .join(absent, "request_id", "left")
        .select(
            "request_id",
            F.coalesce("n", F.lit(0)).alias("n"),
            *[F.coalesce(c, none).alias(c) for c in ("failed", "unknown", "missing")],
        )
    )
    verdict = (
        F.when(F.size("failed") > 0, "INCOMPLETE")
        .when((F.size("missing") > 0) | (F.size("unknown") > 0) | (F.col("n") == 0), "UNVERIFIED")
        .otherwise("COMPLETE")
    )
    return joined.withColumn("channel_verdict", verdict).drop("n")


def evaluate_requests(graph: PathGraph) -> DataFrame:
    """Verdict per request from paths and channels, with the shortest counterexample."""
    paths = classify_reachability(graph).groupBy("request_id").agg(
        F.bool_or("has_active").alias("has_active"),
        F.bool_or("has_unknown").alias("has_unknown"),
        F.min("shortest").alias("best"),
    )
    joined = compose_channels(graph.channels, graph.requests, graph.request_channels).join(
        paths, "request_id", "left"
    )
    active = F.coalesce("has_active", F.lit(False))
    unknown = F.coalesce("has_unknown", F.lit(False))
    verdict = (
        F.when(active | (F.col("channel_verdict") == "INCOMPLETE"), "INCOMPLETE")
        .when(unknown | (F.col("channel_verdict") == "UNVERIFIED"), "UNVERIFIED")
        .otherwise("COMPLETE")
    )
    return joined.select(
        "request_id",
        verdict.alias("verdict"),
        active.alias("has_active"),
        (unknown & ~active).alias("only_unknown"),
        F.col("best.path").alias("shortest_counterexample"),
        F.col("failed").alias("failed_channels"),
        F.concat("unknown", "missing").alias("unknown_channels"),
    )


def node_state_verdict(graph: PathGraph, checked: DataFrame) -> DataFrame:
    """Verdict that looks only at the states of the ``checked`` (request_id, node_id) rows."""
    states = graph.nodes.join(checked, ["request_id", "node_id"], "left_semi").groupBy("request_id").agg(
        F.bool_or(F.col("state") == "ACTIVE").alias("a"), F.bool_or(F.col("state") == "UNKNOWN").alias("u")
    )
    joined = graph.requests.select("request_id").join(states, "request_id", "left")
    return joined.select(
        "request_id",
        F.when(F.col("a"), "INCOMPLETE").when(F.col("u"), "UNVERIFIED").otherwise("COMPLETE").alias("verdict"),
    )


def model_only_verdict(graph: PathGraph, name: str) -> DataFrame:
    """Verdict from the channels of one name."""
    channels = graph.channels.where(F.col("name") == name)
    none = graph.request_channels.limit(0)
    return compose_channels(channels, graph.requests, none).select(
        "request_id", F.col("channel_verdict").alias("verdict")
    )


def receipt_only_verdict(graph: PathGraph) -> DataFrame:
    return graph.requests.select("request_id", F.lit("COMPLETE").alias("verdict"))


def compose_strata(evidence: DataFrame, protocol_hash: str, requests: DataFrame) -> DataFrame:
    """Model evidence over strata; a foreign protocol hash turns its channels UNKNOWN.

    Adds ``disagrees``: some stratum with the right protocol reports another
    success than its own channels give.
    """
    same = F.col("protocol_hash") == protocol_hash
    decided = evidence.withColumn("decision", F.when(same, F.col("decision")).otherwise("UNKNOWN")).withColumn(
        "mandatory", F.lit(True)
    )
    strata = decided.groupBy("request_id", "stratum").agg(
        F.bool_and(F.col("decision") == "PASS").alias("passed"),
        F.bool_and("reported_success").alias("reported"),
        F.bool_or(same).alias("same"),
    )
    wrong = strata.groupBy("request_id").agg(
        F.bool_or(F.col("same") & (F.col("passed") != F.col("reported"))).alias("disagrees")
    )
    required = requests.select("request_id", F.lit("").alias("name")).limit(0)
    return (
        compose_channels(decided, requests, required)
        .join(wrong, "request_id", "left")
        .withColumn("disagrees", F.coalesce("disagrees", F.lit(False)))
    )


# --- many action sets at once ------------------------------------------------


def _merge_states(effects: Column, base: Column) -> Column:
    """Fold ordered (bits, state) effects into labels for ACTIVE and UNKNOWN."""
    start = F.struct(
        F.when(base == "ACTIVE", ALL).otherwise(0).cast("long").alias("a"),
        F.when(base == "UNKNOWN", ALL).otherwise(0).cast("long").alias("u"),
    )

    def fold(acc: Column, e: Column) -> Column:
        rest_a, rest_u = without(acc["a"], e["bits"]), without(acc["u"], e["bits"])
        return F.struct(
            F.when(e["outcome"] == "ACTIVE", either(rest_a, e["bits"])).otherwise(rest_a).alias("a"),
            F.when(e["outcome"] == "UNKNOWN", either(rest_u, e["bits"])).otherwise(rest_u).alias("u"),
        )

    empty = F.array().cast("array<struct<action_id:string,bits:bigint,outcome:string>>")
    return F.aggregate(F.coalesce(effects, empty), start, fold)


def openable(graph: PathGraph, transitions: DataFrame) -> PathGraph:
    """The part of a graph that walks can use under some choice of actions, as tables.

    A node or edge counts unless it is closed and no transition sets it otherwise.  An edge
    also needs its source and, unless it is scoped and so makes its source a start, its
    target.  What is left out is closed under every choice, so verdicts, walks and
    violations stay the same.
    """
    shut = F.coalesce(F.col("verified") & (F.col("result_state") == "CLOSED"), F.lit(False))
    opened = transitions.where(~shut).select("request_id", "target", "target_id").distinct()
    closed = F.coalesce(F.col("state") == "CLOSED", F.lit(False))

    def counted(df: DataFrame, kind: str, id_col: str) -> DataFrame:
        mine = opened.where(F.col("target") == kind).select("request_id", F.col("target_id").alias(id_col))
        reopened = df.where(closed).join(shuffled(mine), ["request_id", id_col], "left_semi")
        return df.where(~closed).unionByName(reopened.select(*df.columns))

    nodes = Stored(
        counted(graph.nodes.select("request_id", "node_id", "subject_id", "state"), "NODE", "node_id"), "openable-nodes"
    ).df
    ends = nodes.select("request_id", "node_id")
    source = ends.withColumnRenamed("node_id", "source_id")
    target = ends.select("request_id", F.col("node_id").alias("target_id"), F.lit(True).alias("reached"))
    columns = ["request_id", "edge_id", "source_id", "target_id", "state", "request_scoped", "subject_id"]
    edges = (
        counted(graph.edges.select(*columns), "EDGE", "edge_id")
        .join(shuffled(source), ["request_id", "source_id"], "left_semi")
        .join(shuffled(target), ["request_id", "target_id"], "left")
        .where(F.col("reached") | F.col("request_scoped"))
    )
    roles = graph.request_nodes.join(shuffled(ends), ["request_id", "node_id"], "left_semi")
    return replace(
        graph,
        nodes=nodes,
        edges=Stored(edges.select(*columns), "openable-edges").df,
        request_nodes=Stored(roles, "openable-roles").df,
    )


class Variants:
    """One path graph under up to 64 action sets per (request, block).

    ``members(request_id, block, action_id, bits)`` says in which sets an action
    is taken.  States, walks and channel outcomes are labels: bit ``b`` speaks
    about action set ``b`` of the block.
    """

    KEYS = ["request_id", "block"]

    def __init__(self, graph: PathGraph, blocks: DataFrame, members: DataFrame, transitions: DataFrame, channels: DataFrame):
        self.graph, self.blocks = graph, blocks
        outcome = F.when(F.col("verified"), F.col("result_state")).otherwise("UNKNOWN").alias("outcome")
        effects = (
            transitions.join(members, ["request_id", "action_id"])
            .groupBy("request_id", "block", "target", "target_id")
            .agg(F.array_sort(F.collect_list(F.struct("action_id", "bits", outcome))).alias("effects"))
        )
        self._members, self._action_channels = members, channels

        def labelled(df: DataFrame, kind: str, id_col: str) -> DataFrame:
            mine = effects.where(F.col("target") == kind).select(
                "request_id", "block", F.col("target_id").alias(id_col), "effects"
            )
            spread = df.join(blocks.select("request_id", "block"), "request_id")
            merged = spread.join(mine, ["request_id", "block", id_col], "left").withColumn(
                "s", _merge_states(F.col("effects"), F.col("state"))
            )
            return merged.drop("effects", "state").withColumns({"a": F.col("s.a"), "u": F.col("s.u")}).drop("s")

        self.nodes = Stored(
            labelled(graph.nodes.select("request_id", "node_id", "subject_id", "state"), "NODE", "node_id"), "variant-nodes"
        ).df
        edges = labelled(
            graph.edges.select("request_id", "edge_id", "source_id", "target_id", "state", "request_scoped", "subject_id"),
            "EDGE",
            "edge_id",
        )
        target = self.nodes.select(
            "request_id", "block", F.col("node_id").alias("target_id"), F.col("a").alias("ta"), F.col("u").alias("tu")
        )
        # A scoped edge makes its source a start even where its target is closed or not in the graph.
        ends = edges.join(target, [*self.KEYS, "target_id"], "left")
        zero = F.lit(0).cast("long")
        self.edges = Stored(ends.withColumns({c: F.coalesce(c, zero) for c in ("ta", "tu")}), "variant-edges").df

    @functools.cached_property
    def _starts(self) -> Stored:
        owner = self.graph.requests.select("request_id", F.col("subject_id").alias("owner"))
        mine = F.col("subject_id") == F.col("owner")
        is_open = either(F.col("a"), F.col("u"))
        own = self.nodes.join(owner, "request_id").where(mine).select(
            *self.KEYS, "node_id", is_open.alias("start")
        )
        declared = self.graph.request_nodes.where(F.col("role") == "source").join(
            self.blocks.select("request_id", "block"), "request_id"
        ).select(*self.KEYS, "node_id", F.lit(ALL).cast("long").alias("start"))
        scoped = self.edges.where("request_scoped").join(owner, "request_id").where(mine).select(
            *self.KEYS, F.col("source_id").alias("node_id"), is_open.alias("start")
        )
        starts = own.unionByName(declared).unionByName(scoped).groupBy(*self.KEYS, "node_id").agg(
            F.bit_or("start").alias("start")
        )
        labels = starts.join(self.nodes, [*self.KEYS, "node_id"]).select(
            *self.KEYS,
            "node_id",
            both(F.col("start"), F.col("a")).alias("c"),
            both(F.col("start"), F.col("u")).alias("q"),
        )
        return Stored(labels.where(either(F.col("c"), F.col("q")) != 0), "bits-0")

    @functools.cached_property
    def _adjacency(self) -> Adjacency:
        usable = self.edges.where(
            both(either(F.col("a"), F.col("u")), either(F.col("ta"), F.col("tu"))) != 0
        ).select(*self.KEYS, "source_id", "target_id", "a", "u", "ta", "tu")
        return Adjacency(usable, [*self.KEYS, "source_id"], "target_id")

    @staticmethod
    def _cross(c: Column, q: Column) -> tuple[Column, Column]:
        """Labels after an edge: certain walks stay certain on ACTIVE edge and target only."""
        sure = both(F.col("a"), F.col("ta"))
        usable = both(either(F.col("a"), F.col("u")), either(F.col("ta"), F.col("tu")))
        return both(c, sure), either(both(c, without(usable, sure)), both(q, usable))

    def reach(self) -> DataFrame:
        """Labels of certain (``c``) and uncertain (``q``) walks per reached node."""
        edges = self._adjacency
        found = [self._starts]
        while True:
            known = union_stored(found).groupBy(*self.KEYS, "node_id").agg(
                F.bit_or("c").alias("kc"), F.bit_or("q").alias("kq")
            )
            grown = edges.join(found[-1].df.withColumnRenamed("node_id", "source_id"))
            c, q = self._cross(F.col("c"), F.col("q"))
            proposed = (
                grown.select(*self.KEYS, F.col("target_id").alias("node_id"), c.alias("c"), q.alias("q"))
                .where(either(F.col("c"), F.col("q")) != 0)
                .groupBy(*self.KEYS, "node_id")
                .agg(F.bit_or("c").alias("c"), F.bit_or("q").alias("q"))
                .join(known, [*self.KEYS, "node_id"], "left")
                .select(
                    *self.KEYS,
                    "node_id",
                    without(F.col("c"), F.coalesce("kc", F.lit(0).cast("long"))).alias("c"),
                    without(F.col("q"), F.coalesce("kq", F.lit(0).cast("long"))).alias("q"),
                )
                .where(either(F.col("c"), F.col("q")) != 0)
            )
            level = Stored(proposed, f"bits-{len(found)}")
            if level.is_empty():
                break
            found.append(level)
        return union_stored(found)

    def _sinks(self) -> DataFrame:
        return self.graph.request_nodes.where(F.col("role") == "sink").select("request_id", "node_id")

    @functools.cached_property
    def channel_labels(self) -> DataFrame:
        """Per channel: labels where it is mandatory, fails, and is unknown."""
        base = self.graph.channels.join(self.blocks.select("request_id", "block"), "request_id").select(
            *self.KEYS, "name", "stratum", F.lit("").alias("action_id"), F.lit(ALL).cast("long").alias("bits"), "mandatory", "decision"
        )
        added = self._action_channels.join(self._members, ["request_id", "action_id"]).select(
            *self.KEYS, "name", "stratum", "action_id", "bits", "mandatory", "decision"
        )
        effects = base.unionByName(added).groupBy(*self.KEYS, "name", "stratum").agg(
            F.array_sort(F.collect_list(F.struct("action_id", "bits", "mandatory", "decision"))).alias("e")
        )
        zero = F.lit(0).cast("long")
        start = F.struct(zero.alias("m"), zero.alias("f"), zero.alias("u"))

        def fold(acc: Column, e: Column) -> Column:
            put = lambda label, test: F.when(test, either(label, e["bits"])).otherwise(without(label, e["bits"]))
            must = e["mandatory"]
            return F.struct(
                put(acc["m"], must).alias("m"),
                put(acc["f"], must & (e["decision"] == "FAIL")).alias("f"),
                put(acc["u"], must & (e["decision"] == "UNKNOWN")).alias("u"),
            )

        merged = effects.withColumn("s", F.aggregate("e", start, fold))
        return Stored(merged.select(*self.KEYS, "name", "stratum", "s.m", "s.f", "s.u"), "channel-labels").df

    def verdicts(self, walks: DataFrame | None = None) -> DataFrame:
        """Labels ``complete`` and ``incomplete`` per (request, block).

        Enumerated ``walks`` are used where they exist; otherwise reachability.
        """
        zero = F.lit(0).cast("long")
        paths = (
            (self.reach() if walks is None else walks)
            .join(self._sinks(), ["request_id", "node_id"], "left_semi")
            .groupBy(*self.KEYS)
            .agg(F.bit_or("c").alias("active"), F.bit_or("q").alias("unknown"))
        )
        labels = self.channel_labels
        summary = labels.groupBy(*self.KEYS).agg(
            F.bit_or("m").alias("any_m"), F.bit_or("f").alias("fail"), F.bit_or("u").alias("cu")
        )
        missing = self.missing(labels).groupBy(*self.KEYS).agg(F.bit_or("missing").alias("missing"))
        joined = (
            self.blocks.join(paths, self.KEYS, "left").join(summary, self.KEYS, "left").join(missing, self.KEYS, "left")
        )
        value = {c: F.coalesce(c, zero) for c in ("active", "unknown", "fail", "cu", "any_m", "missing")}
        incomplete = either(value["active"], value["fail"])
        doubt = either(either(value["unknown"], value["cu"]), either(value["missing"], F.bitwise_not(value["any_m"])))
        return joined.select(
            *self.blocks.columns,
            F.bitwise_not(either(incomplete, doubt)).alias("complete"),
            incomplete.alias("incomplete"),
        )

    def missing(self, labels: DataFrame) -> DataFrame:
        """Per required channel name: labels where no mandatory channel has that name."""
        present = labels.groupBy(*self.KEYS, "name").agg(F.bit_or("m").alias("m"))
        required = self.graph.request_channels.distinct().join(
            self.blocks.select("request_id", "block"), "request_id"
        )
        return required.join(present, [*self.KEYS, "name"], "left").select(
            *self.KEYS, "name", F.bitwise_not(F.coalesce("m", F.lit(0).cast("long"))).alias("missing")
        )

    def walks(self, only: DataFrame | None = None) -> DataFrame:
        """Simple walks with their labels; ``only`` restricts them to some requests."""
        edges = self._adjacency
        first = self._starts.df
        if only is not None:
            first = first.join(only.select("request_id").distinct(), "request_id", "left_semi")
        found = [Stored(first.withColumn("path", F.array("node_id")), "walk-0")]
        for depth in count(1):
            grown = edges.join(found[-1].df.withColumnRenamed("node_id", "source_id")).where(
                ~F.array_contains("path", F.col("target_id"))
            )
            c, q = self._cross(F.col("c"), F.col("q"))
            level = Stored(
                grown.select(
                    *self.KEYS,
                    F.col("target_id").alias("node_id"),
                    c.alias("c"),
                    q.alias("q"),
                    F.concat("path", F.array("target_id")).alias("path"),
                )
                .where(either(F.col("c"), F.col("q")) != 0)
                .groupBy(*self.KEYS, "node_id", "path")
                .agg(F.bit_or("c").alias("c"), F.bit_or("q").alias("q")),
                f"walk-{depth}",
            )
            if level.is_empty():
                break
            found.append(level)
        return union_stored(found)

    def violations(self, walks: DataFrame, only: DataFrame | None = None) -> DataFrame:
        """Paths and channels that break each action set: one count per (request, block, bit)."""
        walks = walks.join(self._sinks(), ["request_id", "node_id"], "left_semi")
        labels = self.channel_labels
        parts = (
            walks.select(*self.KEYS, "c").withColumnRenamed("c", "label")
            .unionByName(walks.select(*self.KEYS, F.col("q").alias("label")))
            .unionByName(labels.select(*self.KEYS, F.col("f").alias("label")))
            .unionByName(labels.select(*self.KEYS, F.col("u").alias("label")))
            .unionByName(self.missing(labels).select(*self.KEYS, F.col("missing").alias("label")))
        )
        if only is not None:
            parts = parts.join(only.select("request_id").distinct(), "request_id", "left_semi")
        return bit_counts(parts, self.KEYS)


def bit_counts(labels: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """How many labels of a group have each bit set, as an array indexed by bit.

    Equal labels are counted first, so the 64 counters see few rows.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    tallied = labels.where(F.col("label") != 0).groupBy(*keys, "label").agg(n.alias("_n"))
    sums = [F.sum(F.getbit("label", F.lit(i)).cast("long") * F.col("_n")).alias(f"b{i}") for i in range(64)]
    counted = tallied.groupBy(*keys).agg(*sums)
    return counted.select(*keys, F.array(*[F.col(f"b{i}") for i in range(64)]).alias("violations"))


def decide_outcomes(outcomes: DataFrame) -> DataFrame:
    """Native, typed and full verdict of observed deletions; a null observation is unverified."""
    absent, derived, back = F.col("primary_absent"), F.col("derivative_present"), F.col("recovery_recurrence")
    unseen = ~F.col("coverage_complete") | derived.isNull() | back.isNull()
    witness = (
        F.when(unseen, F.lit(None))
        .when(~absent, F.array(F.lit("primary-object")))
        .when(derived, F.array(F.lit("materialized-derivative")))
        .when(back, F.array(F.lit("recovery-carrier"), F.lit("replay"), F.lit("primary-object")))
    )
    return outcomes.select(
        "case_id",
        absent.alias("native_complete"),
        (absent & F.coalesce(~derived, F.lit(False))).alias("typed_complete"),
        F.when(unseen, "UNVERIFIED").when(~absent | derived | back, "INCOMPLETE").otherwise("COMPLETE").alias("verdict"),
        witness.alias("witness"),
        (F.col("retained_after") < F.col("retained_before")).alias("retained_loss"),
    )
