"""Exact closing action sets beyond the subset lattice, by clauses from open walks.

Actions may open what others close, so feasibility is not monotone and a demand is a
clause.  Under a chosen set an open walk stays open unless one of its nodes and edges
closes; that takes a further action that closes it, or leaving out the chosen action
whose effect wins there now.  A channel that fails changes only if its winning entry
does.  Every round takes the cheapest set that meets a request's clauses, applies it,
and turns what is still open into clauses; all requests go on together.  The clauses
hold for every closing set, so the first set that leaves nothing open is the cheapest,
and a request whose clauses contradict each other can't be closed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceless.functions.choices import least_assignment
from traceless.operators.pathgraph import PathGraph, apply_actions, open_edges, reached_nodes
from traceless.plans.workspace import Stored, union_stored

#: Search nodes of a request in one round, and rounds of the whole search.
MAX_NODES, MAX_ROUNDS = 200_000, 500

_NONE = "array<int>"


def _numbers() -> Column:
    return F.array().cast(_NONE)


def _among(column: str, test) -> Column:
    """Numbers of the entries of ``column`` that pass a test."""
    return F.transform(F.filter(column, test), lambda e: e["idx"])


def _is_taken(entry: Column) -> Column:
    return (entry["idx"] < 0) | F.array_contains("taken", entry["idx"])


def _winner(column: str) -> Column:
    """The largest number in force on a target; null if none is."""
    return F.array_max(_among(column, _is_taken))


def open_walks(graph: PathGraph) -> DataFrame:
    """``request_id, walk, path``: for every open edge into a sink the shortest walk that ends with it."""
    shortest = reached_nodes(graph).groupBy("request_id", "node_id").agg(F.min(F.struct(F.size("path").alias("length"), "path")).alias("s"))
    reached = Stored(shortest.select("request_id", "node_id", "s.path"), "reached").df
    sinks = graph.request_nodes.where(F.col("role") == "sink").select("request_id", F.col("node_id").alias("target_id")).distinct()
    into = open_edges(graph).join(sinks, ["request_id", "target_id"]).select("request_id", F.col("source_id").alias("node_id"), "target_id").distinct()
    grown = reached.join(into, ["request_id", "node_id"]).where(~F.array_contains("path", F.col("target_id")))
    at_once = reached.join(sinks.withColumnRenamed("target_id", "node_id"), ["request_id", "node_id"]).where(F.size("path") == 1)
    paths = grown.select("request_id", F.concat("path", F.array("target_id")).alias("path")).unionByName(at_once.select("request_id", "path"))
    return paths.select("request_id", F.array_join("path", "\x1f").alias("walk"), "path")


def walk_elements(graph: PathGraph) -> DataFrame:
    """``request_id, walk, target, target_id``: what keeps open a shortest walk over each edge into a sink."""
    found = Stored(open_walks(graph), "open-walks").df
    keys = ["request_id", "walk"]
    on_nodes = found.select(*keys, F.lit("NODE").alias("target"), F.explode("path").alias("target_id"))
    steps = F.transform(
        F.sequence(F.lit(1), F.size("path") - 1),
        lambda i: F.struct(F.get("path", i - 1).alias("source_id"), F.get("path", i).alias("target_id")),
    )
    is_open = F.col("state") != "CLOSED"
    pairs = found.where(F.size("path") > 1).select(*keys, F.explode(steps).alias("s")).select(*keys, "s.source_id", "s.target_id")
    edges = graph.edges.where(is_open).select("request_id", "source_id", "target_id", "edge_id")
    on_edges = pairs.join(edges, ["request_id", "source_id", "target_id"]).groupBy(*keys, "source_id", "target_id").agg(F.min("edge_id").alias("edge_id"))
    owner = graph.requests.select("request_id", F.col("subject_id").alias("owner"))
    mine = F.col("subject_id") == F.col("owner")
    own = graph.nodes.join(owner, "request_id").where(mine).select("request_id", "node_id")
    plain = own.unionByName(graph.request_nodes.where(F.col("role") == "source").select("request_id", "node_id")).distinct()
    first = found.select(*keys, F.get("path", F.lit(0)).alias("node_id")).join(plain, ["request_id", "node_id"], "left_anti")
    scoped = graph.edges.where(is_open & F.col("request_scoped")).join(owner, "request_id").where(mine)
    starts = first.join(scoped.select("request_id", F.col("source_id").alias("node_id"), "edge_id"), ["request_id", "node_id"])
    on_start = starts.groupBy(*keys).agg(F.min("edge_id").alias("edge_id"))
    both = on_edges.select(*keys, "edge_id").unionByName(on_start)
    return on_nodes.unionByName(both.select(*keys, F.lit("EDGE").alias("target"), F.col("edge_id").alias("target_id"))).distinct()


def _walk_clauses(elements: DataFrame, touching: DataFrame, taken: DataFrame) -> DataFrame:
    """Per open walk the actions that would close it and the chosen ones that keep it open."""
    joined = elements.join(taken, "request_id").join(touching, ["request_id", "target", "target_id"], "left")
    joined = joined.withColumn("winner", _winner("effects"))
    closes = _among("effects", lambda e: ~_is_taken(e) & (e["outcome"] == "CLOSED") & (e["idx"] > F.coalesce("winner", F.lit(-1))))
    return joined.withColumn("closers", F.coalesce(closes, _numbers())).groupBy("request_id", "walk").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("closers")))).alias("add"),
        F.array_sort(F.collect_set("winner")).alias("drop"),
    ).select("request_id", "add", "drop")


def _channel_clauses(entries: DataFrame, required: DataFrame, taken: DataFrame) -> DataFrame:
    """Clauses of failing and unknown channels, of missing names, and of requests without any."""
    state = entries.join(taken, "request_id").withColumn("winner", _winner("entries"))
    now = F.get(F.filter("entries", lambda e: e["idx"] == F.col("winner")), F.lit(0))
    state = state.withColumns({"must": F.coalesce(now["mandatory"], F.lit(False)), "now": now["decision"]})
    later = lambda e: ~_is_taken(e) & (e["idx"] > F.coalesce("winner", F.lit(-1)))
    state = state.withColumns(
        {
            "mends": _among("entries", lambda e: later(e) & (~e["mandatory"] | (e["decision"] == "PASS"))),
            "names": _among("entries", lambda e: later(e) & e["mandatory"]),
            "own": F.when(F.col("winner") >= 0, F.array("winner")).otherwise(_numbers()),
        }
    )
    state = Stored(state.select("request_id", "name", "must", "now", "mends", "names", "own"), "channel-states").df
    bad = state.where(F.col("must") & F.col("now").isin("FAIL", "UNKNOWN")).select("request_id", F.col("mends").alias("add"), F.col("own").alias("drop"))
    gathered = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))) for c in ("names", "own")]
    summary = [F.bool_or("must").alias("there"), gathered[0].alias("add"), gathered[1].alias("drop")]
    wanted = required.select("request_id", "name").distinct().join(taken.select("request_id"), "request_id", "left_semi")
    named = wanted.join(state.groupBy("request_id", "name").agg(*summary), ["request_id", "name"], "left")
    whole = taken.select("request_id").join(state.groupBy("request_id").agg(*summary), "request_id", "left")
    absent = named.drop("name").unionByName(whole).where(~F.coalesce("there", F.lit(False)))
    return bad.unionByName(absent.select("request_id", F.coalesce("add", _numbers()).alias("add"), F.coalesce("drop", _numbers()).alias("drop")))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mask = lambda numbers: sum(1 << i for i in numbers)
    for batch in batches:
        taken, states = [], []
        for row in batch.select(["clauses", "costs"]).to_pylist():
            clauses = [(mask(c["add"]), mask(c["drop"])) for c in row["clauses"]]
            found, state = least_assignment(clauses, row["costs"], MAX_NODES)
            taken.append(found)
            states.append(state)
        yield pa.RecordBatch.from_arrays([batch.column("request_id"), pa.array(taken, pa.list_(pa.int32())), pa.array(states, pa.string())], ["request_id", "taken", "state"])


def closing_sets(
    graph: PathGraph, numbered: DataFrame, arrays: DataFrame, transitions: DataFrame, channels: DataFrame, max_rounds: int = MAX_ROUNDS
) -> DataFrame:
    """``request_id, action_ids, total_cost, state, bound`` of every request of ``arrays``.

    ``numbered`` has the permitted actions with their rank ``idx`` by id, ``arrays`` ids
    and costs in that order.  ``state`` is OPTIMAL, INFEASIBLE (no set closes it; no ids), or
    LIMIT when the node or round budget ended first; ``bound`` is a lower bound of the cost.
    """
    outcome = F.when(F.col("verified"), F.col("result_state")).otherwise("UNKNOWN")
    own = numbered.select("request_id", "action_id", "idx")
    effects = transitions.join(own, ["request_id", "action_id"]).groupBy("request_id", "target", "target_id", "idx").agg(F.max(outcome).alias("outcome"))
    touching = Stored(
        effects.groupBy("request_id", "target", "target_id").agg(F.collect_list(F.struct("idx", "outcome")).alias("effects")), "touching"
    ).df
    base = graph.channels.select("request_id", "name", "stratum", F.lit(-1).alias("idx"), "mandatory", "decision")
    added = channels.join(own, ["request_id", "action_id"]).select("request_id", "name", "stratum", "idx", "mandatory", "decision")
    last = F.max(F.struct(F.coalesce("mandatory", F.lit(False)).alias("mandatory"), F.coalesce("decision", F.lit("")).alias("decision")))
    merged = base.unionByName(added).groupBy("request_id", "name", "stratum", "idx").agg(last.alias("c"))
    entries = Stored(
        merged.groupBy("request_id", "name", "stratum").agg(F.collect_list(F.struct("idx", "c.mandatory", "c.decision")).alias("entries")), "channel-entries"
    ).df
    kind = arrays.schema["request_id"].dataType.simpleString()
    open_ = Stored(arrays.select("request_id", _numbers().alias("taken"), F.lit("OPTIMAL").alias("state")), "chosen-0")
    clauses: list[Stored] = []
    done: list[Stored] = []
    while True:
        taken = open_.df.where("state = 'OPTIMAL'").select("request_id", "taken")
        selected = taken.select("request_id", F.explode("taken").alias("idx")).join(own, ["request_id", "idx"]).select("request_id", "action_id")
        keep = lambda df: df.join(taken.select("request_id"), "request_id", "left_semi")
        mine = replace(graph, **{n: keep(getattr(graph, n)) for n in ("nodes", "edges", "channels", "requests", "request_nodes", "request_channels")})
        after = apply_actions(mine, selected, transitions, channels)
        states = {n: Stored(getattr(after, n), f"after-{n}").df for n in ("nodes", "edges")}
        walks = _walk_clauses(walk_elements(replace(after, **states)), touching, taken)
        broken = walks.unionByName(_channel_clauses(entries, graph.request_channels, taken))
        clauses.append(Stored(broken.distinct(), f"clauses-{len(clauses)}"))
        ended = open_.df.join(clauses[-1].df.select("request_id").distinct(), "request_id", "left_anti")
        done.append(Stored(ended, f"closed-{len(done)}"))
        still = open_.df.join(done[-1].df.select("request_id"), "request_id", "left_anti")
        if clauses[-1].is_empty():
            break
        if len(clauses) >= max_rounds:
            done.append(Stored(still.withColumn("state", F.lit("LIMIT")), "closed-late"))
            break
        gathered = union_stored(clauses).join(still.select("request_id"), "request_id", "left_semi").groupBy("request_id").agg(
            F.collect_set(F.struct("add", "drop")).alias("clauses")
        )
        rows = gathered.join(arrays.select("request_id", "costs"), "request_id").select("request_id", "clauses", "costs")
        open_ = Stored(rows.mapInArrow(_solve, f"request_id {kind}, taken array<int>, state string"), f"chosen-{len(clauses)}")
    ended = union_stored(done).join(arrays, "request_id")
    picked = lambda column: F.filter(column, lambda _, i: F.array_contains("taken", i))
    cost = F.aggregate(picked("costs"), F.lit(0).cast("long"), lambda a, x: a + x)
    optimal = F.col("state") == "OPTIMAL"
    return ended.select(
        "request_id",
        F.when(optimal, picked("ids")).alias("action_ids"),
        F.when(optimal, cost).alias("total_cost"),
        "state",
        F.when(F.col("state") == "INFEASIBLE", 0).otherwise(cost).cast("long").alias("bound"),
    )
