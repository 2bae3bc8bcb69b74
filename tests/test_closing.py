"""Closing action sets by clauses against enumeration, at and beyond the lattice's limit."""

from __future__ import annotations

import random
from itertools import combinations

from test_planning import _evaluate
from traceless.functions.choices import least_assignment
from traceless.operators import pathgraph as G
from traceless.operators import remediation as P

SCHEMAS = {
    "nodes": "request_id string, node_id string, subject_id string, state string",
    "edges": "request_id string, edge_id string, source_id string, target_id string, state string, request_scoped boolean, subject_id string",
    "channels": "request_id string, name string, stratum string, mandatory boolean, decision string",
    "requests": "request_id string, subject_id string, max_exact_actions int",
    "rnodes": "request_id string, node_id string, role string",
    "rchannels": "request_id string, name string",
    "actions": "request_id string, action_id string, cost long, permitted boolean",
    "transitions": "request_id string, action_id string, target string, target_id string, result_state string, verified boolean",
    "achannels": "request_id string, action_id string, name string, stratum string, mandatory boolean, decision string",
}


def add(rows, request, nodes, edges, channels, sources, sinks, prices, effects, results, limit=None, owner=None):
    rows["nodes"] += [(request, n, owner or request, s) for n, s in nodes.items()]
    rows["edges"] += [(request, e, a, b, s, False, "") for e, a, b, s in edges]
    rows["channels"] += [(request, c, "", True, d) for c, d in channels.items()]
    rows["requests"].append((request, request, limit))
    rows["rnodes"] += [(request, n, "sink") for n in sinks] + [(request, n, "source") for n in sources]
    rows["rchannels"].append((request, "storage"))
    rows["actions"] += [(request, a, p, True) for a, p in prices.items()]
    rows["transitions"] += [(request, a, "NODE" if t in nodes else "EDGE", t, o, True) for a, es in effects.items() for t, o in es]
    rows["achannels"] += [(request, a, c, "", True, d) for a, cs in results.items() for c, d in cs.items()]


def plans(spark, rows, **options):
    f = {k: spark.createDataFrame(rows[k], s) for k, s in SCHEMAS.items()}
    graph = G.PathGraph(f["nodes"], f["edges"], f["channels"], f["requests"], f["rnodes"], f["rchannels"])
    found = P.min_cost_actions(graph, f["actions"], f["transitions"], f["achannels"], **options)
    return {r.request_id: r for r in found.collect()}


def test_clauses_find_the_sets_that_enumeration_finds(spark):
    rng = random.Random(23)
    rows, cases = {k: [] for k in SCHEMAS}, {}
    for r in range(14):
        many = 16 if r == 0 else 13 if r == 1 else rng.randint(0, 7)
        names = [f"n{i}" for i in range(6)]
        nodes = {n: rng.choice(["ACTIVE", "CLOSED", "UNKNOWN", "CLOSED"]) for n in names}
        edges = [(f"{a}{b}", a, b, rng.choice(["ACTIVE", "CLOSED", "UNKNOWN"])) for a in names for b in names if a != b and rng.random() < 0.25]
        channels = {"storage": rng.choice(["PASS", "FAIL", "UNKNOWN"])} if rng.random() < 0.8 else {}
        sinks, sources = set(rng.sample(names, 2)), {rng.choice(names)}
        prices, effects, results = {}, {}, {}
        for a in range(many):
            action = f"a{a:02d}"
            prices[action] = rng.randint(0, 6)
            picked = rng.sample([*names, *[e[0] for e in edges]], min(3, len(names) + len(edges)))
            effects[action] = [(t, rng.choice(["CLOSED", "CLOSED", "CLOSED", "UNKNOWN", "ACTIVE"])) for t in picked]
            if rng.random() < 0.5:
                results[action] = {"storage": rng.choice(["PASS", "PASS", "FAIL"])}
        case = (nodes, edges, channels, sources, sinks, prices, effects, results)
        cases[f"q{r:02d}"] = case
        add(rows, f"q{r:02d}", *case)
    got = plans(spark, rows, limit=0)
    closed = 0
    for request, (nodes, edges, own, sources, sinks, prices, effects, results) in cases.items():
        best = None
        for n in range(len(prices) + 1):
            for s in combinations(sorted(prices), n):
                key = (sum(prices[a] for a in s), n, list(s))
                if best is not None and key >= best:
                    continue
                if _evaluate(nodes, edges, own, sources, sinks, {"storage"}, s, effects, results)[0] == "COMPLETE":
                    best = key
        row = got[request]
        if best is None:
            assert row.solver_status == ("INFEASIBLE" if prices else row.solver_status)
        else:
            closed += bool(best[1])
            assert (row.total_cost, len(row.action_ids), row.action_ids) == best
            assert (row.solver_status, row.verdict, row.lower_bound, row.upper_bound) == ("OPTIMAL", "COMPLETE", best[0], best[0])
    assert closed > 3


def chain(many: int):
    """A walk per pair of nodes; a dear action closes all, one of two cheap ones each; one harmful action."""
    half = many // 2 - 1
    nodes = {"s": "ACTIVE", **{f"m{k:02}": "ACTIVE" for k in range(half)}, "t": "ACTIVE", "back": "CLOSED"}
    edges = [e for k in range(half) for e in ((f"in{k:02}", "s", f"m{k:02}", "ACTIVE"), (f"out{k:02}", f"m{k:02}", "t", "ACTIVE"))]
    edges += [("b1", "s", "back", "ACTIVE"), ("b2", "back", "t", "ACTIVE")]
    prices, effects = {"all": 10 * half, "zz": 1}, {"all": [("t", "CLOSED")], "zz": [("back", "CLOSED")]}
    for k in range(half):
        # the cheaper one of each pair opens the way back, which "zz" closes again
        prices |= {f"x{k:02}": 3, f"y{k:02}": 2}
        effects |= {f"x{k:02}": [(f"m{k:02}", "CLOSED")], f"y{k:02}": [(f"m{k:02}", "CLOSED"), ("back", "ACTIVE")]}
    return nodes, edges, {"storage": "PASS"}, {"s"}, {"t"}, prices, effects, {}


def test_limits_of_requests(spark):
    rows = {k: [] for k in SCHEMAS}
    add(rows, "q24", *chain(24), owner="another")
    add(rows, "q13", *chain(14), limit=13, owner="another")
    add(rows, "q14", *chain(14), limit=14, owner="another")
    got = plans(spark, rows)
    for request, half in (("q24", 11), ("q14", 6)):
        row = got[request]
        assert (row.solver_status, row.action_ids, row.total_cost) == ("OPTIMAL", [f"y{k:02}" for k in range(half)] + ["zz"], 2 * half + 1)
    assert got["q13"].solver_status in ("APPROXIMATE", "INFEASIBLE")


def test_least_assignment_matches_enumeration():
    rng = random.Random(2)
    for _ in range(500):
        n = rng.randrange(1, 8)
        clauses = [(rng.randrange(1 << n) & rng.randrange(1 << n), rng.randrange(1 << n) & rng.randrange(1 << n)) for _ in range(rng.randrange(0, 9))]
        costs = [rng.randrange(0, 5) for _ in range(n)]
        fits = [
            (sum(costs[i] for i in s), k, s)
            for k in range(n + 1)
            for s in combinations(range(n), k)
            if all(any(a >> i & 1 for i in s) or d & ~sum(1 << i for i in s) for a, d in clauses)
        ]
        found, state = least_assignment(clauses, costs, 10_000)
        assert (state, tuple(found)) == (("OPTIMAL", min(fits)[2]) if fits else ("INFEASIBLE", ()))
    many = [(3 << 2 * k, 0) for k in range(15)]
    taken, state = least_assignment(many, [1] * 30, 50)
    assert state == "LIMIT" and len(taken) <= 15
