"""Recovery-graph discovery for users from the probes they triggered."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceless.operators import discovery as D
from traceless.operators import pathgraph as G
from traceless.operators import remediation as P
from traceless.operators import temporal as E
from traceless.plans import probe_tables  # noqa: F401
from traceless.plans.catalog import data_state, sources_of, table
from traceless.plans.workspace import Stored, shuffled
from traceless.queries.outcome_queries import rounded
from traceless.queries.registry import query
from traceless.queries.request_queries import BASE_CTES, path_graph


def catalogue(spark, sf) -> D.Catalogue:
    t = lambda n: table(spark, sf, n)
    return D.Catalogue(t("hyp_nodes"), t("hyp_edges"), t("probes"), t("probe_ops"), t("probe_checkpoints"))


_KEPT: dict = {}


def catalogue_facts(spark, sf):
    """Packed predictions, recurrence paths and signatures of the catalogue (small, kept as files)."""
    key = (spark.sparkContext.applicationId, sf, data_state(spark, sf, ["nation", "region"]))
    if key not in _KEPT:
        c = catalogue(spark, sf)
        predicted = Stored(D.pack_traces(D.predict_traces(c), c.checkpoints, ["graph_id"]), "predicted").df
        paths = Stored(D.recurrence_paths(c), "recurrence").df
        signatures = Stored(D.path_signature(paths, c), "signatures").df
        _KEPT[key] = (c, predicted, paths, signatures)
    return _KEPT[key]


def flattened(df):
    return df.withColumn("trace", (F.col("trace") != 0).cast("long"))


def version_space(spark, sf, flat: bool = False) -> D.VersionSpace:
    c, predicted, _, signatures = catalogue_facts(spark, sf)
    observed = D.pack_traces(table(spark, sf, "traces"), c.checkpoints, ["case_id"], flat)
    cases = table(spark, sf, "discovery_cases").select("case_id", "evidence_ok", "budget")
    return D.VersionSpace(flattened(predicted) if flat else predicted, observed, cases, signatures)


_TRUTH: dict = {}


def truth(spark, sf):
    """True traces, packed once; every step of a discovery reads them."""
    key = (spark.sparkContext.applicationId, sf, data_state(spark, sf, sources_of("truth_traces")))
    if key not in _TRUTH:
        c = catalogue(spark, sf)
        _TRUTH[key] = Stored(D.pack_traces(table(spark, sf, "truth_traces"), c.checkpoints, ["case_id"]), "truth")
    return _TRUTH[key].df


@query(
    "predicted_traces",
    """select c.case_id, e.probe_id, t.bucket, t.node_id, t.bit from {discovery_cases} c join {executed_probes} e using (case_id)
       join {trace_table} t on t.graph_id = c.truth_graph and t.probe_id = e.probe_id""",
)
def predicted_traces(spark, sf):
    predicted = D.predict_traces(catalogue(spark, sf)).withColumnRenamed("graph_id", "truth_graph")
    cases = table(spark, sf, "discovery_cases").select("case_id", "truth_graph").join(table(spark, sf, "executed_probes"), "case_id")
    return cases.join(predicted, ["truth_graph", "probe_id"]).select("case_id", "probe_id", "bucket", "node_id", "bit")


_DISTANCE = """select o.case_id, o.probe_id, t.graph_id, count(*) filter (o.bit <> t.bit) as distance from {traces} o
    join {trace_table} t on t.probe_id = o.probe_id and t.bucket = o.bucket and t.node_id = o.node_id group by all"""
_FLAT = """select o.case_id, o.probe_id, t.graph_id, (bool_or(o.bit) <> bool_or(t.bit))::int::bigint as distance from {traces} o
    join {trace_table} t on t.probe_id = o.probe_id and t.bucket = o.bucket and t.node_id = o.node_id group by all"""


@query(
    "trace_distances",
    "select d.case_id, d.probe_id, d.distance from {distances} d join {discovery_cases} c on c.case_id = d.case_id and c.truth_graph = d.graph_id",
    {"distances": _DISTANCE},
)
def trace_distances(spark, sf):
    c, predicted, _, _ = catalogue_facts(spark, sf)
    observed = D.pack_traces(table(spark, sf, "traces"), c.checkpoints, ["case_id"])
    cases = table(spark, sf, "discovery_cases").select("case_id", F.col("truth_graph").alias("graph_id"))
    joined = observed.join(cases, "case_id").join(
        predicted.withColumnRenamed("trace", "guess"), ["graph_id", "probe_id"]
    )
    return joined.select("case_id", "probe_id", D.trace_distance(F.col("trace"), F.col("guess")).alias("distance"))


_SIGNATURES = {
    "rpaths": """select graph_id, node_id, [node_id] as seen, []::varchar[] as edges, is_residual as stop from {hyp_nodes} where is_initial
        union all select r.graph_id, e.target_id, list_append(r.seen, e.target_id), list_append(r.edges, e.edge_id), n.is_residual
        from {rpaths} r join {hyp_edges} e on e.graph_id = r.graph_id and e.source_id = r.node_id join {hyp_nodes} n on n.graph_id = e.graph_id and n.node_id = e.target_id
        where not r.stop and not list_contains(r.seen, e.target_id)""",
    "sigs": """select g.graph_id, coalesce(string_agg(array_to_string(edges, '>'), '|' order by array_to_string(edges, '>')), 'none') as signature, count(r.graph_id) as paths
        from (select distinct graph_id from {hyp_nodes}) g left join (select * from {rpaths} where stop) r using (graph_id) group by g.graph_id""",
}


def _space(distance: str) -> dict[str, str]:
    return {
        "distances": distance,
        **_SIGNATURES,
        "alive": """select c.case_id, g.graph_id from {discovery_cases} c cross join {sigs} g
            where not c.evidence_ok or not exists (select 1 from {distances} d where d.case_id = c.case_id and d.graph_id = g.graph_id and d.distance > c.budget)""",
        "space": """select c.case_id, case when not evidence_ok then 'UNVERIFIED' when coalesce(n, 0) = 0 then 'OUT_OF_HYPOTHESIS' when any_bit = false then 'NO_OBSERVED_RECURRENCE'
            when n = 1 then 'GRAPH_DISCOVERED' when classes = 1 then 'PATH_CLASS_DISCOVERED' else 'EQUIVALENCE_CLASS' end as verdict, coalesce(n, 0) as survivors, first_graph
            from {discovery_cases} c left join (select case_id, count(*) as n, min(graph_id) as first_graph, count(distinct signature) as classes from {alive} join {sigs} using (graph_id) group by 1) a using (case_id)
            left join (select case_id, bool_or(bit) as any_bit from {traces} group by 1) o using (case_id)""",
    }


@query("version_space_verdicts", "select * from {space}", _space(_DISTANCE))
def version_space_verdicts(spark, sf):
    return version_space(spark, sf).verdicts()


@query("version_space_flat", "select * from {space}", _space(_FLAT))
def version_space_flat(spark, sf):
    return version_space(spark, sf, flat=True).verdicts()


@query("surviving_graphs", "select case_id, graph_id from {alive}", _space(_DISTANCE))
def surviving_graphs(spark, sf):
    return version_space(spark, sf).survivor_rows()


@query(
    "shortest_inconsistency",
    """select case_id, m.distance, m.graph_id, m.probe_id from (select case_id, arg_min(struct_pack(distance := distance, graph_id := graph_id, probe_id := probe_id), (distance, graph_id, probe_id)) as m
       from {distances} where case_id in (select case_id from {space} where verdict = 'OUT_OF_HYPOTHESIS') group by case_id)""",
    _space(_DISTANCE),
)
def shortest_inconsistency(spark, sf):
    return version_space(spark, sf).shortest_inconsistency()


@query(
    "case_path_signatures",
    "select case_id, truth_graph, signature, paths from {discovery_cases} join {sigs} on graph_id = truth_graph",
    _SIGNATURES,
)
def case_path_signatures(spark, sf):
    c = catalogue(spark, sf)
    signatures = D.path_signature(D.recurrence_paths(c), c).withColumnRenamed("graph_id", "truth_graph")
    return table(spark, sf, "discovery_cases").select("case_id", "truth_graph").join(signatures, "truth_graph")


@query(
    "case_relevant_edges",
    "select distinct case_id, unnest(edges) as edge_id from {discovery_cases} join {rpaths} on graph_id = truth_graph where stop",
    {"rpaths": _SIGNATURES["rpaths"]},
)
def case_relevant_edges(spark, sf):
    edges = D.relevant_edges(D.recurrence_paths(catalogue(spark, sf))).withColumnRenamed("graph_id", "truth_graph")
    return table(spark, sf, "discovery_cases").select("case_id", "truth_graph").join(edges, "truth_graph").select("case_id", "edge_id")


def states(spark, sf):
    survivors = version_space(spark, sf).survivor_rows()
    return Stored(D.knowledge_states(survivors, table(spark, sf, "executed_probes")), "states").df


_SELECTION = {
    **_space(_DISTANCE),
    "words": "select graph_id, probe_id, string_agg(bit::int, '' order by bucket, node_id) as word from {trace_table} group by all",
    "parts": """select a.case_id, w.probe_id, w.word, count(*) as size from {alive} a join {words} w using (graph_id)
        where not exists (select 1 from {executed_probes} e where e.case_id = a.case_id and e.probe_id = w.probe_id) group by all""",
    "scores": """select s.*, p.declared_cost from (select case_id, probe_id, max(size) as largest, sum(size * size)::bigint as squares from {parts} group by all having count(*) > 1) s join {probes} p using (probe_id)""",
}


def _selected(spark, sf, strategy):
    c, predicted, _, _ = catalogue_facts(spark, sf)
    keyed = states(spark, sf)
    choice = D.select_probe(keyed.select("state_id", "graphs", "used").distinct(), predicted, c.probes, strategy)
    return keyed.select("case_id", "state_id").join(choice, "state_id").select("case_id", "probe_id", "largest", "squares")


@query(
    "probe_selection_minimax",
    "select case_id, b.probe_id, b.largest, b.squares from (select case_id, arg_min(struct_pack(probe_id := probe_id, largest := largest, squares := squares), (largest, squares, declared_cost, probe_id)) as b from {scores} group by 1)",
    _SELECTION,
)
def probe_selection_minimax(spark, sf):
    return _selected(spark, sf, "minimax")


@query(
    "probe_selection_greedy_pairs",
    "select case_id, b.probe_id, b.largest, b.squares from (select case_id, arg_min(struct_pack(probe_id := probe_id, largest := largest, squares := squares), (squares, declared_cost, probe_id)) as b from {scores} group by 1)",
    _SELECTION,
)
def probe_selection_greedy_pairs(spark, sf):
    return _selected(spark, sf, "greedy-pairs")


def run_discovery(spark, sf, strategy):
    c, predicted, _, _ = catalogue_facts(spark, sf)
    cases = table(spark, sf, "discovery_cases").select("case_id", "evidence_ok", "budget")
    return D.discover(predicted, c.probes, cases, truth(spark, sf), strategy)


@query("active_discovery")
def active_discovery(spark, sf):
    return run_discovery(spark, sf, "minimax").withColumn("graphs", F.array_join("graphs", ","))


@query("random_discovery")
def random_discovery(spark, sf):
    return run_discovery(spark, sf, "random").withColumn("graphs", F.array_join("graphs", ","))


@query("discovery_log_check")
def discovery_log_check(spark, sf):
    c, predicted, _, _ = catalogue_facts(spark, sf)
    every = F.array(*[F.lit(g) for g in sorted(probe_tables.GRAPHS)])
    log = run_discovery(spark, sf, "minimax")
    previous = log.select("case_id", (F.col("step") + 1).alias("step"), F.col("graphs").alias("before_graphs"))
    recorded = log.join(shuffled(previous), ["case_id", "step"], "left").select(
        "case_id", "step", "probe_id", "trace",
        F.coalesce("before_graphs", every).alias("before_graphs"),
        # A forged record: the version space after the step is left unchanged.
        F.when(F.col("case_id").like("%7"), F.coalesce("before_graphs", every)).otherwise(F.col("graphs")).alias("after_graphs"),
    )
    cases = table(spark, sf, "discovery_cases").select("case_id", "budget")
    return D.verify_discovery_log(recorded, predicted, c.probes, cases)


def hitting_sets(spark, sf):
    c, _, paths, _ = catalogue_facts(spark, sf)
    return P.min_hitting_sets(D.path_operations(paths, c))


_HITTING = {
    **_SIGNATURES,
    "pops": "select r.graph_id, array_to_string(r.edges, '>') as path_id, list_sort(list_distinct(list(e.operation_id))) as ops from {rpaths} r join {hyp_edges} e on e.graph_id = r.graph_id and list_contains(r.edges, e.edge_id) where stop group by all",
    "gops": "select graph_id, list_sort(list_distinct(flatten(list(ops)))) as ops from {pops} group by graph_id",
    "subs": "select graph_id, list_filter(ops, lambda x, i: (m.mask >> (i - 1)) & 1 = 1) as chosen from {gops}, lateral (select unnest(range(1, (1 << len(ops))::bigint)) as mask) m",
    "hit": "select s.graph_id, s.chosen, len(s.chosen) as size from {subs} s where not exists (select 1 from {pops} p where p.graph_id = s.graph_id and not list_has_any(p.ops, s.chosen))",
    "best": "select graph_id, chosen, size from {hit} h where size = (select min(size) from {hit} x where x.graph_id = h.graph_id)",
}


@query(
    "minimum_hitting_sets",
    "select case_id, size, array_to_string(chosen, '+') as operations from {discovery_cases} join {best} on graph_id = truth_graph",
    _HITTING,
)
def minimum_hitting_sets(spark, sf):
    sets = hitting_sets(spark, sf).select(
        F.col("graph_id").alias("truth_graph"), "size", F.array_join("operations", "+").alias("operations")
    )
    return table(spark, sf, "discovery_cases").select("case_id", "truth_graph").join(sets, "truth_graph").drop("truth_graph")


def actions(spark, sf):
    c = catalogue_facts(spark, sf)[0]
    sets = hitting_sets(spark, sf).groupBy("graph_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.array_join("operations", "+"))), ";").alias("action")
    )
    graphs = c.nodes.select("graph_id").distinct()
    return graphs.join(sets, "graph_id", "left").select("graph_id", F.coalesce("action", F.lit("")).alias("action"))


def probe_groups(spark, sf):
    """Distinct sets of executed probes with the predictions of their probes."""
    predicted = catalogue_facts(spark, sf)[1]
    sets = table(spark, sf, "executed_probes").groupBy("case_id").agg(
        F.array_join(F.array_sort(F.collect_set("probe_id")), ",").alias("probe_set")
    )
    distinct = sets.select("probe_set").distinct()
    return distinct.withColumn("probe_id", F.explode(F.split("probe_set", ","))).join(predicted, "probe_id")


_IDENT = {
    **_HITTING,
    "acts": "select g.graph_id, coalesce(string_agg(array_to_string(chosen, '+'), ';' order by array_to_string(chosen, '+')), '') as action from {sigs} g left join {best} using (graph_id) group by 1",
    "words": _SELECTION["words"],
    "psets": "select distinct probe_set from (select case_id, string_agg(probe_id, ',' order by probe_id) as probe_set from {executed_probes} group by 1)",
    "pgroups": "select probe_set, w.* from {psets}, {words} w where list_contains(string_split(probe_set, ','), w.probe_id)",
    "vectors": "select probe_set, graph_id, string_agg(word, ',' order by probe_id) as traces from {pgroups} group by all",
}


@query(
    "action_identifiability",
    """select l.probe_set, l.graph_id as left_graph, r.graph_id as right_graph, la.action as left_action, ra.action as right_action from {vectors} l join {vectors} r
       on l.probe_set = r.probe_set and l.traces = r.traces and l.graph_id < r.graph_id join {acts} la on la.graph_id = l.graph_id join {acts} ra on ra.graph_id = r.graph_id where la.action <> ra.action""",
    _IDENT,
)
def action_identifiability(spark, sf):
    vectors = D.trace_vectors(probe_groups(spark, sf), ["probe_set"])
    return D.identifiability(vectors, actions(spark, sf), ["probe_set"])


@query(
    "information_bounds",
    """select probe_set, classes, max_outcomes, case when classes <= 1 then 0 when max_outcomes <= 1 then null else ceil(ln(classes) / ln(max_outcomes) - 1e-9)::bigint end as least_probes from
       (select probe_set, max(o) as max_outcomes from (select probe_set, probe_id, count(distinct word) as o from {pgroups} group by all) group by 1), (select count(distinct action) as classes from {acts})""",
    _IDENT,
)
def information_bounds(spark, sf):
    return D.information_bound(probe_groups(spark, sf), actions(spark, sf), ["probe_set"])


@query(
    "policy_replay",
    """select c.case_id, m.graphs as action, 3::bigint as cost, 1::bigint as probes, 'ENDED' as status from {discovery_cases} c
       left join {tw} f on f.case_id = c.case_id and f.probe_id = 'p3'
       left join (select word, string_agg(graph_id, ',' order by graph_id) as graphs from {words} where probe_id = 'p3' group by word) m using (word)""",
    {
        "words": _SELECTION["words"],
        "tw": "select case_id, probe_id, string_agg(bit::int, '' order by bucket, node_id) as word from {truth_traces} group by all",
    },
)
def policy_replay(spark, sf):
    """One-probe policy: run p3, then act on the graphs that share the observed trace."""
    c, predicted, _, _ = catalogue_facts(spark, sf)
    classes = predicted.where("probe_id = 'p3'").groupBy("trace").agg(
        F.array_join(F.array_sort(F.collect_set("graph_id")), ",").alias("graphs")
    )
    leaf = F.concat(F.lit("leaf-"), F.col("trace").cast("string"))
    root = c.probes.where("probe_id = 'p3'").select(
        F.lit("root").alias("state"), F.lit(None).cast("string").alias("action"), "probe_id", F.col("declared_cost").cast("long").alias("declared_cost")
    )
    policy = root.unionByName(
        classes.select(leaf.alias("state"), F.col("graphs").alias("action"), F.lit(None).cast("string").alias("probe_id"), F.lit(None).cast("long").alias("declared_cost"))
    )
    branches = classes.select(F.lit("root").alias("state"), "trace", leaf.alias("next_state"))
    cases = table(spark, sf, "discovery_cases").select("case_id", F.lit("root").alias("state"))
    return D.replay_policy(policy, branches, cases, truth(spark, sf))


def _trials(spark, sf, flat):
    space = version_space(spark, sf, flat)
    graphs = space.survivor_rows().groupBy("case_id").agg(F.collect_set("graph_id").alias("graphs"))
    probes = table(spark, sf, "executed_probes").groupBy("case_id").agg(F.count(F.lit(1)).alias("probes"))
    cases = table(spark, sf, "discovery_cases").select("case_id", "truth_graph", "truth_known")
    joined = space.verdicts().join(cases, "case_id").join(graphs, "case_id", "left").join(probes, "case_id", "left")
    return joined.select(
        F.lit("flat" if flat else "full").alias("strategy"), "verdict", "truth_graph", "truth_known",
        F.coalesce("graphs", F.array().cast("array<string>")).alias("graphs"), F.coalesce("probes", F.lit(0)).alias("probes"),
    )


def _metrics_sql(strategy: str, space: str, alive: str) -> str:
    return f"""select '{strategy}' as strategy, count(*) filter (act and not (truth_known and inside)) as false_confident, count(*) filter (truth_known and verdict = 'GRAPH_DISCOVERED' and inside) as exact_recovery,
        count(*) filter (truth_known and verdict = 'PATH_CLASS_DISCOVERED' and inside) as path_class_recovery, count(*) filter (verdict = 'OUT_OF_HYPOTHESIS') as out_of_hypothesis,
        count(*) filter (verdict = 'UNVERIFIED') as unverified, coalesce(sum(np), 0)::bigint as probe_count,
        round(case when count(*) filter (many) > 0 then count(*) filter (many and inside) / count(*) filter (many)::double else 1.0 end, 6) as containment_rate
        from (select s.*, c.truth_known, verdict in ('GRAPH_DISCOVERED', 'PATH_CLASS_DISCOVERED', 'EQUIVALENCE_CLASS') as act, truth_known and verdict in ('PATH_CLASS_DISCOVERED', 'EQUIVALENCE_CLASS') as many,
          exists (select 1 from {{{alive}}} a where a.case_id = s.case_id and a.graph_id = c.truth_graph) as inside, (select count(*) from {{executed_probes}} e where e.case_id = s.case_id) as np
          from {{{space}}} s join {{discovery_cases}} c using (case_id))"""


_FLAT_SPACE = {k + "_f" if k in ("distances", "alive", "space") else k: v for k, v in _space(_FLAT).items()}
for _k in ("alive_f", "space_f"):
    _FLAT_SPACE[_k] = _FLAT_SPACE[_k].replace("{distances}", "{distances_f}").replace("{alive}", "{alive_f}")


@query(
    "discovery_metrics",
    _metrics_sql("full", "space", "alive") + " union all " + _metrics_sql("flat", "space_f", "alive_f"),
    {**_space(_DISTANCE), **{k: v for k, v in _FLAT_SPACE.items() if k.endswith("_f")}},
)
def discovery_metrics(spark, sf):
    trials = _trials(spark, sf, False).unionByName(_trials(spark, sf, True))
    return rounded(D.discovery_metrics(trials))


def envelope(spark, sf):
    """Scenario tables per distinct set of surviving graphs, and each case's set."""
    c, _, paths, _ = catalogue_facts(spark, sf)
    keyed = D.knowledge_states(version_space(spark, sf).survivor_rows(), table(spark, sf, "executed_probes").limit(0))
    keyed = Stored(keyed.select("case_id", "graphs", "state_id"), "envelope-states").df
    groups = Stored(
        keyed.select("state_id", "graphs").distinct().select(F.col("state_id").alias("case_id"), F.explode("graphs").alias("graph_id")),
        "envelope-groups",
    ).df
    return keyed, D.graphs_to_scenarios(groups, paths, c)


_ENVELOPE = {
    **_space(_DISTANCE),
    "gedges": "select graph_id, list_sort(list_distinct(flatten(list(edges)))) as edges from {rpaths} where stop group by 1",
    "env": """select a.case_id, a.graph_id as scenario_id, len(list_filter(coalesce(g.edges, []), lambda x: not list_contains(coalesce(n.edges, []), x))) + len(list_filter(coalesce(n.edges, []), lambda x: not list_contains(coalesce(g.edges, []), x))) as mutation_count,
        g.edges is not null as valid from {alive} a join (select case_id, min(graph_id) as nominal from {alive} group by 1) m using (case_id) left join {gedges} g on g.graph_id = a.graph_id left join {gedges} n on n.graph_id = m.nominal""",
}


@query("discovered_scenarios", "select case_id, scenario_id, mutation_count::bigint as mutation_count, valid from {env}", _ENVELOPE)
def discovered_scenarios(spark, sf):
    keyed, (_, _, _, cases, _) = envelope(spark, sf)
    return keyed.select(F.col("case_id"), "state_id").join(
        cases.withColumnRenamed("case_id", "state_id"), "state_id"
    ).select("case_id", "scenario_id", "mutation_count", "valid")


@query(
    "subject_propagation",
    """select case_id, subject, array_to_string(list_sort(list_distinct(list(node_id))), ',') as reached from {moved} join {discovery_cases} on graph_id = truth_graph group by case_id, subject""",
    {
        "moved": """select distinct graph_id, s.subject, s.subject = 'target' as is_target, node_id from {hyp_nodes}, (select 'target' as subject union all select 'retained') s where is_initial
            union select m.graph_id, m.subject, m.is_target, e.target_id from {moved} m join {hyp_edges} e on e.graph_id = m.graph_id and e.source_id = m.node_id where not (m.is_target and e.operation_id in ('o1', 'o2'))""",
    },
)
def subject_propagation(spark, sf):
    c = catalogue_facts(spark, sf)[0]
    guards = c.edges.where("operation_id in ('o1', 'o2')").select("graph_id", "edge_id")
    who = F.explode(F.array(F.lit("target"), F.lit("retained")))
    nodes = c.nodes.where("is_initial").withColumn("subject", who).withColumn("is_target", F.col("subject") == "target")
    reached = E.propagate(c.edges, nodes, guards).withColumnRenamed("graph_id", "truth_graph")
    joined = table(spark, sf, "discovery_cases").select("case_id", "truth_graph").join(reached, "truth_graph")
    return joined.groupBy("case_id", "subject").agg(F.array_join(F.array_sort(F.collect_set("node_id")), ",").alias("reached"))


@query(
    "final_certification",
    """select request_id, case when ev = 'INCOMPLETE' then 'INCOMPLETE' when not found or ev <> 'COMPLETE' then 'UNVERIFIED' else 'COMPLETE_WITHIN_ENVELOPE' end as verdict,
         case when found then 'COMPLETE' else 'UNVERIFIED' end as find_stage, ev as erase_stage,
         case when ev = 'INCOMPLETE' then 'INCOMPLETE' when not found or ev <> 'COMPLETE' then 'UNVERIFIED' else 'COMPLETE' end as prove_stage from (
       select coalesce(e.request_id, f.request_id) as request_id, coalesce(e.verdict, 'UNVERIFIED') as ev, coalesce(f.found, false) as found from {evaluated} e full join (
         select 's' || c.k as request_id, c.evidence_ok and s.verdict in ('GRAPH_DISCOVERED', 'PATH_CLASS_DISCOVERED', 'EQUIVALENCE_CLASS') and coalesce(x.valid, false) as found from {discovery_cases} c join {space} s using (case_id)
           left join (select case_id, bool_and(valid) as valid from {env} group by 1) x using (case_id)) f using (request_id))""",
    {**BASE_CTES, **_ENVELOPE},
)
def final_certification(spark, sf):
    keyed, (transitions, initial, residual, cases, controls) = envelope(spark, sf)
    cases = Stored(cases, "envelope-cases").df
    valid = cases.groupBy("case_id").agg(F.bool_and("valid").alias("reconciled"))
    usable = valid.where("reconciled").select("case_id")
    keep = lambda df: df.join(usable, "case_id", "left_semi")
    plan = E.robust_controls(
        keep(transitions), keep(initial), keep(residual), keep(cases).withColumn("complete", F.lit(True)), keep(controls)
    )
    per_state = valid.join(plan.select("case_id", "status"), "case_id", "left").withColumnRenamed("case_id", "state_id")
    people = table(spark, sf, "discovery_cases").select(
        "case_id", F.concat(F.lit("s"), F.col("k").cast("string")).alias("request_id"), "evidence_ok"
    )
    joined = (
        people.join(version_space(spark, sf).verdicts().select("case_id", "verdict"), "case_id")
        .join(keyed.select("case_id", "state_id"), "case_id", "left")
        .join(per_state, "state_id", "left")
    )
    find = joined.select("request_id", F.col("verdict").alias("find_verdict"), "evidence_ok", F.coalesce("reconciled", F.lit(False)).alias("reconciled"))
    prove = joined.where(F.col("status").isNotNull()).select("request_id", F.col("status").alias("prove_status"))
    erase = G.evaluate_requests(path_graph(spark, sf)).select("request_id", F.col("verdict").alias("erase_verdict"))
    return D.certify(find, erase, prove)
