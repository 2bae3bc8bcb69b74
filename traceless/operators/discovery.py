"""Discovery of hidden recovery graphs from probe traces.

Hypothesis graphs are a catalogue of at most a few thousand graphs; cases are
the large side.  A trace (checkpoints times buckets, at most 62 bits) is packed
into a long, and the set of graphs a case still allows is a label with one bit
per graph, so cases are never crossed with graphs.
"""

from __future__ import annotations

from itertools import count

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceless.functions.lattice import both, shift_left, without
from traceless.operators.ranking import group_rank
from traceless.plans.workspace import Stored, shuffled, union_stored


@dataclass(frozen=True)
class Catalogue:
    nodes: DataFrame  # graph_id, node_id, is_initial, is_residual
    edges: DataFrame  # graph_id, edge_id, source_id, target_id, operation_id
    probes: DataFrame  # probe_id, time_buckets, declared_cost
    operations: DataFrame  # probe_id, operation_id
    checkpoints: DataFrame  # probe_id, node_id


# --- traces ------------------------------------------------------------------


def predict_traces(catalogue: Catalogue) -> DataFrame:
    """Checkpoint bits per graph, probe and time bucket under the probe's operations."""
    steps = Stored(
        catalogue.edges.join(catalogue.operations, "operation_id").join(catalogue.probes, "probe_id").select(
            "graph_id", "probe_id", "source_id", "target_id", "time_buckets"
        ),
        "probe-steps",
    ).df
    start = catalogue.nodes.where("is_initial").select("graph_id", "node_id").crossJoin(
        catalogue.probes.select("probe_id")
    )
    keys = ["graph_id", "probe_id", "node_id"]
    found = [Stored(start.select(*keys, F.lit(0).alias("arrival")), "arrival-0")]
    bucket = 0
    while True:
        bucket += 1
        grown = (
            found[-1].df.withColumnRenamed("node_id", "source_id")
            .join(steps.where(F.col("time_buckets") >= bucket), ["graph_id", "probe_id", "source_id"])
            .select("graph_id", "probe_id", F.col("target_id").alias("node_id"))
            .distinct()
            .join(union_stored(found), keys, "left_anti")
            .withColumn("arrival", F.lit(bucket))
        )
        level = Stored(grown, f"arrival-{bucket}")
        if level.is_empty():
            break
        found.append(level)
    graphs = catalogue.nodes.select("graph_id").distinct()
    frame = (
        graphs.crossJoin(catalogue.checkpoints)
        .join(catalogue.probes, "probe_id")
        .withColumn("bucket", F.explode(F.sequence(F.lit(1), F.col("time_buckets"))))
    )
    return frame.join(union_stored(found), keys, "left").select(
        "graph_id", "probe_id", "bucket", "node_id", F.coalesce(F.col("arrival") <= F.col("bucket"), F.lit(False)).alias("bit")
    )


def _positions(checkpoints: DataFrame) -> DataFrame:
    order = Window.partitionBy("probe_id").orderBy("node_id")
    size = F.count(F.lit(1)).over(Window.partitionBy("probe_id"))
    return checkpoints.select(
        "probe_id", "node_id", (F.row_number().over(order) - 1).alias("place"), size.alias("width")
    )


def pack_traces(traces: DataFrame, checkpoints: DataFrame, keys: Sequence[str], flat: bool = False) -> DataFrame:
    """One long per (keys, probe): bit (bucket-1)*width + checkpoint rank; ``flat`` keeps only "any bit"."""
    placed = traces.join(F.broadcast(_positions(checkpoints)), ["probe_id", "node_id"])
    position = (F.col("bucket") - 1) * F.col("width") + F.col("place")
    too_long = F.raise_error(F.lit("a trace of more than 63 bits does not fit")).cast("long")
    position = F.when(position > 62, too_long).otherwise(position)
    value = F.when(F.col("bit"), shift_left(F.lit(1).cast("long"), position)).otherwise(F.lit(0).cast("long"))
    packed = placed.groupBy(*keys, "probe_id").agg(F.bit_or(value).alias("trace"))
    if flat:
        packed = packed.withColumn("trace", (F.col("trace") != 0).cast("long"))
    return packed


def trace_distance(a: Column, b: Column) -> Column:
    """Number of differing bits of two packed traces."""
    return F.bit_count(a.bitwiseXOR(b)).cast("long")


# --- recurrence paths --------------------------------------------------------


def recurrence_paths(catalogue: Catalogue) -> DataFrame:
    """Edge paths from an initial node to the first residual node, never repeating a node."""
    residual = catalogue.nodes.where("is_residual").select("graph_id", "node_id").withColumn("stop", F.lit(True))
    begin = catalogue.nodes.where("is_initial").select(
        "graph_id", "node_id", F.array("node_id").alias("seen"), F.array().cast("array<string>").alias("edges")
    )
    mark = lambda df: df.join(residual, ["graph_id", "node_id"], "left").withColumn("stop", F.coalesce("stop", F.lit(False)))
    links = catalogue.edges.select("graph_id", "edge_id", F.col("source_id").alias("node_id"), "target_id")
    found = [Stored(mark(begin), "recurrence-0")]
    while True:
        grown = (
            found[-1].df.where(~F.col("stop")).drop("stop")
            .join(links, ["graph_id", "node_id"])
            .where(~F.array_contains("seen", F.col("target_id")))
            .select(
                "graph_id",
                F.col("target_id").alias("node_id"),
                F.concat("seen", F.array("target_id")).alias("seen"),
                F.concat("edges", F.array("edge_id")).alias("edges"),
            )
        )
        level = Stored(mark(grown), f"recurrence-{len(found)}")
        if level.is_empty():
            break
        found.append(level)
    return union_stored(found).where("stop").select("graph_id", "edges")


def relevant_edges(paths: DataFrame) -> DataFrame:
    """Edges that lie on some recurrence path."""
    return paths.select("graph_id", F.explode("edges").alias("edge_id")).distinct()


def path_signature(paths: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Sorted set of recurrence paths of every graph, as one text."""
    texts = paths.select("graph_id", F.array_join("edges", ">").alias("p")).groupBy("graph_id").agg(
        F.array_join(F.array_sort(F.collect_set("p")), "|").alias("signature"), F.count(F.lit(1)).alias("n")
    )
    graphs = catalogue.nodes.select("graph_id").distinct()
    return graphs.join(texts, "graph_id", "left").select(
        "graph_id", F.coalesce("signature", F.lit("none")).alias("signature"), F.coalesce("n", F.lit(0)).alias("paths")
    )


def path_operations(paths: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Operation set of each recurrence path, as input of the hitting-set search."""
    named = paths.withColumn("path_id", F.array_join("edges", ">"))
    rows = named.select("graph_id", "path_id", F.explode_outer("edges").alias("edge_id"))
    ops = rows.join(catalogue.edges.select("graph_id", "edge_id", "operation_id"), ["graph_id", "edge_id"], "left")
    return ops.groupBy("graph_id", "path_id").agg(F.array_sort(F.collect_set("operation_id")).alias("operations"))


# --- version space -----------------------------------------------------------


class VersionSpace:
    """Graphs that stay compatible with every observation of a case.

    ``cases(case_id, evidence_ok, budget)``; ``observed(case_id, probe_id,
    trace)`` and ``predicted(graph_id, probe_id, trace)`` are packed traces.
    """

    def __init__(self, predicted: DataFrame, observed: DataFrame, cases: DataFrame, signatures: DataFrame):
        graphs = predicted.select("graph_id").distinct()
        ranked = group_rank(graphs, [], ["graph_id"], "idx")
        self.index = Stored(
            ranked.withColumn("idx", F.col("idx") - 1).select(
                "graph_id",
                "idx",
                F.floor(F.col("idx") / 64).alias("block"),
                shift_left(F.lit(1).cast("long"), F.col("idx") % 64).alias("own"),
            ),
            "graph-index",
        ).df
        self.predicted = predicted.join(self.index, "graph_id")
        self.observed = observed.join(shuffled(cases), "case_id")
        self.cases = cases
        self.signatures = signatures
        self.full = self.index.groupBy("block").agg(F.bit_or("own").alias("every"))

    def compatible(self, observations: DataFrame | None = None) -> DataFrame:
        """Label of compatible graphs per distinct (probe, trace, budget)."""
        observations = self.observed if observations is None else observations
        distinct = observations.select("probe_id", "trace", "budget").distinct()
        near = trace_distance(F.col("trace"), F.col("guess")) <= F.col("budget")
        guesses = self.predicted.select("probe_id", F.col("trace").alias("guess"), "block", "own")
        return (
            distinct.join(guesses, "probe_id")
            .groupBy("probe_id", "trace", "budget", "block")
            .agg(F.bit_or(F.when(near, F.col("own")).otherwise(0)).alias("label"))
        )

    def survivors(self) -> DataFrame:
        """Label per (case, block); untouched or unverifiable cases keep every graph."""
        compatible = Stored(self.compatible(), "compatible").df  # written, so that its size is known
        labels = self.observed.join(compatible, ["probe_id", "trace", "budget"])
        kept = labels.groupBy("case_id", "block").agg(F.bit_and("label").alias("label"))
        every = self.cases.select("case_id", "evidence_ok").crossJoin(F.broadcast(self.full))
        return every.join(shuffled(kept), ["case_id", "block"], "left").select(
            "case_id",
            "block",
            "evidence_ok",
            F.when(F.col("evidence_ok"), F.coalesce("label", "every")).otherwise(F.col("every")).alias("label"),
        )

    def survivor_rows(self) -> DataFrame:
        """One row per (case, surviving graph)."""
        alive = self.survivors().join(self.index, "block").where(both(F.col("label"), F.col("own")) != 0)
        return alive.select("case_id", "graph_id")

    def _class_labels(self) -> DataFrame:
        """Per graph and block: label of the graphs with the same path signature."""
        classes = self.index.join(self.signatures.select("graph_id", "signature"), "graph_id")
        per_class = classes.groupBy("signature", "block").agg(F.bit_or("own").alias("class_label"))
        return classes.select("graph_id", "signature").join(per_class, "signature").select("graph_id", "block", "class_label")

    def verdicts(self) -> DataFrame:
        """Discovery verdict, survivor count and first survivor per case."""
        labels = Stored(self.survivors(), "survivors").df
        first = labels.join(self.index, "block").where(both(F.col("label"), F.col("own")) != 0)
        counts = first.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.min("graph_id").alias("first_graph"))
        outside = (
            labels.join(shuffled(counts), "case_id")
            .join(self._class_labels().withColumnRenamed("graph_id", "first_graph"), ["first_graph", "block"], "left")
            .groupBy("case_id")
            .agg(
                F.bool_or(without(F.col("label"), F.coalesce("class_label", F.lit(0).cast("long"))) != 0).alias("mixed")
            )
        )
        seen = self.observed.groupBy("case_id").agg(F.bool_or(F.col("trace") != 0).alias("any_bit"))
        joined = (
            self.cases.select("case_id", "evidence_ok")
            .join(shuffled(counts), "case_id", "left")
            .join(shuffled(outside), "case_id", "left")
            .join(shuffled(seen), "case_id", "left")
        )
        verdict = (
            F.when(~F.col("evidence_ok"), "UNVERIFIED")
            .when(F.col("n").isNull(), "OUT_OF_HYPOTHESIS")
            .when(F.col("any_bit") == F.lit(False), "NO_OBSERVED_RECURRENCE")
            .when(F.col("n") == 1, "GRAPH_DISCOVERED")
            .when(~F.col("mixed"), "PATH_CLASS_DISCOVERED")
            .otherwise("EQUIVALENCE_CLASS")
        )
        return joined.select(
            "case_id", verdict.alias("verdict"), F.coalesce("n", F.lit(0)).alias("survivors"), "first_graph"
        )

    def shortest_inconsistency(self) -> DataFrame:
        """Smallest (distance, graph, probe) of every case that no graph explains."""
        lost = self.verdicts().where(F.col("verdict") == "OUT_OF_HYPOTHESIS").select("case_id")
        pairs = self.observed.select("probe_id", "trace").distinct().join(
            self.predicted.select("probe_id", F.col("trace").alias("guess"), "graph_id"), "probe_id"
        )
        nearest = pairs.groupBy("probe_id", "trace").agg(
            F.min(F.struct(trace_distance(F.col("trace"), F.col("guess")).alias("distance"), "graph_id")).alias("near")
        )
        joined = self.observed.join(shuffled(lost), "case_id", "left_semi").join(nearest, ["probe_id", "trace"])
        key = F.struct("near.distance", "near.graph_id", "probe_id")
        return joined.groupBy("case_id").agg(F.min(key).alias("m")).select(
            "case_id", "m.distance", "m.graph_id", "m.probe_id"
        )


# --- probe selection ---------------------------------------------------------

# Order keys among the probes that separate the surviving graphs.
STRATEGIES: dict[str, tuple[str, ...]] = {
    "minimax": ("largest", "squares", "declared_cost", "probe_id"),
    "greedy-pairs": ("squares", "declared_cost", "probe_id"),
    "random": ("probe_id",),
    "exhaustive": ("probe_id",),
}


def probe_scores(states: DataFrame, predicted: DataFrame, probes: DataFrame) -> DataFrame:
    """Partition scores of every unused probe for each knowledge state.

    ``states(state_id, graphs array, used array)``: distinct states, so cases
    with equal knowledge share one computation.
    """
    rows = states.select("state_id", "used", F.explode("graphs").alias("graph_id")).join(
        predicted.select("graph_id", "probe_id", "trace"), "graph_id"
    )
    fresh = rows.where(~F.array_contains("used", F.col("probe_id")))
    parts = fresh.groupBy("state_id", "probe_id", "trace").agg(F.count(F.lit(1)).alias("size"))
    scores = parts.groupBy("state_id", "probe_id").agg(
        F.max("size").alias("largest"),
        F.sum(F.col("size") * F.col("size")).alias("squares"),
        (F.count(F.lit(1)) > 1).alias("separates"),
    )
    return scores.join(probes.select("probe_id", "declared_cost"), "probe_id")


def select_probe(states: DataFrame, predicted: DataFrame, probes: DataFrame, strategy: str = "minimax") -> DataFrame:
    """Chosen probe per knowledge state; for ``random`` the sorted list of candidates as well."""
    scores = probe_scores(states, predicted, probes)
    usable = scores if strategy == "exhaustive" else scores.where("separates")
    order = F.struct(*[F.col(c) for c in STRATEGIES[strategy]])
    return usable.groupBy("state_id").agg(
        F.min_by(F.struct("probe_id", "largest", "squares", "declared_cost"), order).alias("best"),
        F.array_sort(F.collect_list("probe_id")).alias("candidates"),
    ).select("state_id", "best.probe_id", "best.largest", "best.squares", "best.declared_cost", "candidates")


def knowledge_states(survivors: DataFrame, used: DataFrame) -> DataFrame:
    """(case_id, graphs, used, state_id) from surviving graphs and used probes."""
    graphs = survivors.groupBy("case_id").agg(F.array_sort(F.collect_set("graph_id")).alias("graphs"))
    probes = used.groupBy("case_id").agg(F.array_sort(F.collect_set("probe_id")).alias("used"))
    joined = graphs.join(shuffled(probes), "case_id", "left").withColumn("used", F.coalesce("used", F.array().cast("array<string>")))
    return joined.withColumn("state_id", _state_id())


def _state_id() -> Column:
    return F.sha2(F.concat_ws("#", F.array_join("graphs", ","), F.array_join("used", ",")), 256)


def discover(
    predicted: DataFrame,
    probes: DataFrame,
    cases: DataFrame,
    trace_oracle: DataFrame | Callable[[DataFrame], DataFrame],
    strategy: str = "minimax",
    seed: int = 0,
    max_steps: int | None = None,
) -> DataFrame:
    """Active discovery of all cases at once: choose a probe, look up its trace, filter, repeat.

    ``trace_oracle`` is a frame ``(case_id, probe_id, trace)`` or a callable from
    requested ``(case_id, probe_id)`` rows to such a frame.  Returns one log row
    per executed step with the surviving graphs after it.
    """
    every = predicted.select("graph_id").distinct().agg(F.array_sort(F.collect_set("graph_id")).alias("graphs"))
    none = F.array().cast("array<string>")
    state = Stored(
        cases.where("evidence_ok").select("case_id", "budget").crossJoin(F.broadcast(every)).withColumn("used", none),
        "discover-0",
    )
    log: list[Stored] = []
    guesses = Stored(predicted.select("graph_id", "probe_id", F.col("trace").alias("guess")), "guesses").df
    # every step uses up a probe, so a case ends after as many steps as there are probes
    for step in count(1) if max_steps is None else range(1, max_steps + 1):
        keyed = state.df.withColumn("state_id", _state_id())
        distinct = keyed.select("state_id", "graphs", "used").distinct()
        choice = Stored(select_probe(distinct, predicted, probes, strategy), f"choice-{step}").df
        chosen_case = keyed.join(choice.select("state_id", "probe_id", "candidates"), "state_id")
        if strategy == "random":
            pick = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), "case_id", F.lit(step)), 256), 1, 8), 16, 10).cast("long"), F.size("candidates"))
            chosen_case = chosen_case.withColumn("probe_id", F.element_at("candidates", pick.cast("int") + 1))
        asked = chosen_case.select("case_id", "probe_id", "budget", "graphs", "used")
        answers = trace_oracle(asked.select("case_id", "probe_id")) if callable(trace_oracle) else trace_oracle
        seen = asked.join(shuffled(answers.select("case_id", "probe_id", "trace")), ["case_id", "probe_id"])
        # Graphs ruled in by (probe, trace, budget): few distinct rows, joined back to the cases.
        fits = (
            seen.select("probe_id", "trace", "budget").distinct().join(guesses, "probe_id")
            .where(trace_distance(F.col("trace"), F.col("guess")) <= F.col("budget"))
            .groupBy("probe_id", "trace", "budget").agg(F.collect_set("graph_id").alias("fit"))
        )
        after = (
            seen.join(fits, ["probe_id", "trace", "budget"], "left")
            .select(
                "case_id",
                "budget",
                F.array_sort(F.array_intersect("graphs", F.coalesce("fit", none))).alias("graphs"),
                F.array_sort(F.array_append("used", F.col("probe_id"))).alias("used"),
                F.lit(step).alias("step"),
                "probe_id",
                "trace",
                F.size("graphs").alias("before"),
            )
        )
        level = Stored(after, f"discover-{step}")
        if level.is_empty():
            break
        log.append(level)
        # A case whose version space is empty stops; others go on while a probe separates.
        state = Stored(level.df.where(F.size("graphs") > 0).select("case_id", "budget", "graphs", "used"), f"open-{step}")
    if not log:
        return state.df.limit(0).select("case_id", F.lit(0).alias("step"), F.lit("").alias("probe_id"), F.lit(0).cast("long").alias("trace"), "graphs")
    return union_stored(log).select("case_id", "step", "probe_id", "trace", "before", "graphs")


def identifiability(vectors: DataFrame, actions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Graph pairs with equal traces under every probe of a group but different control sets."""
    rows = vectors.join(actions, "graph_id")
    right = rows.select(*by, F.col("graph_id").alias("right_graph"), "traces", F.col("action").alias("right_action"))
    return rows.join(right, [*by, "traces"]).where(
        (F.col("graph_id") < F.col("right_graph")) & (F.col("action") != F.col("right_action"))
    ).select(*by, F.col("graph_id").alias("left_graph"), "right_graph", F.col("action").alias("left_action"), "right_action")


def trace_vectors(predicted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All traces of a graph in probe order, as one text."""
    rows = predicted.groupBy(*by, "graph_id").agg(
        F.array_sort(F.collect_list(F.struct("probe_id", "trace"))).alias("v")
    )
    text = F.array_join(F.transform("v", lambda x: x["trace"].cast("string")), ",")
    return rows.select(*by, "graph_id", text.alias("traces"))


def information_bound(predicted: DataFrame, actions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per probe group: action classes, largest number of outcomes and the least number of probes."""
    outcomes = predicted.groupBy(*by, "probe_id").agg(F.countDistinct("trace").alias("o"))
    outcomes = outcomes.groupBy(*by).agg(F.max("o").alias("max_outcomes"))
    classes = actions.agg(F.countDistinct("action").alias("classes"))
    joined = outcomes.crossJoin(F.broadcast(classes))
    # Smallest p with max_outcomes^p >= classes; powers of small integers are exact doubles.
    powers = F.filter(
        F.sequence(F.lit(0), F.lit(62)),
        lambda p: F.pow(F.col("max_outcomes").cast("double"), p) >= F.col("classes"),
    )
    bound = F.when(F.col("classes") <= 1, 0).when(F.col("max_outcomes") <= 1, F.lit(None)).otherwise(F.element_at(powers, 1))
    return joined.select(*by, "classes", "max_outcomes", bound.cast("long").alias("least_probes"))


def replay_policy(policy: DataFrame, branches: DataFrame, cases: DataFrame, trace_oracle: DataFrame, max_steps: int = 64) -> DataFrame:
    """Walk a decision table per case: ``policy(state, action, probe_id, declared_cost)`` and
    ``branches(state, trace, next_state)``; ends at an action or without a branch.

    Cases that are still open after ``max_steps`` probes come back without an
    action and with the status ``OPEN_AT_LIMIT``, all others with ``ENDED``.
    """
    current = Stored(
        cases.select("case_id", "state", F.lit(0).cast("long").alias("cost"), F.lit(0).cast("long").alias("probes")), "policy-0"
    )
    done: list[Stored] = []
    for step in range(1, max_steps + 1):
        here = Stored(current.df.join(policy, "state", "left"), f"policy-here-{step}").df
        ended = here.where(F.col("action").isNotNull() | F.col("probe_id").isNull()).select("case_id", "action", "cost", "probes")
        done.append(Stored(ended, f"policy-done-{step}"))
        asked = (
            here.where(F.col("action").isNull() & F.col("probe_id").isNotNull())
            .join(shuffled(trace_oracle.select("case_id", "probe_id", "trace")), ["case_id", "probe_id"], "left")
            .join(branches, ["state", "trace"], "left")
            .select(
                "case_id", F.col("next_state").alias("state"),
                (F.col("cost") + F.col("declared_cost")).alias("cost"), (F.col("probes") + 1).alias("probes"),
            )
        )
        moved = Stored(asked, f"policy-{step}")
        if moved.is_empty():
            break
        current = moved
    ended = union_stored(done).withColumn("status", F.lit("ENDED"))
    last = current.df.join(shuffled(ended.select("case_id")), "case_id", "left_anti")
    open_cases = last.select("case_id", F.lit(None).cast("string").alias("action"), "cost", "probes", F.lit("OPEN_AT_LIMIT").alias("status"))
    return ended.unionByName(open_cases)


def discovery_metrics(trials: DataFrame, by: Sequence[str] = ("strategy",)) -> DataFrame:
    """Counts per strategy; ``trials`` has verdict, truth_graph, truth_known, graphs and probes."""
    verdict = F.col("verdict")
    known = F.col("truth_known")
    inside = F.array_contains("graphs", F.col("truth_graph"))
    actionable = verdict.isin("GRAPH_DISCOVERED", "PATH_CLASS_DISCOVERED", "EQUIVALENCE_CLASS")
    several = known & verdict.isin("PATH_CLASS_DISCOVERED", "EQUIVALENCE_CLASS")
    counts = trials.groupBy(*by).agg(
        F.count_if(actionable & ~(known & inside)).alias("false_confident"),
        F.count_if(known & (verdict == "GRAPH_DISCOVERED") & inside).alias("exact_recovery"),
        F.count_if(known & (verdict == "PATH_CLASS_DISCOVERED") & inside).alias("path_class_recovery"),
        F.count_if(several).alias("several"),
        F.count_if(several & inside).alias("several_inside"),
        F.count_if(verdict == "OUT_OF_HYPOTHESIS").alias("out_of_hypothesis"),
        F.count_if(verdict == "UNVERIFIED").alias("unverified"),
        F.sum("probes").alias("probe_count"),
    )
    rate = F.when(F.col("several") > 0, F.col("several_inside") / F.col("several")).otherwise(1.0)
    return counts.withColumn("containment_rate", rate).drop("several", "several_inside")


def verify_discovery_log(
    log: DataFrame, predicted: DataFrame, probes: DataFrame, cases: DataFrame
) -> DataFrame:
    """Recompute every recorded step: version space before and after, and the selected probe.

    ``log(case_id, step, probe_id, trace, before_graphs, after_graphs)``; the
    prefix of earlier observations is recomputed from the traces, not trusted.
    """
    observations = log.join(shuffled(cases.select("case_id", "budget")), "case_id")
    fits = (
        observations.select("probe_id", "trace", "budget").distinct()
        .join(predicted.select("probe_id", "graph_id", F.col("trace").alias("guess")), "probe_id")
        .where(trace_distance(F.col("trace"), F.col("guess")) <= F.col("budget"))
        .groupBy("probe_id", "trace", "budget").agg(F.collect_set("graph_id").alias("fit"))
    )
    none = F.array().cast("array<string>")
    every = predicted.agg(F.array_sort(F.collect_set("graph_id")).alias("every"))
    # A case has at most as many steps as there are probes, so its window is bounded.
    steps = observations.join(fits, ["probe_id", "trace", "budget"], "left").withColumn("fit", F.coalesce("fit", none))
    upto = Window.partitionBy("case_id").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("case_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    folded = steps.crossJoin(F.broadcast(every)).select(
        "*",
        F.collect_list("fit").over(upto).alias("fits_after"),
        F.collect_list("fit").over(earlier).alias("fits_before"),
        F.array_sort(F.collect_list("probe_id").over(earlier)).alias("used"),
    )
    meet = lambda c: F.array_sort(F.aggregate(c, F.col("every"), lambda acc, x: F.array_intersect(acc, x)))
    recomputed = Stored(
        folded.select(
            "case_id", "step", "probe_id", "before_graphs", "after_graphs", "used",
            meet("fits_before").alias("graphs"), meet("fits_after").alias("after"),
        ).withColumn("state_id", _state_id()),
        "log-replay",
    ).df
    choice = select_probe(recomputed.select("state_id", "graphs", "used").distinct(), predicted, probes).select(
        "state_id", F.col("probe_id").alias("expected_probe")
    )
    return recomputed.join(choice, "state_id", "left").select(
        "case_id",
        "step",
        F.col("before_graphs").eqNullSafe(F.col("graphs")).alias("before_ok"),
        F.col("after_graphs").eqNullSafe(F.col("after")).alias("after_ok"),
        F.col("probe_id").eqNullSafe(F.col("expected_probe")).alias("probe_ok"),
    )


# --- bridge to temporal safety, final verdict --------------------------------


def graphs_to_scenarios(groups: DataFrame, paths: DataFrame, catalogue: Catalogue):
    """Scenario tables for sets of surviving graphs (``groups(case_id, graph_id)``).

    Returns transitions, initial facts, residual facts, cases and unit-cost edge
    guards.  ``cases.valid`` is false when a graph has no recurrence path or the
    graphs disagree on residual nodes.
    """
    edges = relevant_edges(paths).join(catalogue.edges, ["graph_id", "edge_id"])
    fact = lambda c: F.concat(F.lit("present:"), F.col(c))
    scen = groups.withColumn("scenario_id", F.col("graph_id"))
    transitions = scen.join(edges, "graph_id").select(
        "case_id", "scenario_id", F.col("edge_id").alias("transition_id"),
        F.array(fact("source_id")).alias("requires"), F.array(fact("target_id")).alias("adds"),
    )
    placed = scen.join(catalogue.nodes, "graph_id")
    initial = placed.where("is_initial").select("case_id", "scenario_id", fact("node_id").alias("fact"))
    residual = placed.where("is_residual").select("case_id", "scenario_id", fact("node_id").alias("fact"))
    per_graph = relevant_edges(paths).groupBy("graph_id").agg(F.collect_set("edge_id").alias("edges"))
    residual_sets = catalogue.nodes.where("is_residual").groupBy("graph_id").agg(
        F.array_sort(F.collect_set("node_id")).alias("residual")
    )
    nominal = groups.groupBy("case_id").agg(F.min("graph_id").alias("nominal"))
    sized = (
        groups.join(nominal, "case_id")
        .join(per_graph, "graph_id", "left")
        .join(per_graph.toDF("nominal", "nominal_edges"), "nominal", "left")
        .join(residual_sets, "graph_id", "left")
        .join(residual_sets.toDF("nominal", "nominal_residual"), "nominal", "left")
    )
    none = F.array().cast("array<string>")
    a, b = F.coalesce("edges", none), F.coalesce("nominal_edges", none)
    cases = sized.select(
        "case_id",
        F.col("graph_id").alias("scenario_id"),
        (F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))).cast("long").alias("mutation_count"),
        (F.col("edges").isNotNull() & F.col("residual").eqNullSafe(F.col("nominal_residual"))).alias("valid"),
    )
    controls = transitions.select("case_id", "transition_id").distinct().select(
        "case_id",
        F.concat(F.lit("guard:"), "transition_id").alias("control_id"),
        F.lit(1).cast("long").alias("cost"),
        F.lit(True).alias("permitted"),
        F.array("transition_id").alias("guarded"),
    )
    return transitions, initial, residual, cases, controls


ACTIONABLE = ("GRAPH_DISCOVERED", "PATH_CLASS_DISCOVERED", "EQUIVALENCE_CLASS")


def certify(find: DataFrame, erase: DataFrame, prove: DataFrame) -> DataFrame:
    """Final verdict and stage statuses per request.

    ``find(request_id, find_verdict, evidence_ok, reconciled)``,
    ``erase(request_id, erase_verdict)``, ``prove(request_id, prove_status)``.
    A stage without a row counts as missing evidence, never as success.
    """
    joined = find.join(erase, "request_id", "full_outer").join(prove, "request_id", "full_outer")
    erased = F.coalesce("erase_verdict", F.lit("UNVERIFIED"))
    found = (
        F.coalesce(F.col("find_verdict").isin(*ACTIONABLE), F.lit(False))
        & F.coalesce("evidence_ok", F.lit(False))
        & F.coalesce("reconciled", F.lit(False))
    )
    prove_status = F.coalesce("prove_status", F.lit("UNVERIFIED"))
    verdict = (
        F.when(erased == "INCOMPLETE", "INCOMPLETE")
        .when(~found | (erased != "COMPLETE") | (prove_status == "UNVERIFIED"), "UNVERIFIED")
        .when(prove_status == "OPTIMAL", "COMPLETE_WITHIN_ENVELOPE")
        .otherwise("INCOMPLETE")
    )
    return joined.select(
        "request_id",
        verdict.alias("verdict"),
        F.when(found, "COMPLETE").otherwise("UNVERIFIED").alias("find_stage"),
        F.when(erased == "COMPLETE", "COMPLETE").when(erased == "INCOMPLETE", "INCOMPLETE").otherwise("UNVERIFIED").alias("erase_stage"),
        F.when(verdict == "COMPLETE_WITHIN_ENVELOPE", "COMPLETE").otherwise(verdict).alias("prove_stage"),
    )
