"""Future safety of deletion workflows: coverage, regeneration, control sets.

A case is a set of facts with transitions that add and remove facts.  Frames are
keyed by ``keys`` (``["case_id"]``, or with a scenario or subset number).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceless.functions.choices import BudgetExceeded, cheapest
from traceless.functions.lattice import ALL, blocks, chosen, has, membership, subset_key, subsets_in_block, without
from traceless.operators.remediation import MAX_EXACT, choice_arrays, numbered_choices
from traceless.plans.workspace import Stored, shuffled, union_stored

NO_TEXT = "array<string>"
#: Monotone cases are searched whatever the number of their controls.
ANY_NUMBER = (1 << 31) - 1
#: Search nodes of a case in one round, and rounds of the whole search.
MAX_NODES, MAX_ROUNDS = 200_000, 200
#: Sets of a case that may exceed its state limit before its search ends.
MAX_UNSEEN = 8


def _empty() -> Column:
    return F.array().cast(NO_TEXT)


def coverage(transitions: DataFrame, sensors: DataFrame, observations: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Missing sensors, unobserved, unregistered and unverified items per case."""
    keys = list(keys)
    seen = observations.where("verified")
    known = transitions.select(*keys, "transition_id").distinct()
    gaps = [
        ("missing_sensors", sensors.select(*keys, "sensor_id").distinct().join(shuffled(seen.select(*keys, "sensor_id")), [*keys, "sensor_id"], "left_anti"), "sensor_id"),
        ("unobserved", known.join(shuffled(seen.select(*keys, "transition_id")), [*keys, "transition_id"], "left_anti"), "transition_id"),
        ("unregistered", observations.select(*keys, "transition_id").distinct().join(shuffled(known), [*keys, "transition_id"], "left_anti"), "transition_id"),
        ("unverified", observations.where(~F.col("verified")), "obs_id"),
    ]
    rows = None
    for name, frame, column in gaps:
        part = frame.select(*keys, F.lit(name).alias("gap"), F.col(column).alias("item"))
        rows = part if rows is None else rows.unionByName(part)
    grouped = rows.groupBy(*keys).agg(
        *[F.array_sort(F.collect_list(F.when(F.col("gap") == n, F.col("item")))).alias(n) for n, _, _ in gaps]
    )
    cases = known.select(*keys).unionByName(sensors.select(*keys)).distinct()
    out = cases.join(shuffled(grouped), keys, "left")
    lists = [F.coalesce(n, _empty()).alias(n) for n, _, _ in gaps]
    complete = F.lit(True)
    for n, _, _ in gaps:
        complete = complete & (F.size(F.coalesce(n, _empty())) == 0)
    return out.select(*keys, complete.alias("complete"), *lists)


def _meets(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b)) > 0


def explored_states(
    transitions: DataFrame,
    initial: DataFrame,
    residual: DataFrame,
    cases: DataFrame,
    keys: Sequence[str],
    guards: DataFrame | None = None,
    max_states: int = 4096,
) -> DataFrame:
    """``keys, state, residual, path, cap, hit``: the fact sets of every case, level by level.

    ``cap`` is the case's own ``max_states`` where the frame of cases has one.
    """
    keys = list(keys)
    steps = transitions
    for name in ("removes", "forbids"):
        if name not in steps.columns:
            steps = steps.withColumn(name, _empty())
    if guards is not None:
        steps = steps.join(shuffled(guards.select(*keys, "transition_id").distinct()), [*keys, "transition_id"], "left_anti")
    steps = Stored(steps.select(*keys, "transition_id", "requires", "adds", "removes", "forbids"), "steps").df
    residuals = residual.groupBy(*keys).agg(F.array_sort(F.collect_set("fact")).alias("residual"))
    own = F.col("max_states") if "max_states" in cases.columns else F.lit(None)
    first = (
        cases.select(*keys, F.coalesce(own.cast("long"), F.lit(max_states)).alias("cap"))
        .join(shuffled(initial.groupBy(*keys).agg(F.array_sort(F.collect_set("fact")).alias("state"))), keys, "left")
        .join(shuffled(residuals), keys, "left")
        .select(
            *keys,
            F.coalesce("state", _empty()).alias("state"),
            F.coalesce("residual", _empty()).alias("residual"),
            _empty().alias("path"),
            "cap",
        )
        .withColumn("hit", _meets("state", "residual"))
    )
    found = [Stored(first, "states-0")]
    while True:
        everything = union_stored(found)
        closed = (
            everything.groupBy(*keys)
            .agg(F.bool_or("hit").alias("over"), F.count(F.lit(1)).alias("n"), F.first("cap").alias("cap"))
            .where(F.col("over") | (F.col("n") > F.col("cap")))
        )
        open_states = found[-1].df.join(shuffled(closed.select(*keys)), keys, "left_anti")
        enabled = (F.size(F.array_except("requires", "state")) == 0) & ~_meets("forbids", "state")
        after = F.array_sort(F.array_union(F.array_except("state", "removes"), "adds"))
        grown = (
            open_states.join(shuffled(steps), keys)
            .where(enabled)
            .select(*keys, after.alias("state"), "residual", "cap", F.concat("path", F.array("transition_id")).alias("path"))
            .groupBy(*keys, "state")
            .agg(F.min("path").alias("path"), F.first("residual").alias("residual"), F.first("cap").alias("cap"))
            .join(shuffled(everything.select(*keys, "state")), [*keys, "state"], "left_anti")
            .withColumn("hit", _meets("state", "residual"))
            .select(*keys, "state", "residual", "path", "cap", "hit")
        )
        level = Stored(grown, f"states-{len(found)}")
        if level.is_empty():
            break
        found.append(level)
    return union_stored(found)


def regeneration(
    transitions: DataFrame,
    initial: DataFrame,
    residual: DataFrame,
    coverage_complete: DataFrame,
    keys: Sequence[str] = ("case_id",),
    guards: DataFrame | None = None,
    max_states: int = 4096,
) -> DataFrame:
    """Breadth-first search over fact sets with the smallest shortest witness.

    ``initial`` and ``residual`` hold one fact per row; ``coverage_complete``
    lists every case with its flag.  A case stops at its first level that holds
    a residual fact, or once it has more than ``max_states`` states; a column
    ``max_states`` of ``coverage_complete`` sets a case's own limit.
    """
    keys = list(keys)
    states = explored_states(transitions, initial, residual, coverage_complete, keys, guards, max_states)
    place = F.struct(F.size("path").alias("length"), F.col("path").alias("path"))
    witness = states.where("hit").groupBy(*keys).agg(F.min(F.struct(place.alias("place"), "state")).alias("w"))
    counts = (
        states.join(shuffled(witness), keys, "left")
        .groupBy(*keys)
        .agg(F.count_if(F.col("w").isNull() | (place <= F.col("w.place"))).alias("states"), F.first("cap").alias("cap"))
    )
    joined = coverage_complete.select(*keys, "complete").join(shuffled(witness), keys, "left").join(shuffled(counts), keys, "left")
    snapshot = F.col("w").isNotNull() & (F.col("w.place.length") == 0)
    risky = F.col("w").isNotNull() & ~snapshot
    exceeded = F.when(risky, F.col("states") - 1).otherwise(F.col("states")) > F.col("cap")
    verdict = (
        F.when(snapshot, "SNAPSHOT_INCOMPLETE")
        .when(exceeded, "UNVERIFIED")
        .when(risky, "REGENERATION_RISK")
        .when(F.col("complete"), "RSE_VERIFIED")
        .otherwise("INCOMPLETE_COVERAGE")
    )
    return joined.select(
        *keys,
        verdict.alias("verdict"),
        F.col("complete").alias("coverage_complete"),
        F.when(snapshot | risky, F.col("w.place.path")).alias("witness"),
        F.col("w.state").alias("witness_state"),
        F.when(snapshot, 1).otherwise(F.col("states")).cast("long").alias("reachable_states"),
        (exceeded & ~snapshot).alias("limit_exceeded"),
    )


# --- monotone cases: labels over many guard sets -----------------------------


def fact_labels(
    transitions: DataFrame, initial: DataFrame, guard_labels: DataFrame | None, keys: Sequence[str]
) -> DataFrame:
    """Closure of facts when nothing removes or forbids a fact.

    A label's bit ``b`` says that the fact is reachable under guard set ``b``;
    ``guard_labels(keys, transition_id, guarded)`` marks the sets that stop a
    transition.  Without guards all bits agree.
    """
    keys = list(keys)
    base = transitions.select(*keys, "transition_id", "requires", "adds")
    if guard_labels is not None:
        base = base.join(guard_labels, [*keys, "transition_id"], "left").withColumn(
            "allowed", F.bitwise_not(F.coalesce("guarded", F.lit(0).cast("long")))
        )
    else:
        base = base.withColumn("allowed", F.lit(ALL).cast("long"))
    base = Stored(base.select(*keys, "transition_id", "requires", "adds", "allowed"), "monotone-steps").df
    needs = base.select(*keys, "transition_id", F.size("requires").alias("n"), F.explode("requires").alias("fact"))
    free = base.where(F.size("requires") == 0).select(*keys, F.explode("adds").alias("fact"), F.col("allowed").alias("bits"))
    start = initial.select(*keys, "fact", F.lit(ALL).cast("long").alias("bits")).unionByName(free)
    found = [Stored(start.groupBy(*keys, "fact").agg(F.bit_or("bits").alias("bits")), "facts-0")]
    while True:
        known = union_stored(found).groupBy(*keys, "fact").agg(F.bit_or("bits").alias("bits"))
        touched = needs.join(found[-1].df.select(*keys, "fact"), [*keys, "fact"], "left_semi").select(
            *keys, "transition_id"
        ).distinct()
        fired = (
            needs.join(touched, [*keys, "transition_id"], "left_semi")
            .join(known, [*keys, "fact"])
            .groupBy(*keys, "transition_id", "n")
            .agg(F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("matched"))
            .where(F.col("matched") == F.col("n"))
            .join(base.select(*keys, "transition_id", "adds", "allowed"), [*keys, "transition_id"])
            .select(*keys, F.explode("adds").alias("fact"), F.col("bits").bitwiseAND(F.col("allowed")).alias("bits"))
            .groupBy(*keys, "fact")
            .agg(F.bit_or("bits").alias("new"))
        )
        grown = (
            fired.join(known, [*keys, "fact"], "left")
            .select(*keys, "fact", without(F.col("new"), F.coalesce("bits", F.lit(0).cast("long"))).alias("bits"))
            .where(F.col("bits") != 0)
        )
        level = Stored(grown, f"facts-{len(found)}")
        if level.is_empty():
            break
        found.append(level)
    return union_stored(found).groupBy(*keys, "fact").agg(F.bit_or("bits").alias("bits"))


def fact_closure(transitions: DataFrame, initial: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """All facts a monotone case can ever hold."""
    return fact_labels(transitions, initial, None, keys).select(*keys, "fact")


class ControlLattice:
    """Safety of every subset of a case's controls, 64 subsets per row."""

    def __init__(self, transitions: DataFrame, initial: DataFrame, residual: DataFrame, controls: DataFrame, scenario: Sequence[str] = (), limit: int = MAX_EXACT):
        self.limit = limit
        scenario = list(scenario)
        spread_keys = ["case_id", *scenario]
        named = controls.withColumnRenamed("control_id", "action_id")
        numbered = Stored(numbered_choices(named, "case_id", limit), "controls").df
        cases = transitions.select(*spread_keys).unionByName(initial.select(*spread_keys)).distinct()
        self.arrays = (
            cases.select("case_id").distinct().join(choice_arrays(numbered, "case_id"), "case_id", "left").select(
                "case_id",
                F.coalesce("choices", F.lit(0)).alias("choices"),
                F.coalesce("ids", _empty()).alias("ids"),
                F.coalesce("costs", F.array().cast("array<bigint>")).alias("costs"),
            )
        )
        spread = cases.join(self.arrays.select("case_id", "choices"), "case_id").withColumn(
            "block", F.explode(blocks(F.col("choices")))
        )
        self.cases = Stored(spread.select(*spread_keys, "block"), "control-blocks").df
        keys = [*spread_keys, "block"]
        guards = (
            numbered.join(named.select("case_id", "action_id", F.explode("guarded").alias("transition_id")), ["case_id", "action_id"])
            .withColumn("block", F.explode(blocks(F.col("choices"))))
            .withColumn("bits", membership(F.col("idx"), F.col("block")))
            .groupBy("case_id", "block", "transition_id")
            .agg(F.bit_or("bits").alias("guarded"))
        )
        stepped = transitions.join(self.cases, spread_keys)
        labelled = stepped.select(*keys, "transition_id").join(guards, ["case_id", "block", "transition_id"])
        facts = fact_labels(stepped, initial.join(self.cases, spread_keys), labelled.select(*keys, "transition_id", "guarded"), keys)
        bad = facts.join(residual.join(self.cases, spread_keys).select(*keys, "fact"), [*keys, "fact"], "left_semi")
        unsafe = bad.groupBy(*keys).agg(F.bit_or("bits").alias("unsafe"))
        self.safe = Stored(
            self.cases.join(unsafe, keys, "left").select(
                *keys, F.bitwise_not(F.coalesce("unsafe", F.lit(0).cast("long"))).alias("safe")
            ),
            "safe-sets",
        ).df

    def best(self, over: Sequence[str] = ("case_id",)) -> DataFrame:
        """Cheapest subset that is safe in all rows of a case: (cost, size, ids) order."""
        together = self.safe.groupBy(*over, "block").agg(F.bit_and("safe").alias("safe"))
        subsets = (
            together.join(self.arrays, "case_id")
            .withColumn("bit", F.explode(subsets_in_block(F.col("choices"))))
            .where(has(F.col("safe"), F.col("bit")))
        )
        mask = F.col("block") * 64 + F.col("bit")
        key = F.struct(*subset_key(F.col("costs"), mask, self.limit))
        best = subsets.groupBy(*over).agg(F.min(key).alias("b"), F.first("ids").alias("ids"))
        return best.select(*over, chosen(F.col("ids"), F.col("b.mask")).alias("control_ids"), "b.total_cost")


def _plan(cases: DataFrame, best: DataFrame, refused: DataFrame) -> DataFrame:
    """One row per case; a case beyond the search limit says so instead of ending the job."""
    joined = cases.join(best, "case_id", "left").join(refused.withColumn("is_refused", F.lit(True)), "case_id", "left")
    status = (
        F.when(~F.col("complete"), "UNVERIFIED")
        .when(F.col("is_refused"), "LIMIT_EXCEEDED")
        .when(F.col("total_cost").isNull(), "INFEASIBLE")
        .otherwise("OPTIMAL")
    )
    return joined.select(
        "case_id",
        F.when(status == "OPTIMAL", F.col("control_ids")).otherwise(_empty()).alias("control_ids"),
        F.when(status == "OPTIMAL", F.col("total_cost")).otherwise(0).alias("total_cost"),
        status.alias("status"),
    )


def min_cost_controls(
    transitions: DataFrame, initial: DataFrame, residual: DataFrame, coverage_complete: DataFrame, controls: DataFrame, limit: int = MAX_EXACT
) -> DataFrame:
    """Cheapest guards that make a case safe for good, one row per case."""
    best, refused = _best_controls(transitions, initial, residual, coverage_complete, controls, (), limit)
    return _plan(coverage_complete.select("case_id", "complete"), best, refused)


def _changing(transitions: DataFrame) -> DataFrame:
    """Cases in which a transition removes a fact or needs one to be absent."""
    any_size = F.lit(0)
    for name in ("removes", "forbids"):
        if name in transitions.columns:
            any_size = any_size + F.coalesce(F.size(name), F.lit(0))
    return transitions.where(any_size > 0).select("case_id").distinct()


def _best_controls(
    transitions: DataFrame, initial: DataFrame, residual: DataFrame, cases: DataFrame, controls: DataFrame, scenario: Sequence[str], limit: int
) -> tuple[DataFrame, DataFrame]:
    """Cheapest safe control set per case, and the cases that no search covers.

    Monotone cases up to ``limit`` permitted controls use the label lattice; larger
    ones, and cases that remove or forbid facts, hitting sets of the ways to a residual fact.
    """
    changing = Stored(_changing(transitions), "changing-cases").df
    counts = controls.where("permitted").groupBy("case_id").count()
    large = Stored(counts.where(F.col("count") > limit).select("case_id"), "large-cases").df

    def only(keep: list[DataFrame], drop: list[DataFrame]) -> list[DataFrame]:
        frames = [transitions, initial, residual, controls, cases]
        for other in keep:
            frames = [f.join(other, "case_id", "left_semi") for f in frames]
        for other in drop:
            frames = [f.join(other, "case_id", "left_anti") for f in frames]
        return frames

    if changing.isEmpty() and large.isEmpty():
        return ControlLattice(transitions, initial, residual, controls, scenario, limit).best(), large
    t, i, r, c, _ = only([], [changing, large])
    best, refused = ControlLattice(t, i, r, c, scenario, limit).best(), []
    for parts, moves in ((only([large], [changing]), False), (only([changing], []), True)):
        if not (changing if moves else large).isEmpty():
            found, beyond = hitting_controls(*parts, scenario, moves)
            best, refused = best.unionByName(found), [*refused, beyond]
    for other in refused[1:]:
        refused[0] = refused[0].unionByName(other)
    return best, refused[0]


def _no_numbers() -> Column:
    return F.array().cast("array<int>")


def _together(column: str) -> Column:
    """Aggregate: the different numbers of all arrays, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(column))))


def _supports(steps: DataFrame, initial: DataFrame, keys: list[str]) -> DataFrame:
    """Facts that can come to hold, each with the numbers of the controls on one way to it."""
    steps = Stored(steps.select(*keys, "transition_id", "requires", "adds", "guard", F.size("requires").alias("n")), "open-steps").df
    found = [Stored(initial.select(*keys, "fact").distinct().withColumn("support", _no_numbers()), "supports-0")]
    needs = steps.withColumn("fact", F.explode("requires"))
    while True:
        known = union_stored(found)
        met = (
            needs.join(known, [*keys, "fact"])
            .groupBy(*keys, "transition_id", "adds", "guard", "n")
            .agg(_together("support").alias("support"), F.count(F.lit(1)).alias("matched"))
            .where("matched = n")
        )
        fired = met.select(*keys, "adds", F.array_sort(F.array_union("support", "guard")).alias("support"))
        if len(found) == 1:
            fired = fired.unionByName(steps.where("n = 0").select(*keys, "adds", F.col("guard").alias("support")))
        fresh = fired.select(*keys, F.explode("adds").alias("fact"), "support").join(known, [*keys, "fact"], "left_anti")
        least = fresh.groupBy(*keys, "fact").agg(F.min(F.struct(F.size("support").alias("size"), "support")).alias("s"))
        level = Stored(least.select(*keys, "fact", "s.support"), f"supports-{len(found)}")
        if level.is_empty():
            break
        found.append(level)
    return union_stored(found)


def _open_ways(steps: DataFrame, initial: DataFrame, residual: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """Demands of monotone cases: the controls on one open way to each residual fact."""
    open_steps = steps.join(taken, "case_id").where(~F.arrays_overlap("guard", "taken"))
    facts = _supports(open_steps, initial.join(taken.select("case_id"), "case_id", "left_semi"), keys)
    ways = facts.join(residual, [*keys, "fact"], "left_semi")
    return ways.select("case_id", F.col("support").alias("demand"), F.lit(False).alias("unseen"))


def _open_searches(
    steps: DataFrame, initial: DataFrame, residual: DataFrame, taken: DataFrame, keys: list[str], cases: DataFrame, numbers: DataFrame, max_states: int
) -> DataFrame:
    """Demands of cases that remove or forbid facts: the controls on each shortest way to a residual fact.

    Guards only take transitions away, so what is reached under a set is reached under
    each part of it.  Where the states exceed the limit, every safe set must therefore
    have a control that the searched set lacks.
    """
    mine = lambda df: df.join(taken.select("case_id"), "case_id", "left_semi")
    guards = steps.join(taken, "case_id").where(F.arrays_overlap("guard", "taken")).select(*keys, "transition_id")
    limit = ["max_states"] if "max_states" in cases.columns else []
    some = mine(cases.select(*keys, *limit).distinct())
    states = Stored(explored_states(mine(steps), mine(initial), mine(residual), some, keys, guards, max_states), "guarded-states").df
    hits = states.where("hit").select(*keys, "path")
    marked = hits.select(*keys, "path", F.explode_outer("path").alias("transition_id")).join(
        steps.select(*keys, "transition_id", "guard"), [*keys, "transition_id"], "left"
    )
    demand = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("guard", _no_numbers()))))).alias("demand")
    ways = marked.groupBy(*keys, "path").agg(demand).select("case_id", "demand", F.lit(False).alias("unseen"))
    sizes = states.groupBy(*keys).agg(F.bool_or("hit").alias("hit"), F.count(F.lit(1)).alias("n"), F.first("cap").alias("cap"))
    over = sizes.where(~F.col("hit") & (F.col("n") > F.col("cap"))).select("case_id").distinct()
    rest = over.join(taken, "case_id").join(numbers, "case_id").select(
        "case_id", F.array_except("numbers", "taken").alias("demand"), F.lit(True).alias("unseen")
    )
    return ways.unionByName(rest)


def hitting_controls(
    transitions: DataFrame,
    initial: DataFrame,
    residual: DataFrame,
    controls: DataFrame,
    cases: DataFrame,
    scenario: Sequence[str] = (),
    changing: bool = False,
    max_states: int = 4096,
    max_rounds: int = MAX_ROUNDS,
) -> tuple[DataFrame, DataFrame]:
    """Cheapest guard sets, exactly, for any number of controls, and the cases beyond a budget.

    A way to a residual fact is a demand: one of the controls on it must be taken.
    Each round takes the cheapest set that meets a case's demands so far and looks
    for a way that is still open.  Sets only grow dearer, so the first one that
    leaves no way is the cheapest safe set.  ``changing`` cases, in which transitions
    remove or forbid facts, are searched by their fact sets.  A case whose demands
    need more than ``MAX_NODES`` search nodes, or more rounds, ends in the second frame.
    """
    keys = ["case_id", *scenario]
    named = controls.withColumnRenamed("control_id", "action_id")
    numbered = Stored(numbered_choices(named, "case_id", ANY_NUMBER), "many-controls").df
    guards = (
        numbered.join(named.select("case_id", "action_id", F.explode("guarded").alias("transition_id")), ["case_id", "action_id"])
        .groupBy("case_id", "transition_id")
        .agg(F.array_sort(F.collect_set("idx")).alias("guard"))
    )
    steps = transitions.join(guards, ["case_id", "transition_id"], "left").withColumn("guard", F.coalesce("guard", _no_numbers()))
    steps = Stored(steps, "guarded-steps").df
    arrays = Stored(
        cases.select("case_id").distinct().join(choice_arrays(numbered, "case_id"), "case_id", "left").select(
            "case_id", F.coalesce("ids", _empty()).alias("ids"), F.coalesce("costs", F.array()).cast("array<bigint>").alias("costs")
        ),
        "control-arrays",
    ).df
    places = F.transform("costs", lambda _, i: i)
    numbers = arrays.select("case_id", F.coalesce(places, _no_numbers()).cast("array<int>").alias("numbers"))
    taken = Stored(arrays.select("case_id", _no_numbers().alias("taken")), "taken").df
    kind = cases.schema["case_id"].dataType.simpleString()
    demands: list[Stored] = []
    done: list[Stored] = []
    over: list[Stored] = []
    while True:
        if changing:
            found = _open_searches(steps, initial, residual, taken, keys, cases, numbers, max_states)
        else:
            found = _open_ways(steps, initial, residual, taken, keys)
        demands.append(Stored(found.distinct(), f"demands-{len(demands)}"))
        done.append(Stored(taken.join(demands[-1].df.select("case_id"), "case_id", "left_anti"), f"safe-cases-{len(done)}"))
        if demands[-1].is_empty():
            break
        still = taken.join(demands[-1].df.select("case_id"), "case_id", "left_semi")
        if len(demands) >= max_rounds:
            over.append(Stored(still.select("case_id"), "late-cases"))
            break
        # a way without a control on it can't be closed; a case that can't be searched is not known to be open
        hopeless = demands[-1].df.where("size(demand) = 0").groupBy("case_id").agg(F.bool_and("unseen").alias("unseen"))
        tries = union_stored(demands).where("unseen").groupBy("case_id").count().where(F.col("count") >= MAX_UNSEEN)
        unsearched = tries.select("case_id").unionByName(hopeless.where("unseen").select("case_id")).join(still, "case_id", "left_semi")
        over.append(Stored(unsearched.distinct(), "unsearched-cases"))
        ended = hopeless.select("case_id").unionByName(over[-1].df)
        still = still.join(ended, "case_id", "left_anti")
        listed = union_stored(demands).join(still.select("case_id"), "case_id", "left_semi").groupBy("case_id").agg(
            F.collect_set("demand").alias("demands")
        )
        rows = listed.join(arrays, "case_id").select("case_id", "demands", "costs")
        solved = Stored(rows.mapInArrow(_solve_demands, f"case_id {kind}, taken array<int>"), f"taken-{len(demands)}").df
        over.append(Stored(solved.where("taken is null").select("case_id"), "hard-cases"))
        taken = solved.where("taken is not null")

    def picked(column: str) -> Column:
        return F.filter(column, lambda _, i: F.array_contains("taken", i))

    plans = union_stored(done).join(arrays, "case_id").select(
        "case_id", picked("ids").alias("control_ids"), picked("costs").alias("picked")
    )
    total = F.aggregate("picked", F.lit(0).cast("long"), lambda a, x: a + x)
    beyond = union_stored(over).distinct() if over else cases.select("case_id").limit(0)
    return plans.select("case_id", "control_ids", total.alias("total_cost")), beyond


def _solve_demands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cheapest choices of every row; null where the search needs more than its budget."""

    def solve(demands: list[list[int]], costs: list[int]) -> list[int] | None:
        try:
            return cheapest([sum(1 << i for i in demand) for demand in demands], costs, MAX_NODES)
        except BudgetExceeded:
            return None

    for batch in batches:
        rows = zip(batch.column("demands").to_pylist(), batch.column("costs").to_pylist())
        taken = [solve(demands, costs) for demands, costs in rows]
        yield pa.RecordBatch.from_arrays([batch.column("case_id"), pa.array(taken, pa.list_(pa.int32()))], ["case_id", "taken"])


def robust_controls(
    transitions: DataFrame, initial: DataFrame, residual: DataFrame, coverage_complete: DataFrame, controls: DataFrame, limit: int = MAX_EXACT
) -> DataFrame:
    """One guard set that is safe in every scenario of a case."""
    best, refused = _best_controls(transitions, initial, residual, coverage_complete, controls, ["scenario_id"], limit)
    cases = coverage_complete.groupBy("case_id").agg(F.bool_and("complete").alias("complete"))
    return _plan(cases, best, refused)


def robustness_premium(nominal: DataFrame, robust: DataFrame) -> DataFrame:
    """Extra cost of the robust over the nominal plan."""
    a = nominal.select("case_id", F.col("total_cost").alias("nominal_cost"), F.col("status").alias("nominal_status"))
    b = robust.select("case_id", F.col("total_cost").alias("robust_cost"), F.col("status").alias("robust_status"))
    return a.join(b, "case_id").withColumn("premium", F.col("robust_cost") - F.col("nominal_cost"))


def fan_out_scenarios(df: DataFrame, bits: int) -> DataFrame:
    """Rows of every scenario 0..2^bits-1; optional rows only where their bit is set."""
    spread = df.withColumn("scenario", F.explode(F.sequence(F.lit(0), F.lit((1 << bits) - 1))))
    there = (F.col("optional_bit") < 0) | (
        F.getbit(F.col("scenario").cast("long"), F.greatest("optional_bit", F.lit(0))) == 1
    )
    return spread.where(there).select(
        *[c for c in df.columns if c != "optional_bit"],
        F.lpad(F.bin(F.col("scenario").cast("long")), bits, "0").alias("scenario_id"),
        F.bit_count("scenario").cast("long").alias("mutation_count"),
    )


def shortest_adversarial_witness(reports: DataFrame) -> DataFrame:
    """Smallest (length, mutations, scenario, path) witness over a case's scenarios."""
    key = F.struct(F.size("witness").alias("length"), "mutation_count", "scenario_id", F.col("witness").alias("path"))
    risky = reports.where(F.col("verdict") == "REGENERATION_RISK")
    return risky.groupBy("case_id").agg(F.min(key).alias("w")).select(
        "case_id", "w.scenario_id", "w.mutation_count", F.col("w.path").alias("witness")
    )


def propagate(edges: DataFrame, nodes: DataFrame, guards: DataFrame) -> DataFrame:
    """Spread subjects along edges; a guard stops only the target subject.

    ``nodes(graph_id, subject, is_target, node_id)`` is the initial placement.
    """
    marked = edges.join(guards.withColumn("guarded", F.lit(True)), ["graph_id", "edge_id"], "left")
    links = Stored(
        marked.select("graph_id", F.col("source_id").alias("node_id"), "target_id", F.coalesce("guarded", F.lit(False)).alias("guarded")), "links"
    ).df
    keys = ["graph_id", "subject", "is_target", "node_id"]
    found = [Stored(nodes.select(*keys), "spread-0")]
    while True:
        grown = (
            found[-1].df.join(links, ["graph_id", "node_id"])
            .where(~(F.col("guarded") & F.col("is_target")))
            .select("graph_id", "subject", "is_target", F.col("target_id").alias("node_id"))
            .distinct()
            .join(union_stored(found), keys, "left_anti")
        )
        level = Stored(grown, f"spread-{len(found)}")
        if level.is_empty():
            break
        found.append(level)
    return union_stored(found)


# Labels of the certified commitments, in checking order.
COMMITMENTS = (
    ("topology", "topology_hash"),
    ("envelope", "envelope_hash"),
    ("model set", "model_set_hash"),
    ("observations", "observations_hash"),
    ("policy certificate", "policy_certificate_hash"),
    ("proof bundle", "proof_bundle_hash"),
    ("action signature", "action_signature_hash"),
)


def check_certificates(certificates: DataFrame, context: DataFrame, now_epoch: int) -> DataFrame:
    """Status and reason of every certificate against the current context."""
    current = context.select("request_id", *[F.col(c).alias(f"now_{c}") for c in context.columns if c != "request_id"])
    joined = certificates.join(current, "request_id", "left")
    rungs: list[tuple[Column, str, str]] = [
        (~F.col("signature_ok"), "INVALID", "invalid signature"),
        (F.col("issued_epoch") > now_epoch, "INVALID", "certificate is not active"),
        (F.col("not_after_epoch") < now_epoch, "EXPIRED", "time window expired"),
    ]
    for label, column in COMMITMENTS:
        changed = ~F.col(column).eqNullSafe(F.col(f"now_{column}"))
        rungs.append((changed, "EXPIRED", f"{label} commitment changed"))
    rungs.append(
        (~F.col("declared_verdict").eqNullSafe(F.col("now_replayed_verdict")), "INVALID", "declared verdict differs from independent replay")
    )
    discharged = F.coalesce(F.col("now_obligations_met"), F.lit(False))
    rungs.append(
        ((F.col("declared_verdict") == "COMPLETE_WITHIN_ENVELOPE") & ~discharged, "INVALID", "complete verdict has an undischarged obligation")
    )
    status = reason = None
    for test, s, r in rungs:
        status = F.when(test, s) if status is None else status.when(test, s)
        reason = F.when(test, r) if reason is None else reason.when(test, r)
    return joined.select(
        "certificate_id",
        status.otherwise("VALID").alias("status"),
        reason.otherwise("signature, replay, commitments, and time window are valid").alias("reason"),
    )
