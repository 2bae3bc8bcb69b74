"""Least-cost remediation: covers, closing action sets, policies."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceless.functions.choices import all_smallest, cheapest
from traceless.functions.lattice import BLOCK_BITS, blocks, chosen, either, has, membership, shift_left, subset_key, subsets_in_block
from traceless.operators.closing import closing_sets
from traceless.operators.pathgraph import PathGraph, Variants, apply_actions, bit_counts, evaluate_requests, openable
from traceless.operators.ranking import exact_percentile, group_rank
from traceless.plans.workspace import Stored, shuffled, union_stored

MAX_EXACT = 12
#: Permitted actions of a request up to which its closing set is exact if it names no limit.
MAX_CLOSING = 24
#: Permitted actions of a subject up to which a cover is solved exactly.
MAX_COVER = 30
#: Pairs of action and artifact of a subject up to which its greedy cover is solved as one row.
MAX_PAIRS = 4096


def required_artifacts(audit) -> DataFrame:
    """Artifacts that fail an audit without evidence."""
    return audit.checks.where(~F.col("valid")).select("subject_id", "artifact_id")


def numbered_choices(actions: DataFrame, case: str, limit: int = MAX_EXACT) -> DataFrame:
    """Permitted actions with their rank by id, for cases within the exact limit."""
    permitted = actions.where("permitted")
    small = permitted.groupBy(case).count().where(F.col("count") <= limit)
    order = Window.partitionBy(case).orderBy("action_id")
    return (
        permitted.join(small, case)
        .withColumn("idx", (F.row_number().over(order) - 1).cast("int"))
        .withColumnRenamed("count", "choices")
        .select(case, "action_id", "cost", "idx", "choices")
    )


def choice_arrays(numbered: DataFrame, case: str) -> DataFrame:
    """Ids and costs per case in rank order (at most the exact limit per case)."""
    packed = numbered.groupBy(case).agg(
        F.array_sort(F.collect_list(F.struct("idx", "action_id", "cost"))).alias("o"),
        F.max("choices").alias("choices"),
    )
    return packed.select(case, "choices", F.col("o.action_id").alias("ids"), F.col("o.cost").alias("costs"))


def exact_cover(required: DataFrame, actions: DataFrame, covers: DataFrame, limit: int = MAX_COVER) -> DataFrame:
    """Cheapest action set that covers every required artifact of a subject.

    An artifact becomes the bit set of the actions that cover it; a subject then
    is its few different bit sets with their counts, and one row holds it.  Rows
    are solved exactly where they are.  Artifacts that no permitted action covers
    stay uncovered.  Subjects beyond ``limit`` permitted actions go to
    :func:`greedy_cover`.
    """
    numbered = Stored(numbered_choices(actions, "subject_id", limit), "choices").df
    arrays = choice_arrays(numbered, "subject_id")
    over = Stored(actions.where("permitted").groupBy("subject_id").count().where(F.col("count") > limit), "cover-over")
    several = not over.is_empty()
    needed = required.join(over.df, "subject_id", "left_anti") if several else required
    useful = covers.join(numbered, "action_id").select("subject_id", "artifact_id", shift_left(F.lit(1).cast("long"), F.col("idx")).alias("bit"))
    masks = useful.groupBy("subject_id", "artifact_id").agg(F.bit_or("bit").alias("mask"))
    signed = needed.join(masks, ["subject_id", "artifact_id"], "left").select(
        "subject_id", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")
    )
    tallied = signed.groupBy("subject_id", "mask").agg(F.count(F.lit(1)).alias("n"))
    subjects = tallied.groupBy("subject_id").agg(
        F.collect_list("mask").alias("masks"),
        F.sum("n").alias("required"),
        F.sum(F.when(F.col("mask") == 0, F.col("n")).otherwise(0)).alias("uncovered"),
    )
    rows = subjects.join(arrays, "subject_id", "left").select(
        "subject_id", "masks", "required", "uncovered",
        F.coalesce("ids", F.array().cast("array<string>")).alias("ids"),
        F.coalesce("costs", F.array()).cast("array<bigint>").alias("costs"),
    )
    exact = rows.mapInArrow(_solve_covers, _typed(required, "subject_id") + ", action_ids array<string>, total_cost bigint, covered bigint, uncovered bigint").withColumn(
        "solver_status", F.lit("OPTIMAL")
    )
    if not several:
        return exact
    rest = required.join(over.df, "subject_id", "left_semi")
    greedy = greedy_cover(rest, actions, covers).withColumn("solver_status", F.lit("APPROXIMATE"))
    return exact.unionByName(greedy)


def _typed(df: DataFrame, name: str) -> str:
    return f"{name} {df.schema[name].dataType.simpleString()}"


def _solve_covers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for row in batch.select(["masks", "ids", "costs", "required", "uncovered"]).to_pylist():
            taken = cheapest(row["masks"], row["costs"])
            found.append(([row["ids"][i] for i in taken], sum(row["costs"][i] for i in taken), row["required"] - row["uncovered"], row["uncovered"]))
        ids, costs, covered, uncovered = zip(*found) if found else ((), (), (), ())
        longs = [pa.array(x, pa.int64()) for x in (costs, covered, uncovered)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("subject_id"), pa.array(ids, pa.list_(pa.string())), *longs],
            ["subject_id", "action_ids", "total_cost", "covered", "uncovered"],
        )


def greedy_cover(required: DataFrame, actions: DataFrame, covers: DataFrame) -> DataFrame:
    """Repeatedly take the action with the least cost per newly covered artifact.

    Subjects up to ``MAX_PAIRS`` pairs of action and artifact are a row each, solved where
    they are after one shuffle.  Larger ones take a round of joins for each action.
    """
    permitted = actions.where("permitted").select("subject_id", "action_id", "cost")
    joined = covers.join(shuffled(permitted), "action_id").join(shuffled(required), ["subject_id", "artifact_id"], "left_semi")
    pairs = Stored(joined.select("subject_id", "action_id", "cost", "artifact_id"), "cover-pairs").df
    large = Stored(pairs.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_PAIRS).select("subject_id"), "cover-large")
    several = not large.is_empty()
    small = pairs.join(large.df, "subject_id", "left_anti") if several else pairs
    rows = small.groupBy("subject_id").agg(F.collect_list(F.struct("action_id", "cost", "artifact_id")).alias("pairs"))
    cost_type = {"bigint": "bigint", "int": "bigint", "smallint": "bigint", "tinyint": "bigint"}.get(pairs.schema["cost"].dataType.simpleString(), "double")
    schema = f"{_typed(pairs, 'subject_id')}, action_ids array<string>, total_cost {cost_type}, covered bigint"
    taken = rows.mapInArrow(_take_greedily(cost_type), schema)
    if several:
        taken = taken.unionByName(_cover_rounds(pairs.join(large.df, "subject_id", "left_semi")))
    need = required.groupBy("subject_id").agg(F.count(F.lit(1)).alias("required"))
    return need.join(shuffled(taken), "subject_id", "left").select(
        "subject_id",
        F.coalesce("action_ids", F.array().cast("array<string>")).alias("action_ids"),
        F.coalesce("total_cost", F.lit(0)).alias("total_cost"),
        F.coalesce("covered", F.lit(0)).alias("covered"),
        (F.col("required") - F.coalesce("covered", F.lit(0))).alias("uncovered"),
    )


def _greedy_choice(pairs: list[dict]) -> tuple[list[str], float | int, int]:
    """Actions, their cost and the number of artifacts they cover, for one subject."""
    offers: dict[tuple, set] = {}
    by_action: dict[str, set] = {}
    for p in pairs:
        if p["artifact_id"] is not None:
            offers.setdefault((p["action_id"], p["cost"]), set()).add(p["artifact_id"])
            by_action.setdefault(p["action_id"], set()).add(p["artifact_id"])
    chosen_ids, total, covered = [], 0, 0
    while offers:
        (action, cost), gain = min(
            offers.items(), key=lambda o: (o[0][1] is not None, 0 if o[0][1] is None else float(o[0][1]) / len(o[1]), o[0][0], o[0][1] or 0)
        )
        chosen_ids.append(action)
        total += cost or 0
        covered += len(gain)
        gone = by_action[action]
        offers = {o: kept for o, items in offers.items() if (kept := items - gone)}
    return sorted(chosen_ids), total, covered


def _take_greedily(cost_type: str):
    """Greedy covers of a batch of subjects."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_greedy_choice(pairs) for pairs in batch.column("pairs").to_pylist()]
            ids, costs, covered = zip(*found) if found else ((), (), ())
            columns = [
                pa.array(ids, pa.list_(pa.string())), pa.array(costs, pa.int64() if cost_type == "bigint" else pa.float64()), pa.array(covered, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("subject_id"), *columns], ["subject_id", "action_ids", "total_cost", "covered"])

    return solve


def _cover_rounds(pairs: DataFrame) -> DataFrame:
    """Greedy covers by one round of joins for each action, for subjects of any size."""
    chosen_rounds: list[Stored] = []
    left = Stored(pairs.distinct(), "cover-left").df
    while True:
        gains = left.groupBy("subject_id", "action_id", "cost").agg(F.count("artifact_id").alias("gain"))
        pick = gains.groupBy("subject_id").agg(
            F.min(F.struct((F.col("cost") / F.col("gain")).alias("r"), "action_id", "cost", "gain")).alias("p")
        )
        round_ = Stored(pick.select("subject_id", "p.action_id", "p.cost", "p.gain"), f"greedy-{len(chosen_rounds)}")
        if round_.is_empty():
            break
        chosen_rounds.append(round_)
        done = left.join(round_.df.select("subject_id", "action_id"), ["subject_id", "action_id"], "left_semi")
        left = Stored(
            left.join(shuffled(done.select("subject_id", "artifact_id")), ["subject_id", "artifact_id"], "left_anti"),
            f"uncovered-{len(chosen_rounds)}",
        ).df
    return union_stored(chosen_rounds).groupBy("subject_id").agg(
        F.array_sort(F.collect_list("action_id")).alias("action_ids"),
        F.sum("cost").alias("total_cost"),
        F.sum("gain").alias("covered"),
    )


# --- closing action sets -----------------------------------------------------


def _lattice(graph: PathGraph, actions: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    numbered = Stored(numbered_choices(actions, "request_id", limit), "choices").df
    over = actions.where("permitted").groupBy("request_id").count().where(F.col("count") > limit)
    arrays = (
        graph.requests.select("request_id")
        .join(over, "request_id", "left_anti")
        .join(choice_arrays(numbered, "request_id"), "request_id", "left")
        .select(
            "request_id",
            F.coalesce("choices", F.lit(0)).alias("choices"),
            F.coalesce("ids", F.array().cast("array<string>")).alias("ids"),
            F.coalesce("costs", F.array().cast("array<bigint>")).alias("costs"),
        )
    )
    spread = Stored(arrays.withColumn("block", F.explode(blocks(F.col("choices")))), "blocks").df
    members = numbered.withColumn("block", F.explode(blocks(F.col("choices")))).select(
        "request_id", "block", "action_id", membership(F.col("idx"), F.col("block")).alias("bits")
    )
    return arrays, spread, members


def min_cost_actions(
    graph: PathGraph, actions: DataFrame, transitions: DataFrame, channels: DataFrame, limit: int = MAX_EXACT, max_exact: int = MAX_CLOSING
) -> DataFrame:
    """Cheapest permitted action set that closes each request.

    Up to ``limit`` permitted actions all subsets of a request are evaluated together as
    64-bit labels, and requests that no subset closes get the subset with the fewest
    violations.  Up to the request's ``max_exact_actions`` (``max_exact`` where it names
    none) :func:`closing_sets` searches by clauses; beyond that, :func:`greedy_actions`.
    """
    arrays, spread, members = _lattice(graph, actions, limit)
    usable = openable(graph, transitions)
    variants = Variants(usable, spread.select("request_id", "block"), members, transitions, channels)
    verdicts = Stored(variants.verdicts(), "verdicts").df
    subsets = spread.join(verdicts, ["request_id", "block"]).withColumn(
        "bit", F.explode(subsets_in_block(F.col("choices")))
    ).withColumn("mask", F.col("block") * 64 + F.col("bit"))
    closing = subsets.where(has(F.col("complete"), F.col("bit")))
    key = F.struct(*subset_key(F.col("costs"), F.col("mask"), limit))
    best = closing.groupBy("request_id").agg(F.min(key).alias("best"), F.first("ids").alias("ids"))
    taken = chosen(F.col("ids"), F.col("best.mask")).alias("action_ids")
    optimal = best.select(
        "request_id",
        taken,
        "best.total_cost",
        F.lit("COMPLETE").alias("verdict"),
        F.lit("OPTIMAL").alias("solver_status"),
        F.lit(0).cast("long").alias("violations"),
        F.col("best.total_cost").alias("lower_bound"),
        F.col("best.total_cost").alias("upper_bound"),
    )
    open_requests = Stored(
        arrays.select("request_id").join(best, "request_id", "left_anti"), "open-requests"
    ).df
    counts = variants.violations(variants.walks(open_requests), open_requests)
    partial = (
        subsets.join(open_requests, "request_id", "left_semi")
        .join(counts, ["request_id", "block"], "left")
        .withColumn("n", F.coalesce(F.element_at("violations", F.col("bit") + 1), F.lit(0)))
    )
    verdict = F.when(has(F.col("incomplete"), F.col("bit")), "INCOMPLETE").otherwise("UNVERIFIED")
    key = F.struct("n", *subset_key(F.col("costs"), F.col("mask"), limit), verdict.alias("verdict"))
    worst = partial.groupBy("request_id").agg(F.min(key).alias("best"), F.first("ids").alias("ids")).select(
        "request_id",
        taken,
        "best.total_cost",
        "best.verdict",
        F.lit("INFEASIBLE").alias("solver_status"),
        F.col("best.n").alias("violations"),
        F.lit(0).cast("long").alias("lower_bound"),
        F.lit(None).cast("long").alias("upper_bound"),
    )
    exact = optimal.unionByName(worst)
    counts = actions.where("permitted").groupBy("request_id").count().where(F.col("count") > limit)
    if counts.isEmpty():
        return exact
    own = F.col("max_exact_actions") if "max_exact_actions" in graph.requests.columns else F.lit(None)
    searched = F.col("count") <= F.coalesce(own.cast("long"), F.lit(max_exact))
    large = Stored(counts.join(graph.requests, "request_id").select("request_id", searched.alias("searched")), "large-requests").df
    return exact.unionByName(_large_requests(graph, large, actions, transitions, channels))


def _large_requests(graph: PathGraph, large: DataFrame, actions: DataFrame, transitions: DataFrame, channels: DataFrame) -> DataFrame:
    """Plans of the requests beyond the lattice: exact where ``searched``, else greedy.

    A request that no set closes has its greedy set with the status INFEASIBLE; one
    whose search ran out of its budget has it as APPROXIMATE, with the search's bound.
    """
    wanted = large.where("searched").select("request_id")
    some = actions.join(wanted, "request_id", "left_semi")
    numbered = Stored(numbered_choices(some, "request_id", (1 << 31) - 1), "large-choices").df
    sets = closing_sets(_restricted(graph, wanted), numbered, choice_arrays(numbered, "request_id"), transitions, channels)
    sets = Stored(sets, "closing-sets").df
    optimal = sets.where("state = 'OPTIMAL'")
    zero = F.lit(0).cast("long")
    solved = optimal.select(
        "request_id", "action_ids", "total_cost", F.lit("COMPLETE").alias("verdict"), F.lit("OPTIMAL").alias("solver_status"),
        zero.alias("violations"), F.col("total_cost").alias("lower_bound"), F.col("total_cost").alias("upper_bound"),
    )
    rest = Stored(large.select("request_id").join(optimal, "request_id", "left_anti"), "unsolved-requests").df
    if rest.isEmpty():
        return solved
    greedy = greedy_actions(_restricted(graph, rest), actions.join(rest, "request_id", "left_semi"), transitions, channels)
    joined = greedy.join(sets.select("request_id", "state", "bound"), "request_id", "left")
    done = F.col("verdict") == "COMPLETE"
    return solved.unionByName(
        joined.select(
            "request_id", "action_ids", "total_cost", "verdict",
            F.when(F.col("state") == "INFEASIBLE", "INFEASIBLE").otherwise(F.col("solver_status")).alias("solver_status"),
            "violations", F.coalesce("bound", zero).alias("lower_bound"), F.when(done, F.col("total_cost")).alias("upper_bound"),
        )
    )


def greedy_actions(graph: PathGraph, actions: DataFrame, transitions: DataFrame, channels: DataFrame, limit: int = BLOCK_BITS) -> DataFrame:
    """Add the action with the largest violation drop per cost until nothing improves.

    All subsets of up to ``limit`` permitted actions (``BLOCK_BITS`` at most) are one block, so
    these requests are labelled once and the choices made along their counts.  Requests with
    more actions take a round of labels for each choice.
    """
    graph = openable(graph, transitions)
    arrays, spread, members = _lattice(graph, actions, min(limit, BLOCK_BITS))
    variants = Variants(graph, spread.select("request_id", "block"), members, transitions, channels)
    scored = spread.join(_scores(variants), ["request_id", "block"])
    walked = scored.withColumn("mask", _greedy_mask(F.col("ids"), F.col("costs"), F.col("complete"), F.col("v")))
    at = F.col("mask").cast("int")
    verdict = _verdict(at)
    taken = chosen(F.col("costs"), F.col("mask"))
    zero = F.lit(0).cast(arrays.schema["costs"].dataType.elementType)
    plans = walked.select(
        "request_id",
        chosen(F.col("ids"), F.col("mask")).alias("action_ids"),
        F.aggregate(taken, zero, lambda total, cost: total + F.coalesce(cost, zero)).alias("total_cost"),
        verdict.alias("verdict"),
        _greedy_status(verdict).alias("solver_status"),
        F.element_at("v", at + 1).alias("violations"),
    )
    over = actions.where("permitted").groupBy("request_id").count().where(F.col("count") > min(limit, BLOCK_BITS)).select("request_id")
    rest = Stored(graph.requests.select("request_id").join(over, "request_id", "left_semi"), "greedy-large")
    if rest.is_empty():
        return plans
    some = actions.join(rest.df, "request_id", "left_semi")
    return plans.unionByName(_greedy_rounds(_restricted(graph, rest.df), some, transitions, channels))


def _scores(variants: Variants) -> DataFrame:
    """Labels ``complete`` and ``incomplete`` and the violations ``v`` of each action set."""
    walks = variants.walks()
    return variants.verdicts(walks).join(variants.violations(walks), ["request_id", "block"], "left").select(
        "request_id", "block", "complete", "incomplete",
        F.coalesce("violations", F.array_repeat(F.lit(0).cast("long"), 64)).alias("v"),
    )


def _verdict(at: Column) -> Column:
    return F.when(has(F.col("complete"), at), "COMPLETE").when(has(F.col("incomplete"), at), "INCOMPLETE").otherwise("UNVERIFIED")


def _greedy_status(verdict: Column) -> Column:
    return F.when(verdict == "COMPLETE", "APPROXIMATE").otherwise("INFEASIBLE")


def _greedy_rate(gain: Column, cost: Column) -> Column:
    return F.when(cost == 0, F.lit(float("-inf"))).otherwise(-gain / cost)


def _greedy_mask(ids: Column, costs: Column, complete: Column, counts: Column) -> Column:
    """The subset at which the choices end: at most one step for each action."""
    bit = lambda i: shift_left(F.lit(1).cast("long"), i)
    count = lambda mask: F.element_at(counts, mask.cast("int") + 1)

    def step(mask: Column, _: Column) -> Column:
        def option(action: Column, i: Column) -> Column:
            gain, cost = count(mask) - count(either(mask, bit(i))), F.get(costs, i)
            return F.struct(_greedy_rate(gain, cost).alias("r"), cost.alias("cost"), action.alias("action_id"), gain.alias("gain"), i.alias("i"))

        best = F.array_min(F.filter(F.transform(ids, option), lambda o: o["gain"] > 0))
        return F.when(has(complete, mask.cast("int")) | best.isNull(), mask).otherwise(either(mask, bit(best["i"])))

    return F.aggregate(ids, F.lit(0).cast("long"), step)


def _greedy_rounds(graph: PathGraph, actions: DataFrame, transitions: DataFrame, channels: DataFrame) -> DataFrame:
    """:func:`greedy_actions` of an openable graph, for any number of actions.

    Each round scores every remaining action of every open request at once: bit
    ``i`` of a block stands for "the chosen set plus the i-th action".
    """
    permitted = actions.where("permitted").select("request_id", "action_id", "cost")
    ranked = group_rank(permitted, ["request_id"], ["action_id"], "place")
    numbered = Stored(
        ranked.withColumn("n", F.col("place") - 1).select(
            "request_id",
            "action_id",
            "cost",
            F.floor(F.col("n") / 63).alias("own_block"),
            (F.col("n") % 63).cast("int").alias("bit"),
        ),
        "greedy-choices",
    ).df
    block_table = Stored(
        graph.requests.select("request_id")
        .join(numbered.select("request_id", F.col("own_block").alias("block")).distinct(), "request_id", "left")
        .withColumn("block", F.coalesce("block", F.lit(0).cast("long"))),
        "greedy-blocks",
    ).df
    none = numbered.select("request_id", "action_id").limit(0)
    picked: list[Stored] = []
    history: list[Stored] = []
    active = graph.requests.select("request_id")
    while True:
        taken = union_stored(picked).select("request_id", "action_id") if picked else none
        # Bit 63 stands for the chosen set itself.
        flags = numbered.join(taken.withColumn("taken", F.lit(True)), ["request_id", "action_id"], "left")
        own = F.when(F.col("block") == F.col("own_block"), shift_left(F.lit(1).cast("long"), F.col("bit"))).otherwise(0)
        members = (
            flags.join(active, "request_id", "left_semi")
            .join(block_table, "request_id")
            .select(
                "request_id", "block", "action_id",
                F.when(F.col("taken"), F.lit(-1)).otherwise(own).cast("long").alias("bits"),
            )
            .where(F.col("bits") != 0)
        )
        live = block_table.join(active, "request_id", "left_semi")
        variants = Variants(_restricted(graph, active), live, members, transitions, channels)
        scored = Stored(_scores(variants), f"greedy-scores-{len(picked)}").df
        now = scored.where(F.col("block") == 0).select(
            "request_id",
            has(F.col("complete"), F.lit(63)).alias("done"),
            _verdict(F.lit(63)).alias("verdict"),
            F.element_at("v", 64).alias("current"),
            F.lit(len(history)).alias("round"),
        )
        history.append(Stored(now, f"greedy-state-{len(history)}"))
        options = (
            flags.where(F.col("taken").isNull())
            .join(scored.withColumnRenamed("block", "own_block"), ["request_id", "own_block"])
            .join(history[-1].df.where(~F.col("done")).select("request_id", "current"), "request_id")
            .withColumn("gain", F.col("current") - F.element_at("v", F.col("bit") + 1))
            .where(F.col("gain") > 0)
        )
        rate = _greedy_rate(F.col("gain"), F.col("cost")).alias("r")
        choice = options.groupBy("request_id").agg(F.min(F.struct(rate, "cost", "action_id")).alias("p"))
        level = Stored(choice.select("request_id", "p.action_id", "p.cost"), f"greedy-pick-{len(picked)}")
        if level.is_empty():
            break
        picked.append(level)
        active = level.df.select("request_id")
    final = union_stored(history).groupBy("request_id").agg(
        F.max(F.struct("round", "verdict", "current")).alias("last")
    )
    chosen_ids = (
        union_stored(picked).groupBy("request_id").agg(
            F.array_sort(F.collect_list("action_id")).alias("action_ids"), F.sum("cost").alias("total_cost")
        )
        if picked
        else none.groupBy("request_id").agg(F.collect_list("action_id").alias("action_ids"), F.lit(0).alias("total_cost"))
    )
    return final.join(chosen_ids, "request_id", "left").select(
        "request_id",
        F.coalesce("action_ids", F.array().cast("array<string>")).alias("action_ids"),
        F.coalesce("total_cost", F.lit(0)).alias("total_cost"),
        F.col("last.verdict").alias("verdict"),
        _greedy_status(F.col("last.verdict")).alias("solver_status"),
        F.col("last.current").alias("violations"),
    )


def _restricted(graph: PathGraph, requests: DataFrame) -> PathGraph:
    keep = lambda df: df.join(requests, "request_id", "left_semi")
    return PathGraph(
        keep(graph.nodes), keep(graph.edges), keep(graph.channels), keep(graph.requests),
        keep(graph.request_nodes), keep(graph.request_channels),
    )


def delete_all(graph: PathGraph, actions: DataFrame, transitions: DataFrame, channels: DataFrame) -> DataFrame:
    """Verdict and cost of taking every permitted action."""
    permitted = actions.where("permitted")
    cost = permitted.groupBy("request_id").agg(F.sum("cost").alias("total_cost"))
    after = evaluate_requests(apply_actions(graph, permitted, transitions, channels))
    return after.join(cost, "request_id", "left").select(
        "request_id", "verdict", F.coalesce("total_cost", F.lit(0)).alias("total_cost")
    )


# --- risk facts, hitting sets, costs, policies -------------------------------


def risk_facts(outcomes: DataFrame) -> DataFrame:
    """Risk facts that a control must close; none while evidence is missing."""
    known = F.col("coverage_complete") & F.col("derivative_present").isNotNull() & F.col("recovery_recurrence").isNotNull()
    facts = F.array_compact(
        F.array(
            F.when(~F.col("primary_absent"), F.lit("primary")),
            F.when(F.col("derivative_present"), F.lit("derivative")),
            F.when(F.col("recovery_recurrence"), F.lit("recovery")),
        )
    )
    return outcomes.where(known).select(F.col("case_id").alias("subject_id"), F.explode(facts).alias("artifact_id"))


def risk_control_plan(outcomes: DataFrame, controls: DataFrame, closes: DataFrame) -> DataFrame:
    """Cheapest controls for the risk facts of each case, with an explicit status."""
    plan = exact_cover(risk_facts(outcomes), controls, closes)
    cases = outcomes.select(F.col("case_id").alias("subject_id"))
    joined = cases.join(plan, "subject_id", "left")
    solved = F.col("uncovered") == 0
    return joined.select(
        F.col("subject_id").alias("case_id"),
        F.when(solved, F.col("action_ids")).otherwise(F.array().cast("array<string>")).alias("action_ids"),
        F.when(solved, F.col("total_cost")).otherwise(0).alias("total_cost"),
        F.when(F.col("uncovered").isNull(), "NOTHING_REQUIRED").when(solved, F.col("solver_status")).otherwise("INFEASIBLE").alias("status"),
    )


def min_hitting_sets(paths: DataFrame) -> DataFrame:
    """All smallest operation sets that meet every path of a graph.

    ``paths(graph_id, path_id, operations)``; a graph with an empty path cannot
    be controlled, and one without paths needs nothing.  ``size`` is null when
    uncontrollable.
    """
    listed = paths.select("graph_id", F.array_sort(F.array_distinct("operations")).alias("operations")).distinct()
    graphs = listed.groupBy("graph_id").agg(F.collect_list("operations").alias("paths"))
    return graphs.mapInArrow(_solve_hits, _typed(paths, "graph_id") + ", size bigint, operations array<string>")


def _solve_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest hitting sets of each graph's different paths."""
    for batch in batches:
        at, sizes, sets = [], [], []
        for k, paths in enumerate(batch.column("paths").to_pylist()):
            names = sorted({o for path in paths for o in path or ()})
            index = {o: i for i, o in enumerate(names)}
            found = all_smallest(sum(1 << index[o] for o in path or ()) for path in paths)
            for one in [None] if found is None else found:
                at.append(k)
                sizes.append(None if one is None else len(one))
                sets.append(None if one is None else [names[i] for i in one])
        yield pa.RecordBatch.from_arrays(
            [batch.column("graph_id").take(pa.array(at, pa.int64())), pa.array(sizes, pa.int64()), pa.array(sets, pa.list_(pa.string()))],
            ["graph_id", "size", "operations"],
        )


def calibrate_costs(measurements: DataFrame, by: str) -> DataFrame:
    """Integer cost per action: millionths of the median seconds, at least one."""
    median = exact_percentile(measurements, [by], "seconds", 0.5, "median")
    return median.select(by, F.greatest(F.lit(1), F.bround(F.col("median") * 1e6, 0).cast("long")).alias("cost"))


def model_remediation(checks: DataFrame, residuals: DataFrame, status: DataFrame, timings: DataFrame) -> DataFrame:
    """Method per subject from its model residue, audit status and measured times.

    Model residue: model artifacts on a residual path or without valid evidence.
    """
    on_paths = residuals.select("subject_id", F.explode("path").alias("artifact_id"))
    suspect = on_paths.unionByName(checks.where(~F.col("valid")).select("subject_id", "artifact_id")).distinct()
    models = (
        checks.where(F.col("type") == "MODEL_INFLUENCE")
        .join(suspect, ["subject_id", "artifact_id"], "left_semi")
        .groupBy("subject_id")
        .agg(F.count(F.lit(1)).alias("models"))
    )
    joined = status.select("subject_id", "status").join(models, "subject_id", "left").join(timings, "subject_id", "left")
    slow = F.col("exact_seconds") > F.col("deadline_seconds")
    untimed = F.col("exact_seconds").isNull() | F.col("deadline_seconds").isNull()
    method = (
        F.when(F.col("models").isNull(), "NO_ACTION")
        .when((F.col("status") == "UNVERIFIED") | untimed, "BLOCKED")
        .when(~slow, "EXACT_RETRAIN")
        .when(F.col("approximate_available"), "INFLUENCE_SELECTIVE")
        .otherwise("BLOCKED")
    )
    return joined.select("subject_id", method.alias("method"), F.coalesce("models", F.lit(0)).alias("models"))
