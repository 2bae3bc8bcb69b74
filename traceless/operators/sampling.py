"""Deterministic samples, splits, blocks and set operations.

Random choices are hash orders, so they do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceless.functions.statistics import draw
from traceless.functions.vectors import dot
from traceless.operators.ranking import group_rank, running_sum
from traceless.plans.workspace import Stored


def top1(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per group in the given ascending order, as a map-side aggregate."""
    key = F.struct(*[F.col(c) for c in order])
    rest = F.struct(*[F.col(c) for c in df.columns if c not in by])
    return df.groupBy(*by).agg(F.min_by(rest, key).alias("row")).select(*by, "row.*")


def robust_intervals(points: DataFrame, min_width: int) -> DataFrame:
    """Maximal runs of feasible points per path with at least ``min_width`` points.

    A run is named by the number of infeasible points before it, a distributed
    running count, so long paths are spread over several tasks.
    """
    from traceless.operators.ranking import running_sum

    gaps = running_sum(
        points.withColumns({"gap": (~F.col("feasible")).cast("long"), "one": F.lit(1).cast("long")}),
        ["path_id"],
        ["alpha"],
        {"island": "gap", "place": "one"},
    )
    runs = gaps.where("feasible").groupBy("path_id", "island").agg(
        F.count(F.lit(1)).alias("width"),
        F.min("alpha").alias("first_alpha"),
        F.max("alpha").alias("last_alpha"),
        F.min("place").alias("first_place"),
        F.min("minimum_margin").alias("margin"),
        F.max("worst_exact_gap").alias("gap"),
        F.min("minimum_speedup").alias("speedup"),
    )
    return runs.where(F.col("width") >= min_width)


def select_robust_point(points: DataFrame, min_width: int) -> DataFrame:
    """Lower-middle point of the best run: width, margin, gap, speed-up, then path id."""
    from traceless.operators.ranking import group_rank as ranked

    runs = Stored(robust_intervals(points, min_width), "runs").df
    key = F.struct(
        (-F.col("width")).alias("w"), (-F.col("margin")).alias("m"), F.col("gap").alias("g"),
        (-F.col("speedup")).alias("s"), "path_id", "first_alpha",
    )
    best = runs.agg(F.min_by(F.struct("path_id", "first_place", "width", "first_alpha"), key).alias("b")).select(
        F.col("b.path_id").alias("path_id"),
        (F.col("b.first_place") + F.floor((F.col("b.width") - 1) / 2)).alias("place"),
        F.col("b.width").alias("width"),
    ).where(F.col("path_id").isNotNull())
    return ranked(points, ["path_id"], ["alpha"], "place").join(F.broadcast(best), ["path_id", "place"]).drop("place")


def partition_blocks(rows: DataFrame, order: Sequence[str], fingerprint: str, size: int) -> DataFrame:
    """Blocks of ``size`` rows in order, with a commitment over each block's fingerprints."""
    ranked = group_rank(rows.withColumn("_all", F.lit(0)), ["_all"], list(order), "position")
    block = F.floor((F.col("position") - 1) / size)
    grouped = ranked.withColumn("block", block).groupBy("block").agg(
        F.count(F.lit(1)).alias("rows"),
        F.array_sort(F.collect_list(F.struct("position", fingerprint))).alias("o"),
    )
    text = F.array_join(F.col(f"o.{fingerprint}"), ",")
    return grouped.select("block", "rows", F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("commitment"))


def duplicate_rows(rows: DataFrame, fingerprint: str) -> DataFrame:
    return rows.groupBy(fingerprint).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def _hash_ranked(df: DataFrame, group: Sequence[str], id_col: str, seed: int) -> DataFrame:
    marked = df.withColumn("_u", draw(F.lit(seed), F.col(id_col)))
    return group_rank(marked, list(group), ["_u", id_col], "_pos").drop("_u")


def subject_split(df: DataFrame, subject: str, id_col: str, seed: int, n: int | None = None, fraction: float | None = None) -> DataFrame:
    """Adds ``is_test``: n rows per subject, or ``max(1, round(size * fraction))`` of them."""
    ranked = _hash_ranked(df, [subject], id_col, seed)
    if n is not None:
        return ranked.withColumn("is_test", F.col("_pos") <= n).drop("_pos")
    sizes = df.groupBy(subject).agg(F.count(F.lit(1)).alias("_size"))
    take = F.greatest(F.lit(1), F.bround(F.col("_size") * F.lit(float(fraction)), 0))
    return ranked.join(sizes, subject).withColumn("is_test", F.col("_pos") <= take).drop("_pos", "_size")


def nth_per_group(df: DataFrame, key: str, order: Sequence[str], offset: int) -> DataFrame:
    """The row at 0-based ``offset`` of every group."""
    return group_rank(df, [key], list(order), "_pos").where(F.col("_pos") == offset + 1).drop("_pos")


def hash_sample_groups(df: DataFrame, key: str, min_rows: int, k: int, domain: str) -> DataFrame:
    """k group keys with enough rows, in the order of a domain-separated hash (top-k)."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= min_rows)
    digest = F.sha2(F.concat(F.lit(domain), F.col(key).cast("string")), 256)
    return sizes.withColumn("digest", digest).orderBy("digest").limit(k)


def balanced_membership(samples: DataFrame, id_col: str, shadows: int, inclusions: int, seed: int) -> DataFrame:
    """Each sample in exactly ``inclusions`` of the shadows, by hash order of the shadows."""
    if not 1 <= inclusions < shadows:
        raise ValueError("inclusions must be between one and shadows - 1")
    order = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.lit(shadows - 1)),
            lambda s: F.named_struct(F.lit("u"), draw(F.lit(seed), F.col(id_col), s), F.lit("shadow"), s),
        )
    )
    picked = F.transform(F.slice(order, 1, inclusions), lambda x: x["shadow"])
    spread = samples.select(id_col, picked.alias("picked"), F.explode(F.sequence(F.lit(0), F.lit(shadows - 1))).alias("shadow"))
    return spread.select(id_col, "shadow", F.array_contains("picked", F.col("shadow")).alias("included"))


def verification_pairs(vectors: DataFrame, id_col: str, label: str, column: str, seed: int, strides: int = 1) -> DataFrame:
    """Positive and negative similarity pairs without forming all pairs.

    Positives join each vector to the next ``strides`` ones of its identity in
    hash order; negatives join it to the next ones on a global hash wheel and
    keep the pairs of different identities.
    """
    steps = F.explode(F.sequence(F.lit(1), F.lit(strides)))
    mine = Stored(_hash_ranked(vectors.select(id_col, label, column), [label], id_col, seed), "identity-order").df
    following = mine.select(label, F.col("_pos").alias("_to"), F.col(column).alias("_next"))
    score = dot(F.col(column), F.col("_next")).alias("score")
    positive = (
        mine.withColumn("_step", steps).withColumn("_to", F.col("_pos") + F.col("_step")).join(following, [label, "_to"])
        .select("_pos", "_to", score, F.lit(True).alias("is_member"))
    )
    wheel = Stored(
        _hash_ranked(vectors.select(id_col, label, column).withColumn("_all", F.lit(0)), ["_all"], id_col, seed + 1), "wheel"
    ).df
    size = wheel.agg(F.max("_pos").alias("n"))
    after = wheel.select(F.col("_pos").alias("_to"), F.col(label).alias("_label"), F.col(column).alias("_next"))
    negative = (
        wheel.crossJoin(F.broadcast(size))
        .withColumn("_step", steps)
        .withColumn("_to", (F.col("_pos") + F.col("_step") - 1) % F.col("n") + 1)
        .join(after, "_to")
        .where(F.col(label) != F.col("_label"))
        .select("_pos", "_to", score, F.lit(False).alias("is_member"))
    )
    return positive.unionByName(negative).withColumnsRenamed({"_pos": "left_place", "_to": "right_place"})


def wide_draw(*parts: Column) -> Column:
    """Deterministic integer in [0, 10^18) from integer columns."""
    low, middle, high = (draw(*parts, F.lit(n)) for n in (2, 1, 0))
    return high * 1_000_000_000_000 + middle * 1_000_000 + low


def pair_ranks(spark, total: int, wanted: int, seed: int) -> DataFrame:
    """``order, rank``: ``wanted`` different ranks below ``total``, or all if there are no more.

    Draws are numbered and a rank counts at its first draw; where more than half of all
    ranks are wanted, all of them are put in hash order instead.
    """
    if wanted * 2 >= total:
        ranks = spark.range(total).select(wide_draw(F.lit(seed), F.col("id")).alias("order"), F.col("id").alias("rank"))
        return group_rank(ranks.withColumn("all", F.lit(0)), ["all"], ["order", "rank"], "place").where(F.col("place") <= wanted).select("order", "rank")
    draws = wanted
    while True:
        draws *= 2
        numbered = spark.range(draws).select("id", (wide_draw(F.lit(seed), F.col("id")) % total).alias("rank"))
        fresh = Stored(numbered.groupBy("rank").agg(F.min("id").alias("order")), "pair-ranks").df
        if fresh.count() >= wanted:
            break
    ranked = group_rank(fresh.withColumn("all", F.lit(0)), ["all"], ["order"], "place")
    return ranked.where(F.col("place") <= wanted).select("order", "rank")


def _unranked(rank: Column) -> tuple[Column, Column]:
    """The pair ``i < j`` (from 0) that has this rank when pairs go by j, then i."""
    guess = F.floor((F.sqrt(rank * 8.0 + 1.0) + 1.0) / 2.0).cast("long")
    below = lambda j: F.shiftright(j * (j - 1), 1)
    j = F.when(below(guess) > rank, guess - 1).when(below(guess + 1) <= rank, guess + 1).otherwise(guess)
    return rank - below(j), j


def sample_pairs(vectors: DataFrame, id_col: str, label: str, column: str, max_pairs: int, seed: int) -> DataFrame:
    """``max_pairs`` pairs of one identity, or all if there are fewer, and as many of two identities.

    The first are drawn from all ``n (n - 1) / 2`` pairs of every identity: a rank is drawn
    and turned into an identity and a pair by arithmetic, so no table of pairs exists.  The
    others are pairs of drawn vectors, as often as it takes.  Rows without a label take no
    part; a table of one identity has no pairs of two.
    """
    spark = vectors.sparkSession
    labelled = vectors.where(F.col(label).isNotNull()).select(id_col, label, column)
    mine = Stored(_hash_ranked(labelled, [label], id_col, seed), "identity-order").df
    sizes = Stored(
        mine.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("long")).withColumn("all", F.lit(0)),
        "identity-sizes",
    ).df
    rows, pairs, labels, squares = sizes.agg(F.sum("n"), F.sum("pairs"), F.count(F.lit(1)), F.sum(F.col("n").cast("double") ** 2)).first()
    wanted = min(max_pairs, pairs or 0)
    kind = f"left_id {dict(vectors.dtypes)[id_col]}, right_id {dict(vectors.dtypes)[id_col]}, score double, is_member boolean"
    if not wanted:
        return spark.createDataFrame([], kind)
    # every identity owns a stretch of the ranks; equal steps of them find it by equality
    step = -(-pairs // max(4096, labels))
    stretch = running_sum(sizes.where("pairs > 0"), ["all"], [label], {"until": "pairs"}).withColumn("start", F.col("until") - F.col("pairs"))
    steps = F.sequence(F.floor(F.col("start") / step), F.floor((F.col("until") - 1) / step))
    owned = stretch.select(label, "start", "until", F.explode(steps).alias("step"))
    ranks = pair_ranks(spark, pairs, wanted, seed).withColumn("step", F.floor(F.col("rank") / step))
    within = ranks.join(owned, "step").where("rank >= start and rank < until").withColumn("rank", F.col("rank") - F.col("start"))
    first, second = _unranked(F.col("rank"))
    ends = within.select(label, (first + 1).alias("_left"), (second + 1).alias("_right"))
    left = mine.select(label, F.col("_pos").alias("_left"), F.col(id_col).alias("left_id"), F.col(column).alias("_x"))
    right = mine.select(label, F.col("_pos").alias("_right"), F.col(id_col).alias("right_id"), F.col(column).alias("_y"))
    score = dot(F.col("_x"), F.col("_y")).alias("score")
    same = ends.join(left, [label, "_left"]).join(right, [label, "_right"]).select("left_id", "right_id", score, F.lit(True).alias("is_member"))
    if labels < 2:
        return same
    wheel = Stored(_hash_ranked(labelled.withColumn("_all", F.lit(0)), ["_all"], id_col, seed + 1), "wheel").df
    draws = int(wanted / (1 - squares / rows**2) * 1.5) + 64
    left = wheel.select(F.col("_pos").alias("_left"), F.col(id_col).alias("left_id"), F.col(label).alias("_a"))
    right = wheel.select(F.col("_pos").alias("_right"), F.col(id_col).alias("right_id"), F.col(label).alias("_b"))
    while True:
        places = [(wide_draw(F.lit(seed + n), F.col("id")) % rows + 1).alias(c) for n, c in ((1, "_left"), (2, "_right"))]
        drawn = spark.range(draws).select("id", *places).join(left, "_left").join(right, "_right").where(F.col("_a") != F.col("_b"))
        drawn = Stored(drawn.select("id", "left_id", "right_id", "_left", "_right"), "drawn-pairs").df
        if drawn.count() >= wanted:
            break
        draws *= 2
    kept = group_rank(drawn.withColumn("all", F.lit(0)), ["all"], ["id"], "place").where(F.col("place") <= wanted)
    x = wheel.select(F.col("_pos").alias("_left"), F.col(column).alias("_x"))
    y = wheel.select(F.col("_pos").alias("_right"), F.col(column).alias("_y"))
    other = kept.join(x, "_left").join(y, "_right").select("left_id", "right_id", score, F.lit(False).alias("is_member"))
    return same.unionByName(other)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def assemble_folds(rows: DataFrame, assignment: DataFrame, block: str) -> DataFrame:
    """Rows with the fold of their block; blocks without a fold are reserved."""
    return rows.join(assignment, block, "left").withColumn("fold", F.coalesce("fold", F.lit("reserved")))


def fold_overlap(folded: DataFrame, fingerprint: str) -> DataFrame:
    """Fingerprints that occur in more than one fold."""
    return folded.groupBy(fingerprint).agg(F.countDistinct("fold").alias("folds")).where(F.col("folds") > 1)


def even_sample(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """n rows at the positions floor(i * N / n)."""
    ranked = Stored(group_rank(df.withColumn("_all", F.lit(0)), ["_all"], list(order), "_pos"), "even").df
    size = ranked.agg(F.count(F.lit(1)).alias("_n"))
    wanted = size.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("i"), "_n").select(
        (F.floor(F.col("i") * F.col("_n") / n) + 1).alias("_pos")
    ).distinct()
    return ranked.join(wanted, "_pos", "left_semi").drop("_pos", "_all")


def exclude_reserved(rows: DataFrame, reserved: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.join(reserved.select(*columns).distinct(), list(columns), "left_anti")


def expand_perturbations(df: DataFrame, keys: Sequence[str], direct: str, paraphrase: str, perturbed: str, k: int) -> DataFrame:
    """One row per variant of a row; ``count_ok`` tells whether there are exactly k perturbed texts."""
    variants = F.concat(
        F.array(
            F.struct(F.lit("direct").alias("kind"), F.lit(0).alias("position"), F.col(direct).alias("text")),
            F.struct(F.lit("paraphrase").alias("kind"), F.lit(0).alias("position"), F.col(paraphrase).alias("text")),
        ),
        F.transform(perturbed, lambda x, i: F.struct(F.lit("perturbed").alias("kind"), i.alias("position"), x.alias("text"))),
    )
    return df.select(*keys, (F.size(perturbed) == k).alias("count_ok"), F.inline(variants))


def set_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of union, intersection and symmetric difference of two id sets."""
    marked = a.distinct().withColumn("l", F.lit(1)).unionByName(b.distinct().withColumn("l", F.lit(2)))
    keys: list[Column] = [F.col(c) for c in a.columns]
    sides = marked.groupBy(*keys).agg(F.sum("l").alias("s"))
    return sides.agg(
        F.count(F.lit(1)).alias("union_size"),
        F.count_if(F.col("s") == 3).alias("intersection_size"),
        F.count_if(F.col("s") != 3).alias("difference_size"),
    )
