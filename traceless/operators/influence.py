"""Model-influence and membership-privacy metrics over scores and vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceless.functions.statistics import ratio
from traceless.functions.vectors import as_vector, component_sums, dot, doubles, squared_distance, total, unit
from traceless.operators.ranking import group_rank, running_sum
from traceless.plans.workspace import Stored


def score_statistics(df: DataFrame, logits: str) -> DataFrame:
    """Adds confidence, energy, margin and negative entropy of a logit vector."""
    values = doubles(logits)
    peak = F.array_max(values)
    exps = F.transform(values, lambda x: F.exp(x - peak))
    mass = total(exps)
    df = df.withColumns({"_peak": peak, "_mass": mass, "_p": F.transform(exps, lambda e: e / mass)})
    ordered = F.reverse(F.array_sort("_p"))
    entropy = total(F.transform("_p", lambda p: p * F.ln(F.greatest(p, F.lit(1e-12)))))
    return df.withColumns(
        {
            "confidence": F.array_max("_p"),
            "energy": F.col("_peak") + F.ln("_mass"),
            "margin": F.element_at(ordered, 1) - F.element_at(ordered, 2),
            "negative_entropy": entropy,
        }
    ).drop("_peak", "_mass", "_p")


# --- rank statistics ---------------------------------------------------------


def _ladder(scores: DataFrame, by: Sequence[str], descending: bool = False) -> DataFrame:
    """Members and others per distinct score with inclusive running counts."""
    counts = scores.where(F.col("score").isNotNull()).groupBy(*by, "score").agg(
        F.count_if("is_member").alias("members"), F.count_if(~F.col("is_member")).alias("others")
    )
    order = F.desc("score") if descending else F.asc("score")
    return running_sum(counts, list(by), [order], {"cum_members": "members", "cum_others": "others"})


def roc_auc(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """AUC with half credit for ties, its symmetric form and the advantage.

    Works on one row per distinct score: a member beats all others below its
    score and half of those at its score.
    """
    wins = F.col("members") * (F.col("cum_others") - F.col("others") + F.col("others") / 2)
    sums = _ladder(scores, by).groupBy(*by).agg(
        F.sum(wins).alias("wins"), F.sum("members").alias("m"), F.sum("others").alias("o")
    )
    auc = ratio(F.col("wins"), F.col("m") * F.col("o"))
    symmetric = F.greatest(auc, 1 - auc)
    return sums.select(
        *by,
        auc.alias("auc"),
        symmetric.alias("symmetric_auc"),
        (2 * (symmetric - 0.5)).alias("advantage"),
        F.col("m").alias("members"),
        F.col("o").alias("others"),
    )


def tpr_at_fpr(scores: DataFrame, by: Sequence[str], target: float) -> DataFrame:
    """Largest true-positive rate whose false-positive rate stays within ``target``."""
    ladder = _ladder(scores, by, descending=True)
    sums = ladder.groupBy(*by).agg(
        F.sum("members").alias("m"), F.sum("others").alias("o"), F.max("score").alias("top")
    )
    joined = ladder.join(sums, list(by))
    allowed = F.col("cum_others") <= F.lit(target) * F.col("o")
    best = F.max(F.when(allowed, F.col("cum_members") / F.col("m")))
    return joined.groupBy(*by).agg(F.coalesce(best, F.lit(0.0)).alias("tpr"))


def membership_attack(scores: DataFrame, by: Sequence[str], target: float) -> DataFrame:
    """AUC, advantage and TPR at a fixed FPR, flipping the score when members rank low."""
    auc = roc_auc(scores, by)
    sign = auc.select(*by, F.when(F.col("auc") < 0.5, -1.0).otherwise(1.0).alias("sign"))
    flipped = scores.join(sign, list(by)).withColumn("score", F.col("score") * F.col("sign"))
    return auc.join(tpr_at_fpr(flipped.drop("sign"), by, target), list(by))


def worst_attack(results: DataFrame, by: Sequence[str]) -> DataFrame:
    return results.groupBy(*by).agg(F.max("advantage").alias("worst_advantage"))


# --- shadow models -----------------------------------------------------------


def split_shadows(scores: DataFrame) -> DataFrame:
    """In/out counts per sample; ``ok`` only when both sides exist and counts agree."""
    sides = scores.groupBy("sample_id").agg(
        F.count_if("included").alias("n_in"), F.count_if(~F.col("included")).alias("n_out")
    )
    spread = sides.agg(F.min("n_in").alias("least"), F.max("n_in").alias("most"))
    return sides.crossJoin(F.broadcast(spread)).select(
        "sample_id",
        "n_in",
        "n_out",
        ((F.col("least") == F.col("most")) & (F.col("n_in") > 0) & (F.col("n_out") > 0)).alias("ok"),
    )


def lira(target: DataFrame, shadows: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Gaussian log-likelihood ratio of each target score, in- versus out-shadows."""
    inside = F.when(F.col("included"), F.col("score"))
    outside = F.when(~F.col("included"), F.col("score"))
    moments = shadows.groupBy("sample_id").agg(
        F.avg(inside).alias("mean_in"),
        F.var_pop(inside).alias("var_in"),
        F.avg(outside).alias("mean_out"),
        F.var_pop(outside).alias("var_out"),
    )

    def density(side: str) -> Column:
        variance = F.greatest(F.col(f"var_{side}"), F.lit(floor))
        offset = F.col("score") - F.col(f"mean_{side}")
        return -0.5 * (F.ln(2 * math.pi * variance) + offset * offset / variance)

    return target.join(moments, "sample_id").select(
        "sample_id", (density("in") - density("out")).alias("llr")
    )


# --- vectors -----------------------------------------------------------------


def l2_normalize(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, unit(doubles(column)))


#: Most pivots, and most blocks of members, that routing tasks get.
MAX_PIVOTS = 1024
MAX_BLOCKS = 65_536
#: Queries of one matrix product's group, and slack in radians for rounded angles.
QUERY_ROWS = 65_536
SLACK = 1e-6


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0))


def _products(queries: DataFrame, blocks: DataFrame, id_col: str, shards: int) -> DataFrame:
    """``(id, cosine, products)``: the best of every routed query, one group per block and query shard."""
    kind = queries.schema[id_col].dataType.simpleString()
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    left = queries.withColumn("shard", F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int"))
    right = blocks.select("cell", "block", id_col, "v", every)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({id_col: a[id_col][:0], "cosine": np.zeros(0), "products": np.zeros(0, dtype=np.int64)})
        gallery, names, top = np.stack(b["v"].to_numpy()), b[id_col].to_numpy(), []
        for start in range(0, len(a), 1024):
            part = a.iloc[start : start + 1024]
            products = np.stack(part["v"].to_numpy()) @ gallery.T
            products[part[id_col].to_numpy()[:, None] == names[None, :]] = -np.inf
            top.append(products.max(axis=1))
        return pd.DataFrame({id_col: a[id_col].to_numpy(), "cosine": np.concatenate(top), "products": np.int64(len(b))})

    keys = ["cell", "block", "shard"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, f"`{id_col}` {kind}, cosine double, products long")
    return met.groupBy(id_col).agg(F.max("cosine").alias("cosine"), F.sum("products").alias("products"))


def nearest_member_work(vectors: DataFrame, id_col: str, column: str, member: str, block_rows: int = 4096) -> DataFrame:
    """``(id, cosine, products)``: largest cosine to a member and the number of products it took.

    Members fall to the nearest of some pivots (members with the least hashes) and, in the
    order of their angle to it, into blocks of about ``block_rows``.  A query first meets
    the block around its own angle at its nearest pivot.  The angle of the best member found
    there bounds the others: a block whose angles to its pivot all differ by more from the
    query's own angle to that pivot can't hold a nearer one.  Queries go to the blocks that
    are left.  Vectors without structure leave nearly all blocks; results are exact always.
    """
    rows = Stored(vectors.select(id_col, member, unit(doubles(column)).alias("v")).where("v is not null"), "unit-vectors")
    total, n = rows.df.count(), rows.df.where(member).count()
    size = max(block_rows, math.ceil(n / MAX_BLOCKS))
    shards = max(1, math.ceil(total / QUERY_ROWS))
    if n <= size:  # one block: nothing to route
        one = {"cell": F.lit(0), "block": F.lit(0)}
        queries, members = rows.df.drop(member).withColumns(one), rows.df.where(member).withColumns(one)
        return _products(queries, members, id_col, shards).where(F.col("cosine") > float("-inf"))
    first = rows.df.where(member).orderBy(F.xxhash64(id_col), id_col).limit(max(1, min(MAX_PIVOTS, math.ceil(n / size))))
    pivots = np.array([row.v for row in first.select("v").collect()])
    kind = vectors.schema[id_col].dataType.simpleString()

    def place(batches):
        for pdf in batches:
            if len(pdf):
                angles = _angles(np.stack(pdf["v"].to_numpy()), pivots)
                cell = angles.argmin(axis=1)
                yield pdf.assign(cell=cell.astype("int32"), angle=angles[np.arange(len(pdf)), cell])[[id_col, "v", "cell", "angle"]]

    cells = rows.df.where(member).select(id_col, "v").mapInPandas(place, f"`{id_col}` {kind}, v array<double>, cell int, angle double")
    cells = Stored(cells, "member-cells")
    ranked = group_rank(cells.df.select(id_col, "cell", "angle"), ["cell"], ["angle", id_col], "nth")
    block = F.floor((F.col("nth") - 1) / size).cast("int").alias("block")
    named = ranked.select(F.col(id_col).alias("member_id"), F.col("cell").alias("of_cell"), "angle", block)
    named = Stored(named, "member-blocks")
    same = F.col(id_col) == F.col("member_id")
    members = Stored(cells.df.select(id_col, "v", "cell").join(named.df.select("member_id", "block"), same), "blocks").df
    bounds = named.df.groupBy(F.col("of_cell").alias("cell"), "block").agg(F.min("angle").alias("low"), F.max("angle").alias("high"))
    bounds = bounds.orderBy("cell", "block").toPandas()  # MAX_BLOCKS + MAX_PIVOTS rows at most
    cell, low, high = (bounds[c].to_numpy() for c in ("cell", "low", "high"))
    number = bounds["block"].to_numpy()

    def apart(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least angle that each block allows, and the block of the first visit."""
        angles = _angles(vectors, pivots)
        at = angles[:, cell]
        away = np.maximum(np.maximum(at - high, low - at), 0.0)
        home = angles[:, np.unique(cell)].argmin(axis=1)
        return away, np.where(cell[None, :] == np.unique(cell)[home][:, None], away, np.inf).argmin(axis=1)

    routed = f"`{id_col}` {kind}, v array<double>, cell int, block int"

    def send(pdf: pd.DataFrame, query: np.ndarray, target: np.ndarray) -> pd.DataFrame:
        part = pdf.iloc[query]
        return pd.DataFrame({id_col: part[id_col].to_numpy(), "v": part["v"].to_numpy(), "cell": cell[target], "block": number[target]})

    def visit_first(batches):
        for pdf in batches:
            for start in range(0, len(pdf), 64):
                part = pdf.iloc[start : start + 64]
                yield send(part, np.arange(len(part)), apart(np.stack(part["v"].to_numpy()))[1])

    def visit_rest(batches):
        for pdf in batches:
            for start in range(0, len(pdf), 64):
                part = pdf.iloc[start : start + 64]
                away, home = apart(np.stack(part["v"].to_numpy()))
                reach = np.arccos(np.clip(part["cosine"].to_numpy(), -1.0, 1.0)) + SLACK
                left = away <= reach[:, None]
                left[np.arange(len(part)), home] = False
                yield send(part, *np.nonzero(left))

    queries = rows.df.select(id_col, "v")
    near = Stored(_products(queries.mapInPandas(visit_first, routed), members, id_col, shards), "first-visit")
    bounded = near.df.select(F.col(id_col).alias("near_id"), "cosine")
    known = queries.join(bounded, F.col(id_col) == F.col("near_id")).select(id_col, "v", "cosine")
    rest = _products(known.mapInPandas(visit_rest, routed), members, id_col, shards)
    both = near.df.unionByName(rest).groupBy(id_col)
    best = both.agg(F.max("cosine").alias("cosine"), F.sum("products").alias("products"))
    return best.where(F.col("cosine") > float("-inf"))  # the only member has no other


def nearest_member(vectors: DataFrame, id_col: str, column: str, member: str, block_rows: int = 4096) -> DataFrame:
    """Largest cosine to a member, a member's own vector excluded; see ``nearest_member_work``."""
    return nearest_member_work(vectors, id_col, column, member, block_rows).select(id_col, "cosine")


def identity_cohesion(vectors: DataFrame, label: str, column: str, width: int) -> DataFrame:
    """Mean cosine of each vector to the other members of its identity.

    Uses the group's vector sum, so no pairs are formed: the sum of cosines to
    the others is v.S minus v.v.
    """
    unitised = vectors.withColumn("_v", unit(doubles(column)))
    sums = unitised.groupBy(label).agg(
        F.count(F.lit(1)).alias("_n"), *component_sums(F.col("_v"), width)
    )
    sums = sums.select(label, "_n", as_vector(width).alias("_s"))
    own = dot(F.col("_v"), F.col("_v"))
    cohesion = (dot(F.col("_v"), F.col("_s")) - own) / (F.col("_n") - 1)
    return (
        unitised.join(sums, label)
        .where(F.col("_n") > 1)
        .select(*vectors.columns, cohesion.alias("cohesion"))
    )


def gram_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long table ``(i, j, value)`` of the products of [1, columns...] summed over all rows.

    Each task folds its Arrow batches into one matrix and emits it once.
    """
    packed = df.select(
        F.concat(F.array(F.lit(1.0)), *[doubles(c) for c in columns]).alias("z")
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = None
        for batch in batches:
            if len(batch):
                z = np.stack(batch["z"].to_numpy())
                sums = z.T @ z if sums is None else sums + z.T @ z
        if sums is not None:
            i, j = np.indices(sums.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "value": sums.ravel()})

    partial = packed.mapInPandas(fold, "i int, j int, value double")
    return partial.groupBy("i", "j").agg(F.sum("value").alias("value"))


def linear_cka(df: DataFrame, left: str, right: str, width: int) -> DataFrame:
    """Linear alignment of two representations of the same rows."""
    gram = gram_table(df, [left, right])
    head = gram.where(F.col("i") == 0).select(F.col("j").alias("k"), F.col("value").alias("column_sum"))
    n = head.where(F.col("k") == 0).select(F.col("column_sum").alias("n"))
    body = gram.where((F.col("i") > 0) & (F.col("j") > 0))
    si = head.toDF("i", "sum_i")
    sj = head.toDF("j", "sum_j")
    centred = (
        body.join(F.broadcast(si), "i")
        .join(F.broadcast(sj), "j")
        .crossJoin(F.broadcast(n))
        .withColumn("c", F.col("value") - F.col("sum_i") * F.col("sum_j") / F.col("n"))
    )
    in_left = lambda c: F.col(c) <= width
    square = F.col("c") * F.col("c")
    return centred.agg(
        F.sum(F.when(in_left("i") & ~in_left("j"), square)).alias("cross"),
        F.sum(F.when(in_left("i") & in_left("j"), square)).alias("left_norm"),
        F.sum(F.when(~in_left("i") & ~in_left("j"), square)).alias("right_norm"),
    ).select(
        F.coalesce(
            ratio(F.col("cross"), F.sqrt("left_norm") * F.sqrt("right_norm")), F.lit(0.0)
        ).alias("cka")
    )


def split_mse(a: DataFrame, b: DataFrame, id_col: str, column: str, group: str) -> DataFrame:
    """Mean squared component difference per group (forgotten, retained)."""
    joined = a.select(id_col, group, doubles(column).alias("_a")).join(
        b.select(id_col, doubles(column).alias("_b")), id_col
    )
    per_row = squared_distance(F.col("_a"), F.col("_b")) / F.size("_a")
    return joined.groupBy(group).agg(F.avg(per_row).alias("mse"))


def align_probs(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Probabilities by class name as an array in the order of ``classes``; absent ones are 0."""
    pairs = F.col("probabilities")
    vector = F.transform(
        F.array(*[F.lit(c) for c in classes]), lambda c: F.coalesce(F.element_at(pairs, c), F.lit(0.0))
    )
    unknown = F.size(F.array_except(F.map_keys(pairs), F.array(*[F.lit(c) for c in classes])))
    return df.withColumns({"vector": vector, "unknown_classes": unknown.cast("long")})


def mean_tv(a: DataFrame, b: DataFrame, id_col: str, column: str) -> DataFrame:
    """Mean total-variation distance of two aligned probability tables."""
    joined = a.select(id_col, F.col(column).alias("_a")).join(b.select(id_col, F.col(column).alias("_b")), id_col)
    distance = 0.5 * total(F.zip_with("_a", "_b", lambda x, y: F.abs(x - y)))
    return joined.agg(F.avg(distance).alias("mean_tv"))


def release_difference(previous: DataFrame, current: DataFrame, id_col: str, logits: str, member: str) -> DataFrame:
    """Membership advantage of the change of each score statistic between two releases."""
    names = ["confidence", "energy", "margin", "negative_entropy"]
    before = score_statistics(previous, logits).select(id_col, *[F.col(n).alias(f"_{n}") for n in names])
    after = score_statistics(current, logits).select(id_col, F.col(member).alias("is_member"), *names)
    joined = after.join(before, id_col)
    rows = [F.struct(F.lit(n).alias("statistic"), F.abs(F.col(n) - F.col(f"_{n}")).alias("score")) for n in names]
    long = joined.select("is_member", F.inline(F.array(*rows)))
    return roc_auc(long.withColumn("score", F.round("score", 9)), ["statistic"]).select("statistic", "auc", "advantage")


def compare_predictions(stale: DataFrame, exact: DataFrame, truth: DataFrame, forgotten: str) -> DataFrame:
    """Accuracies, disagreement and the stale model's mean probability of the forgotten class."""
    joined = truth.join(stale.select("sample_id", F.col("label").alias("stale"), F.col("p_forgotten").alias("ps")), "sample_id").join(
        exact.select("sample_id", F.col("label").alias("exact"), F.col("p_forgotten").alias("pe")), "sample_id"
    )
    kept = F.col("truth") != forgotten
    gone = ~kept
    right = lambda c: (F.col(c) == F.col("truth")).cast("double")
    return joined.agg(
        F.avg(F.when(kept, right("stale"))).alias("stale_retained_accuracy"),
        F.avg(F.when(kept, right("exact"))).alias("exact_retained_accuracy"),
        F.avg(F.when(kept, (F.col("stale") != F.col("exact")).cast("double"))).alias("retained_disagreement"),
        F.avg(F.when(gone, F.coalesce("ps", F.lit(0.0)))).alias("stale_forgotten_probability"),
        F.avg(F.when(gone, F.coalesce("pe", F.lit(0.0)))).alias("exact_forgotten_probability"),
    )


def ridge_stats(df: DataFrame, features: str, target: str) -> DataFrame:
    """Sufficient statistics of a linear model: summed products of [1, features, target]."""
    return gram_table(df.withColumn("_y", F.array(F.col(target).cast("double"))), [features, "_y"])


def downdate(stats: DataFrame, forgotten: DataFrame) -> DataFrame:
    """Statistics with the forgotten rows' contribution removed."""
    minus = forgotten.withColumnRenamed("value", "gone")
    return stats.join(minus, ["i", "j"], "left").select(
        "i", "j", (F.col("value") - F.coalesce("gone", F.lit(0.0))).alias("value")
    )


def stats_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    other = b.withColumnRenamed("value", "other")
    return a.join(other, ["i", "j"], "full_outer").agg(
        F.max(F.abs(F.coalesce("value", F.lit(0.0)) - F.coalesce("other", F.lit(0.0)))).alias("max_delta")
    )


def pair_metrics(pairs: DataFrame, far_target: float, by: Sequence[str] = ()) -> DataFrame:
    """AUC, true accepts at a rate of false ones, and counts of a table ``score, is_member`` of pairs."""
    keys = list(by) or ["_all"]
    keyed = pairs if by else pairs.withColumn("_all", F.lit(0))
    auc = roc_auc(keyed, keys).select(*keys, "auc", F.col("members").alias("positive_pairs"), F.col("others").alias("negative_pairs"))
    return auc.join(tpr_at_fpr(keyed, keys, far_target).withColumnRenamed("tpr", "tar_at_far"), keys).drop("_all")
