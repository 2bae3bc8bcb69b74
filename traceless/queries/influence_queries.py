"""Privacy attacks and model-influence metrics over scores and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceless.functions.vectors import doubles
from traceless.operators import influence as M
from traceless.operators import sampling as W
from traceless.plans import trial_tables  # noqa: F401
from traceless.plans.catalog import projection, table
from traceless.queries.outcome_queries import duck_auc, duck_draw, rounded
from traceless.queries.registry import query

DIMENSION = 64
_VEC = "select vec_id, label, vec_id % 2 = 0 as member, embedding::double[] as e from embeddings"
_NORM = "select vec_id, label, member, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12)) as v from {vec}"
_STATS = """select vec_id, label, member, list_max(p) as confidence, peak + ln(mass) as energy, list_sort(p)[-1] - list_sort(p)[-2] as margin, list_sum(list_transform(p, lambda q: q * ln(greatest(q, 1e-12)))) as negative_entropy
    from (select *, list_transform(e, lambda x: exp(x - peak) / mass) as p from (select *, list_sum(list_transform(e, lambda x: exp(x - peak))) as mass from (select *, list_max(e) as peak from {src})))"""


def vectors(spark, sf):
    return table(spark, sf, "embeddings").withColumn("member", F.col("vec_id") % 2 == 0)


@query(
    "score_statistics",
    "select vec_id, round(confidence, 6) as confidence, round(energy, 6) as energy, round(margin, 6) as margin, round(negative_entropy, 6) as negative_entropy from {stats}",
    {"src": _VEC, "stats": _STATS},
)
def score_statistics(spark, sf):
    stats = M.score_statistics(vectors(spark, sf), "embedding")
    return rounded(stats.select("vec_id", "confidence", "energy", "margin", "negative_entropy"))


@query(
    "membership_auc",
    "select grp, round(auc, 6) as auc, round(greatest(auc, 1 - auc), 6) as symmetric_auc, round(2 * (greatest(auc, 1 - auc) - 0.5), 6) as advantage, members, others from {a}",
    {"a": duck_auc("grp", "membership_scores")},
)
def membership_auc(spark, sf):
    return rounded(M.roc_auc(table(spark, sf, "membership_scores"), ["grp"]))


_TPR = """select {by}, coalesce(max(cm / tm::double) filter (co <= 0.1 * t_o), 0.0) as tpr from (
    select *, sum(m) over (partition by {by} order by score desc rows unbounded preceding) as cm, sum(o) over (partition by {by} order by score desc rows unbounded preceding) as co,
      sum(m) over (partition by {by}) as tm, sum(o) over (partition by {by}) as t_o from (
      select {by}, score, count(*) filter (is_member) as m, count(*) filter (not is_member) as o from {source} group by {by}, score)) group by {by}"""


@query(
    "tpr_at_fixed_fpr",
    "select grp, round(tpr, 6) as tpr from {t}",
    {"t": _TPR.replace("{by}", "grp").replace("{source}", "{membership_scores}")},
)
def tpr_at_fixed_fpr(spark, sf):
    return rounded(M.tpr_at_fpr(table(spark, sf, "membership_scores"), ["grp"], 0.1))


_ATTACK = {
    "a": duck_auc("grp", "membership_scores"),
    "flipped": "select sample_id, grp, is_member, score * case when auc < 0.5 then -1 else 1 end as score from {membership_scores} join {a} using (grp)",
    "t": _TPR.replace("{by}", "grp").replace("{source}", "{flipped}"),
}


@query(
    "membership_attack",
    "select grp, round(auc, 6) as auc, round(greatest(auc, 1 - auc), 6) as symmetric_auc, round(2 * (greatest(auc, 1 - auc) - 0.5), 6) as advantage, members, others, round(tpr, 6) as tpr from {a} join {t} using (grp)",
    _ATTACK,
)
def membership_attack(spark, sf):
    return rounded(M.membership_attack(table(spark, sf, "membership_scores"), ["grp"], 0.1))


@query(
    "worst_case_attack",
    "select label, round(max(2 * (greatest(auc, 1 - auc) - 0.5)), 6) as worst_advantage from {a} group by label",
    {
        "src": _VEC,
        "stats": _STATS,
        "long": "select label, statistic, member as is_member, round(value, 7) as score from (unpivot {stats} on confidence, energy, margin, negative_entropy into name statistic value value)",
        "a": duck_auc("label, statistic", "long"),
    },
)
def worst_case_attack(spark, sf):
    stats = M.score_statistics(vectors(spark, sf), "embedding")
    long = stats.unpivot(["label", "member"], ["confidence", "energy", "margin", "negative_entropy"], "statistic", "score")
    scores = long.select("label", "statistic", F.col("member").alias("is_member"), F.round("score", 7).alias("score"))
    return rounded(M.worst_attack(M.roc_auc(scores, ["label", "statistic"]), ["label"]))


projection(
    "shadow_scores",
    """
    select shadow, o_orderkey as sample_id, (o_orderkey + shadow) % 2 = 0 as included,
      cast(o_totalprice as double) / 100000 + (o_orderkey * 7 + shadow * 13) % 29 / 10.0e0 + case when (o_orderkey + shadow) % 2 = 0 then 0.3e0 else 0e0 end as score
    from {orders} cross join (select 0 as shadow union all select 1 union all select 2 union all select 3 union all select 4 union all select 5 union all select 6 union all select 7) s
    """,
)


@query(
    "shadow_split",
    """select sample_id, count(*) filter (included) as n_in, count(*) filter (not included) as n_out,
         count(*) filter (included) > 0 and count(*) filter (not included) > 0 and (select count(distinct n) = 1 from (select count(*) filter (included) as n from {shadow_scores} group by sample_id)) as ok
       from {shadow_scores} group by sample_id""",
)
def shadow_split(spark, sf):
    return M.split_shadows(table(spark, sf, "shadow_scores"))


@query(
    "likelihood_ratio_scores",
    """select sample_id, round(-0.5 * (ln(2 * pi() * vi) + (score - mi) * (score - mi) / vi) + 0.5 * (ln(2 * pi() * vo) + (score - mo) * (score - mo) / vo), 5) as llr from (
       select sample_id, avg(score) filter (included) as mi, greatest(var_pop(score) filter (included), 1e-6) as vi, avg(score) filter (not included) as mo, greatest(var_pop(score) filter (not included), 1e-6) as vo from {shadow_scores} group by 1)
       join (select o_orderkey as sample_id, o_totalprice::double / 100000 + 1.3 as score from orders) using (sample_id)""",
)
def likelihood_ratio_scores(spark, sf):
    target = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("sample_id"), (F.col("o_totalprice") / 100000 + F.lit(1.3)).alias("score")
    )
    return rounded(M.lira(target, table(spark, sf, "shadow_scores")), 5)


@query(
    "nearest_member_scores",
    "select a.vec_id, round(max(list_dot_product(a.v, b.v)), 6) as cosine from {norm} a join {norm} b on b.member and a.vec_id <> b.vec_id group by a.vec_id",
    {"vec": _VEC, "norm": _NORM},
)
def nearest_member_scores(spark, sf):
    return rounded(M.nearest_member(vectors(spark, sf), "vec_id", "embedding", "member"))


@query(
    "normalized_vectors",
    "select vec_id, round(v[1], 6) as first, round(v[64], 6) as last, round(sqrt(list_dot_product(v, v)), 6) as length from {norm}",
    {"vec": _VEC, "norm": _NORM},
)
def normalized_vectors(spark, sf):
    from traceless.functions.vectors import dot

    unit = M.l2_normalize(vectors(spark, sf), "embedding")
    e = F.col("embedding")
    return rounded(unit.select("vec_id", F.element_at(e, 1).alias("first"), F.element_at(e, 64).alias("last"), F.sqrt(dot(e, e)).alias("length")))


@query(
    "identity_cohesion",
    "select a.vec_id, a.label, round(avg(list_dot_product(a.v, b.v)), 6) as cohesion from {norm} a join {norm} b on a.label = b.label and a.vec_id <> b.vec_id group by all",
    {"vec": _VEC, "norm": _NORM},
)
def identity_cohesion(spark, sf):
    return rounded(M.identity_cohesion(vectors(spark, sf), "label", "embedding", DIMENSION).select("vec_id", "label", "cohesion"))


def second_release(spark, sf):
    """A later release: members shrink, others swap component order."""
    e = doubles("embedding")
    moved = F.when(F.col("member"), F.transform(e, lambda x: x * 0.5)).otherwise(F.reverse(e))
    return vectors(spark, sf).withColumn("embedding", moved)


_SECOND = "select vec_id, label, member, case when member then list_transform(e, lambda x: x * 0.5) else list_reverse(e) end as e from {vec}"


@query(
    "linear_cka",
    """select round((select sum(c * c) from {xy}) / (sqrt((select sum(c * c) from {ll})) * sqrt((select sum(c * c) from {rr}))), 6) as cka""",
    {
        "vec": _VEC,
        "second": _SECOND,
        "la": "select vec_id, i, a.e[i] as x from {vec} a, range(1, 65) t(i)",
        "lb": "select vec_id, i, b.e[i] as x from {second} b, range(1, 65) t(i)",
        "ca": "select vec_id, i, x - avg(x) over (partition by i) as x from {la}",
        "cb": "select vec_id, i, x - avg(x) over (partition by i) as x from {lb}",
        "xy": "select a.i, b.i as j, sum(a.x * b.x) as c from {ca} a join {cb} b using (vec_id) group by all",
        "ll": "select a.i, b.i as j, sum(a.x * b.x) as c from {ca} a join {ca} b using (vec_id) group by all",
        "rr": "select a.i, b.i as j, sum(a.x * b.x) as c from {cb} a join {cb} b using (vec_id) group by all",
    },
)
def linear_cka(spark, sf):
    both = vectors(spark, sf).select("vec_id", F.col("embedding").alias("left")).join(
        second_release(spark, sf).select("vec_id", F.col("embedding").alias("right")), "vec_id"
    )
    return rounded(M.linear_cka(both, "left", "right", DIMENSION))


@query(
    "embedding_split_mse",
    "select member, round(avg(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) ** 2)) / 64), 6) as mse from {vec} a join (select vec_id, e from {second}) b using (vec_id) group by member",
    {"vec": _VEC, "second": _SECOND},
)
def embedding_split_mse(spark, sf):
    return rounded(M.split_mse(vectors(spark, sf), second_release(spark, sf), "vec_id", "embedding", "member"))


_CLASSES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def class_probabilities(spark, sf, shift: int):
    """Share of a customer's orders per status as class probabilities, over a partial class list."""
    k = F.col("c_custkey") + shift
    p = ((k % 10) / 20.0).cast("double")
    pairs = F.create_map(
        F.lit("BUILDING"), p, F.lit("MACHINERY"), 0.9 - p,
        F.when(k % 13 == 0, F.lit("UNLISTED")).otherwise(F.lit("HOUSEHOLD")), F.lit(0.1),
    )
    return table(spark, sf, "customer").select("c_custkey", pairs.alias("probabilities"))


_ALIGNED = """select c_custkey, [0.0, p, 0.0, case when (c_custkey + {s}) % 13 = 0 then 0.0 else 0.1 end, 0.9 - p]::double[] as vector, ((c_custkey + {s}) % 13 = 0)::int::bigint as unknown_classes
    from (select c_custkey, ((c_custkey + {s}) % 10) / 20.0::double as p from customer)"""


@query(
    "aligned_probabilities",
    "select c_custkey, unknown_classes, round(vector[2], 6) as building, round(vector[4], 6) as household, round(vector[5], 6) as machinery from {a}",
    {"a": _ALIGNED.replace("{s}", "0")},
)
def aligned_probabilities(spark, sf):
    aligned = M.align_probs(class_probabilities(spark, sf, 0), _CLASSES)
    v = F.col("vector")
    return rounded(aligned.select("c_custkey", "unknown_classes", F.element_at(v, 2).alias("building"), F.element_at(v, 4).alias("household"), F.element_at(v, 5).alias("machinery")))


@query(
    "mean_total_variation",
    "select round(avg(0.5 * list_sum(list_transform(list_zip(a.vector, b.vector), lambda p: abs(p[1] - p[2])))), 6) as mean_tv from {a} a join {b} b using (c_custkey)",
    {"a": _ALIGNED.replace("{s}", "0"), "b": _ALIGNED.replace("{s}", "3")},
)
def mean_total_variation(spark, sf):
    a = M.align_probs(class_probabilities(spark, sf, 0), _CLASSES)
    b = M.align_probs(class_probabilities(spark, sf, 3), _CLASSES)
    return rounded(M.mean_tv(a, b, "c_custkey", "vector"))


_PAIR_SEED, _PER_LABEL = 11, 40
_PAIRS = {
    "vec": _VEC,
    "norm": _NORM,
    "ordered": f"select *, row_number() over (partition by label order by {duck_draw(str(_PAIR_SEED), 'vec_id')}, vec_id) as pos from {{norm}}",
    "positive": "select a.v as x, b.v as y, true as is_member from {ordered} a join {ordered} b on a.label = b.label and b.pos = a.pos + 1",
    "wheel": f"select *, row_number() over (order by {duck_draw(str(_PAIR_SEED + 1), 'vec_id')}, vec_id) as pos, count(*) over () as n from {{norm}}",
    "negative": "select a.v as x, b.v as y, false as is_member from {wheel} a join {wheel} b on b.pos = a.pos % a.n + 1 where a.label <> b.label",
    "pairs": "select 0 as g, is_member, round(list_dot_product(x, y), 7) as score from (select * from {positive} union all select * from {negative})",
    "a": duck_auc("g", "pairs"),
    "t": _TPR.replace("{by}", "g").replace("{source}", "{pairs}"),
}


def verification_pairs(spark, sf):
    unit = M.l2_normalize(vectors(spark, sf), "embedding")
    return W.verification_pairs(unit, "vec_id", "label", "embedding", _PAIR_SEED)


@query(
    "verification_metrics",
    "select round(auc, 6) as auc, round(tpr, 6) as tar_at_far, members as positive_pairs, others as negative_pairs from {a} join {t} using (g)",
    _PAIRS,
)
def verification_metrics(spark, sf):
    pairs = verification_pairs(spark, sf).withColumn("g", F.lit(0)).withColumn("score", F.round("score", 7))
    auc = M.roc_auc(pairs, ["g"]).select("g", "auc", F.col("members").alias("positive_pairs"), F.col("others").alias("negative_pairs"))
    tpr = M.tpr_at_fpr(pairs, ["g"], 0.1).withColumnRenamed("tpr", "tar_at_far")
    return rounded(auc.join(tpr, "g").drop("g"))


def _duck_wide(*parts: str) -> str:
    high, middle, low = (duck_draw(*parts, str(n)) for n in (0, 1, 2))
    return f"({high} * 1000000000000 + {middle} * 1000000 + {low})"


_SAMPLED = {
    "vec": _VEC,
    "norm": _NORM,
    "ordered": f"select *, row_number() over (partition by label order by {duck_draw('9', 'vec_id')}, vec_id) as pos from {{norm}} where label is not null",
    "wheel": f"select *, row_number() over (order by {duck_draw('10', 'vec_id')}, vec_id) as pos from {{norm}} where label is not null",
    "sizes": "select label, n, n * (n - 1) // 2 as pairs, sum(n * (n - 1) // 2) over (order by label) as until from (select label, count(*) as n from {ordered} group by label)",
    "total": "select sum(pairs)::bigint as p, sum(n)::bigint as vectors, least(200, sum(pairs))::bigint as wanted from {sizes}",
    "ranks": f"""select rank from (select {_duck_wide('9', 'i')} % p as rank, min(i) as first from {{total}}, (select unnest(range(0, 1600)) as i) where 2 * wanted < p group by 1 order by first limit 200)
        union all select rank from (select i as rank from {{total}}, (select unnest(range(0, 400)) as i) where i < p and 2 * wanted >= p order by {_duck_wide('9', 'i')}, i limit 200)""",
    "places": """select label, rank - (until - pairs) as r, floor((1 + sqrt(1 + 8 * (rank - (until - pairs)))) / 2)::bigint as j from {ranks} join {sizes} on rank >= until - pairs and rank < until""",
    "same": """select a.vec_id as left_id, b.vec_id as right_id, list_dot_product(a.v, b.v) as score, true as is_member from {places} s
        join {ordered} a on a.label = s.label and a.pos = r - j * (j - 1) // 2 + 1 join {ordered} b on b.label = s.label and b.pos = j + 1""",
    "other": f"""select left_id, right_id, score, false as is_member from (
        select a.vec_id as left_id, b.vec_id as right_id, list_dot_product(a.v, b.v) as score, wanted, row_number() over (order by i) as place
        from (select i, wanted, {_duck_wide('10', 'i')} % vectors + 1 as x, {_duck_wide('11', 'i')} % vectors + 1 as y from {{total}}, (select unnest(range(0, 3000)) as i))
        join {{wheel}} a on a.pos = x join {{wheel}} b on b.pos = y where a.label <> b.label) where place <= wanted""",
    "sampled": "select * from {same} union all select * from {other}",
    "pairs": "select 0 as g, is_member, round(score, 7) as score from {sampled}",
    "a": duck_auc("g", "pairs"),
    "t": _TPR.replace("{by}", "g").replace("{source}", "{pairs}"),
}


@query("sampled_similarity_pairs", "select left_id, right_id, round(score, 6) as score, is_member from {sampled}", _SAMPLED)
def sampled_similarity_pairs(spark, sf):
    unit = M.l2_normalize(vectors(spark, sf), "embedding")
    return rounded(W.sample_pairs(unit, "vec_id", "label", "embedding", 200, 9))


@query(
    "sampled_pair_metrics",
    "select round(auc, 6) as auc, round(tpr, 6) as tar_at_far, members as positive_pairs, others as negative_pairs from {a} join {t} using (g)",
    _SAMPLED,
)
def sampled_pair_metrics(spark, sf):
    unit = M.l2_normalize(vectors(spark, sf), "embedding")
    pairs = W.sample_pairs(unit, "vec_id", "label", "embedding", 200, 9)
    return rounded(M.pair_metrics(pairs.withColumn("score", F.round("score", 7)), 0.1))


@query(
    "release_difference_attack",
    "select statistic, round(auc, 6) as auc, round(2 * (greatest(auc, 1 - auc) - 0.5), 6) as advantage from {a}",
    {
        "vec": _VEC,
        "src": "select * from {vec}",
        "stats": _STATS,
        "second": _SECOND,
        "stats2": _STATS.replace("{src}", "{second}"),
        "u1": "unpivot {stats} on confidence, energy, margin, negative_entropy into name statistic value value",
        "u2": "unpivot {stats2} on confidence, energy, margin, negative_entropy into name statistic value value",
        "long": "select statistic, a.member as is_member, round(abs(a.value - b.value), 9) as score from {u1} a join {u2} b using (vec_id, statistic)",
        "a": duck_auc("statistic", "long"),
    },
)
def release_difference_attack(spark, sf):
    return rounded(M.release_difference(vectors(spark, sf), second_release(spark, sf), "vec_id", "embedding", "member"))


@query(
    "prediction_comparison",
    """select round(avg((stale = truth)::int) filter (truth <> 'HOUSEHOLD'), 6) as stale_retained_accuracy, round(avg((exact = truth)::int) filter (truth <> 'HOUSEHOLD'), 6) as exact_retained_accuracy,
         round(avg((stale <> exact)::int) filter (truth <> 'HOUSEHOLD'), 6) as retained_disagreement, round(avg(coalesce(ps, 0)) filter (truth = 'HOUSEHOLD'), 6) as stale_forgotten_probability, 0.0::double as exact_forgotten_probability
       from (select c_mktsegment as truth, case when c_custkey % 10 = 3 then 'BUILDING' else c_mktsegment end as stale, case when c_custkey % 7 = 3 then 'MACHINERY' else c_mktsegment end as exact,
         case when c_custkey % 11 <> 4 then (c_custkey % 100) / 100.0 end as ps from customer)""",
)
def prediction_comparison(spark, sf):
    k = F.col("c_custkey")
    base = table(spark, sf, "customer").select(k.alias("sample_id"), "c_mktsegment", k)
    truth = base.select("sample_id", F.col("c_mktsegment").alias("truth"))
    stale = base.select(
        "sample_id", F.when(k % 10 == 3, "BUILDING").otherwise(F.col("c_mktsegment")).alias("label"),
        F.when(k % 11 != 4, (k % 100) / 100.0).alias("p_forgotten"),
    )
    exact = base.select(
        "sample_id", F.when(k % 7 == 3, "MACHINERY").otherwise(F.col("c_mktsegment")).alias("label"), F.lit(None).cast("double").alias("p_forgotten")
    )
    return rounded(M.compare_predictions(stale, exact, truth, "HOUSEHOLD"))


_RIDGE = {
    "vec": _VEC,
    "z": "select vec_id, label, list_concat([1.0], e, [label::double]) as z from {vec}",
    "cells": "select vec_id, label, i, z[i + 1] as x from {z}, range(0, 66) t(i)",
}


@query(
    "ridge_downdate",
    "select a.i::int as i, b.i::int as j, round(sum(a.x * b.x), 5) + 0.0 as value from {cells} a join {cells} b using (vec_id) where a.label <> 3 group by a.i, b.i",
    _RIDGE,
)
def ridge_downdate(spark, sf):
    every = M.ridge_stats(vectors(spark, sf), "embedding", "label")
    gone = M.ridge_stats(vectors(spark, sf).where("label = 3"), "embedding", "label")
    return rounded(M.downdate(every, gone), 5)


@query(
    "ridge_rebuild_delta",
    """select max(abs(every - gone - rebuilt)) < 1e-6 as equal_within_tolerance from (select a.i, b.i as j, sum(a.x * b.x) as every,
         coalesce(sum(a.x * b.x) filter (a.label = 3), 0) as gone, coalesce(sum(a.x * b.x) filter (a.label <> 3), 0) as rebuilt from {cells} a join {cells} b using (vec_id) group by all)""",
    _RIDGE,
)
def ridge_rebuild_delta(spark, sf):
    every = M.ridge_stats(vectors(spark, sf), "embedding", "label")
    gone = M.ridge_stats(vectors(spark, sf).where("label = 3"), "embedding", "label")
    rebuilt = M.ridge_stats(vectors(spark, sf).where("label <> 3"), "embedding", "label")
    delta = M.stats_delta(M.downdate(every, gone), rebuilt)
    return delta.select((F.col("max_delta") < 1e-6).alias("equal_within_tolerance"))
