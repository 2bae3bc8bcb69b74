"""Deterministic samples, blocks, folds and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceless.operators import sampling as W
from traceless.plans import lineage_tables, trial_tables  # noqa: F401
from traceless.plans.catalog import table
from traceless.queries.outcome_queries import duck_draw, rounded
from traceless.queries.registry import query


@query(
    "cheapest_supplier_per_part",
    "select l_partkey, l_suppkey, l_extendedprice from (select *, row_number() over (partition by l_partkey order by l_extendedprice, l_suppkey) as rn from lineitem) where rn = 1",
)
def cheapest_supplier_per_part(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice")
    return W.top1(lines, ["l_partkey"], ["l_extendedprice", "l_suppkey"])


_RUNS = {
    "marked": "select *, sum((not feasible)::int) over (partition by path_id order by alpha rows unbounded preceding) as island, row_number() over (partition by path_id order by alpha) as place from {path_points}",
    "intervals": """select path_id, island::bigint as island, count(*) as width, min(alpha) as first_alpha, max(alpha) as last_alpha, min(place) as first_place, min(minimum_margin) as margin, max(worst_exact_gap) as gap, min(minimum_speedup) as speedup
        from {marked} where feasible group by path_id, island having count(*) >= 2""",
}


@query(
    "robust_intervals",
    "select path_id, width, first_alpha, last_alpha, first_place, round(margin, 6) as margin, round(gap, 6) as gap, speedup::double as speedup from {intervals}",
    _RUNS,
)
def robust_intervals(spark, sf):
    out = rounded(W.robust_intervals(table(spark, sf, "path_points"), 2)).drop("island")
    return out.withColumn("speedup", F.col("speedup").cast("double"))


@query(
    "robust_point",
    """select p.path_id, p.alpha, b.width from {marked} p join (select * from {intervals} order by width desc, margin desc, gap, speedup desc, path_id, first_alpha limit 1) b
       on b.path_id = p.path_id and p.place = b.first_place + (b.width - 1) // 2""",
    _RUNS,
)
def robust_point(spark, sf):
    return W.select_robust_point(table(spark, sf, "path_points"), 2).select("path_id", "alpha", "width")


@query(
    "document_blocks",
    """select block, count(*) as rows, 'sha256:' || sha256(string_agg(fp, ',' order by doc_id)) as commitment from (
         select doc_id, sha256(text) as fp, (row_number() over (order by doc_id) - 1) // 20 as block from documents) group by block""",
)
def document_blocks(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("fp"))
    return W.partition_blocks(rows, ["doc_id"], "fp", 20)


@query("duplicate_documents", "select sha256(text) as fp, count(*) as copies from documents group by 1 having count(*) > 1")
def duplicate_documents(spark, sf):
    return W.duplicate_rows(table(spark, sf, "documents").select(F.sha2("text", 256).alias("fp")), "fp")


_RANKED = f"select vec_id, label, row_number() over (partition by label order by {duck_draw('5', 'vec_id')}, vec_id) as pos, count(*) over (partition by label) as n from embeddings"


@query("subject_split_count", "select vec_id, label, pos <= 4 as is_test from {r}", {"r": _RANKED})
def subject_split_count(spark, sf):
    return W.subject_split(table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id", 5, n=4)


@query("subject_split_fraction", "select vec_id, label, pos <= greatest(1, round_even(n * 0.25, 0)) as is_test from {r}", {"r": _RANKED})
def subject_split_fraction(spark, sf):
    return W.subject_split(table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id", 5, fraction=0.25)


@query(
    "third_order_per_customer",
    "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn from orders) where rn = 3",
)
def third_order_per_customer(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return W.nth_per_group(orders, "o_custkey", ["o_orderdate", "o_orderkey"], 2).select("o_custkey", "o_orderkey")


@query(
    "hash_sampled_customers",
    "select o_custkey, count(*) as rows, sha256('deletion-sample:' || o_custkey) as digest from orders group by o_custkey having count(*) >= 8 order by digest limit 12",
)
def hash_sampled_customers(spark, sf):
    return W.hash_sample_groups(table(spark, sf, "orders"), "o_custkey", 8, 12, "deletion-sample:")


@query(
    "balanced_shadow_membership",
    f"""select vec_id, shadow::int as shadow, row_number() over (partition by vec_id order by {duck_draw('3', 'vec_id', 'shadow')}, shadow) <= 4 as included
        from embeddings, (select unnest(range(0, 8)) as shadow)""",
)
def balanced_shadow_membership(spark, sf):
    return W.balanced_membership(table(spark, sf, "embeddings"), "vec_id", 8, 4, 3)


@query(
    "order_set_operations",
    """select (select count(*) from (select o_custkey from {a} union select o_custkey from {b})) as union_size, (select count(*) from (select o_custkey from {a} intersect select o_custkey from {b})) as intersection_size,
         (select count(*) from (select o_custkey from {a} union select o_custkey from {b})) - (select count(*) from (select o_custkey from {a} intersect select o_custkey from {b})) as difference_size""",
    {"a": "select o_custkey from orders where o_orderstatus = 'F'", "b": "select o_custkey from orders where o_orderstatus = 'P'"},
)
def order_set_operations(spark, sf):
    orders = table(spark, sf, "orders")
    return W.set_counts(orders.where("o_orderstatus = 'F'").select("o_custkey"), orders.where("o_orderstatus = 'P'").select("o_custkey"))


@query(
    "segment_symmetric_difference",
    """select *, 'left' as side from (select n_name, c_mktsegment from {a} except all select n_name, c_mktsegment from {b})
       union all select *, 'right' from (select n_name, c_mktsegment from {b} except all select n_name, c_mktsegment from {a})""",
    {
        "a": "select n_name, c_mktsegment from customer join nation on n_nationkey = c_nationkey where c_acctbal > 4000",
        "b": "select n_name, c_mktsegment from customer join nation on n_nationkey = c_nationkey where c_custkey % 2 = 0",
    },
)
def segment_symmetric_difference(spark, sf):
    joined = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return W.symmetric_difference(
        joined.where("c_acctbal > 4000").select("n_name", "c_mktsegment"), joined.where("c_custkey % 2 = 0").select("n_name", "c_mktsegment")
    )


_FOLDS = {
    "blocked": "select doc_id, sha256(text) as fp, (row_number() over (order by doc_id) - 1) // 20 as block from documents",
    "folded": "select doc_id, fp, case when block % 4 = 0 then 'development' when block % 4 = 1 then 'confirmation' else 'reserved' end as fold from {blocked}",
}


def folded(spark, sf):
    from traceless.operators.ranking import group_rank

    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("fp"), F.lit(0).alias("all"))
    rows = group_rank(docs, ["all"], ["doc_id"], "position").withColumn("block", F.floor((F.col("position") - 1) / 20))
    fold = F.when(F.col("block") % 4 == 0, "development").when(F.col("block") % 4 == 1, "confirmation")
    assignment = rows.select("block").distinct().withColumn("fold", fold).where(F.col("fold").isNotNull())
    return W.assemble_folds(rows, assignment, "block").select("doc_id", "fp", "fold")


@query("fold_assembly", "select * from {folded}", _FOLDS)
def fold_assembly(spark, sf):
    return folded(spark, sf)


@query("fold_overlap", "select fp, count(distinct fold) as folds from {folded} group by fp having count(distinct fold) > 1", _FOLDS)
def fold_overlap(spark, sf):
    return W.fold_overlap(folded(spark, sf), "fp")


@query(
    "even_sample_of_orders",
    """select o_orderkey from (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as pos, count(*) over () as n from orders)
       where pos in (select floor(i * (select count(*) from orders) / 97.0)::bigint from (select unnest(range(0, 97)) as i))""",
)
def even_sample_of_orders(spark, sf):
    return W.even_sample(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 97).select("o_orderkey")


@query(
    "reserved_exclusion",
    "select doc_id from documents where text not in (select text from documents where source = (select min(source) from documents))",
)
def reserved_exclusion(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    first = docs.agg(F.min("source").alias("source"))
    reserved = docs.join(F.broadcast(first), "source", "left_semi").select("text")
    return W.exclude_reserved(docs.select("doc_id", "text"), reserved, ["text"]).select("doc_id")


@query(
    "perturbation_rows",
    """select conv_id, len(list_filter(parts, lambda x: true)) = 3 as count_ok, v.kind, v.position::int as position, sha256(v.text) as text_hash from (
         select conv_id, first_text, last_text, parts, unnest(list_concat([struct_pack(kind := 'direct', position := 0, text := first_text), struct_pack(kind := 'paraphrase', position := 0, text := last_text)],
           list_transform(parts, lambda x, i: struct_pack(kind := 'perturbed', position := (i - 1)::int, text := x)))) as v
         from (select conv_id, arg_min(text, turn) as first_text, arg_max(text, turn) as last_text, coalesce(list(text order by turn) filter (role = 'assistant'), []) as parts from conversations group by conv_id))""",
)
def perturbation_rows(spark, sf):
    turns = table(spark, sf, "conversations")
    spoken = F.when(F.col("role") == "assistant", F.struct("turn", "text"))
    grouped = turns.groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("first_text"),
        F.max_by("text", "turn").alias("last_text"),
        F.array_sort(F.collect_list(spoken)).alias("parts"),
    ).withColumn("parts", F.col("parts.text"))
    rows = W.expand_perturbations(grouped, ["conv_id"], "first_text", "last_text", "parts", 3)
    return rows.select("conv_id", "count_ok", "kind", "position", F.sha2("text", 256).alias("text_hash"))
