"""Mixing sources to target weights with a low-discrepancy slot schedule, in DataFrame functions only.

Every source gets a target number of words.  Its documents, in hash order, form
a stream that is cut into blocks of ``BLOCK_WORDS`` words; a slot of the
schedule takes the next block of its source, and the last slot only the words
that are still due.  Slot ``i`` stands at the van der Corput point of ``i`` (its
bits reversed), and the cumulative slot quotas map that point to a source, so
every stretch of the schedule holds the sources in their proportions.  Reversing
bits is its own inverse: slots are made per source, piece by piece, without a
range join.

Defined cases: a null text has no words; a null source is a source of its own,
last in order; documents without words are returned with ``taken`` 0; an empty
table gives no rows.  Repeated rows are documents of their own.  Equal hashes are
ordered by ``doc_id`` and size, so reruns agree.  Long texts are counted whole and
span as many blocks as they fill.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceless.llm.shared import WORD, column_or_null, maybe_broadcast, text_of
from traceless.operators.ranking import group_rank, running_sum
from traceless.plans.workspace import Stored

WEIGHTS = (3, 1, 2)
BLOCK_WORDS = 256
#: Slots that one row generates at a time.
PIECE = 4096
SEED = 11


def word_count(text: str | Column = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def targets(
    sizes: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple[int, ...] = WEIGHTS
) -> Stored:
    """``source, source_index, source_size, target`` per source.

    Sources share ``share`` times all sizes by weight.  What would lie above
    ``limit`` times a source's size is shared again by the others; a source that
    reached its limit stays there, because the level only rises.
    """
    summed = Stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = group_rank(summed.df, [], [F.col("source").asc_nulls_last()], "source_index")
    nth = F.pmod(F.col("source_index") - 1, F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth + 1)
    sources = Stored(ranked.withColumn("weight", weight), "ranked-sources")
    cap = F.col("source_size") * F.lit(limit)
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > cap
        row = sources.df.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(above, cap)).alias("held"),
            F.sum(F.when(~above, F.col("weight"))).alias("open"),
            F.count_if(above).alias("n"),
        ).first()
        if row.n == capped or not row.open:
            break
        capped, level = row.n, (share * row.total - (row.held or 0.0)) / row.open
    target = F.least(cap, F.col("weight") * F.lit(level))
    return Stored(sources.df.withColumn("target", target).drop("weight"), "targets")


def _plan(sources: DataFrame, block_words: int) -> DataFrame:
    """Blocks, slot quota and the words of the last slot per source; sources without words go."""
    size, due = F.col("source_size"), F.floor("target").cast("long")
    with_due = sources.where("source_size > 0").withColumn("due", due)
    blocks = F.ceil(size / F.lit(block_words)).cast("long")
    rest = F.col("due") % size
    rest_slots = F.ceil(rest / F.lit(block_words)).cast("long")
    return with_due.select(
        "source_index",
        blocks.alias("blocks"),
        (F.floor(F.col("due") / size).cast("long") * blocks + rest_slots).alias("quota"),
        F.when(rest > 0, rest - (rest_slots - 1) * block_words).alias("last_words"),
    ).where("quota > 0")


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``slot, source_index, block, epoch, limit``: the words ``[0, limit)`` of a block are taken.

    Sorted by ``slot``, any stretch mixes the sources in their proportions.
    """
    plan = Stored(_plan(sources, block_words), "slot-plan")
    total = plan.df.agg(F.sum("quota")).first()[0] or 0
    bits = max(1, math.ceil(math.log2(max(1, total)))) + 1
    points = 1 << bits
    ends = running_sum(plan.df, [], ["source_index"], {"upto": "quota"})

    def point(quota: Column) -> Column:
        exact = quota.cast("decimal(20,0)") * F.lit(points).cast("decimal(18,0)") / F.lit(max(1, total)).cast("decimal(18,0)")
        return F.ceil(exact).cast("long")

    spans = ends.withColumn("low", point(F.col("upto") - F.col("quota"))).withColumn(
        "high", point(F.col("upto"))
    )
    # the first quota slots of a source lie below this slot: counts of bit-reversed points
    # differ from their share by one for each bit at most
    width = F.col("high") - F.col("low")
    below = F.ceil((F.col("quota") + bits + 1) * F.lit(float(points)) / width)
    starts = F.explode(F.sequence("low", F.col("high") - 1, F.lit(PIECE).cast("long")))
    pieces = spans.withColumn("below", below).select("*", starts.alias("first")).repartition(
        "source_index", "first"
    )
    upto = F.least(F.col("first") + PIECE, F.col("high")) - 1
    made = pieces.select("*", F.explode(F.sequence("first", upto)).alias("point"))
    reverse = F.conv(F.reverse(F.lpad(F.bin("point"), bits, "0")), 2, 10).cast("long")
    slots = made.withColumn("slot", reverse).where(F.col("slot") < F.col("below"))
    kept = Stored(slots.select("slot", "source_index", "blocks", "quota", "last_words"), "slots")
    ranked = group_rank(kept.df, ["source_index"], ["slot"], "nth").where("nth <= quota")
    is_last = F.col("nth") == F.col("quota")
    return ranked.select(
        "slot",
        "source_index",
        ((F.col("nth") - 1) % F.col("blocks")).alias("block"),
        F.floor((F.col("nth") - 1) / F.col("blocks")).cast("long").alias("epoch"),
        F.coalesce(F.when(is_last, F.col("last_words")), F.lit(block_words)).cast("long").alias("limit"),
    )


def mix(
    docs: DataFrame,
    share: float = 1.5,
    limit: float = 2.0,
    weights: tuple[int, ...] = WEIGHTS,
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
    id_column: str = "doc_id",
    draw_by: tuple[str, ...] = (),
) -> DataFrame:
    """``id_column, size, source_size, target, taken, slots`` of every document.

    A source's documents come in the order of a hash of ``draw_by`` (else of the id), so
    neither files nor partitions matter.  ``slots`` are the schedule's slots at which the
    document is taken, one for each time; empty where it is not.
    """
    source = column_or_null(docs, "source", "string").alias("source")
    draw = F.xxhash64(F.lit(seed), *[F.col(c) for c in draw_by or (id_column,)]).alias("draw")
    sizes = Stored(docs.select(F.col(id_column).alias("id"), draw, source, word_count().alias("size")), "sizes")
    sources = targets(sizes.df, share, limit, weights)
    named = maybe_broadcast(sources).withColumnRenamed("source", "named")
    rows = sizes.df.join(named, F.col("source").eqNullSafe(F.col("named"))).select(
        "id", "draw", "size", "source_index", "source_size", "target"
    )
    order = ["draw", "id", "size"]
    filled = Stored(rows.where("size > 0"), "filled")
    placed = running_sum(filled.df, ["source_index"], order, {"stop": "size"})
    start = F.col("stop") - F.col("size")
    touched = F.sequence(
        F.floor(start / block_words).cast("long"), F.floor((F.col("stop") - 1) / block_words).cast("long")
    )
    pieces = placed.withColumn("start", start).select("*", F.explode(touched).alias("block"))
    taken_blocks = (
        schedule(sources.df, block_words)
        .groupBy("source_index", "block")
        # one per epoch, so three at most
        .agg(F.sort_array(F.collect_list(F.struct("epoch", "slot", "limit"))).alias("turns"))
    )
    offset = F.col("block") * block_words
    begin = F.greatest(F.col("start") - offset, F.lit(0).cast("long"))
    end = F.col("stop") - offset
    words = F.aggregate(
        "turns",
        F.lit(0).cast("long"),
        lambda acc, turn: acc + F.greatest(F.least(end, turn["limit"]) - begin, F.lit(0).cast("long")),
    )
    # slots of a source rise with its blocks, so a document starts where its first block does
    met = F.filter("turns", lambda turn: turn["limit"] > begin)
    first_block = F.col("block") == F.floor(F.col("start") / block_words)
    at = F.when(first_block, F.transform(met, lambda turn: turn["slot"]))
    joined = pieces.join(taken_blocks, ["source_index", "block"], "left")
    keys = ["source_index", "start", "id", "size", "source_size", "target"]
    none = F.array().cast("array<bigint>")
    mixed = joined.groupBy(*keys).agg(
        F.coalesce(F.sum(words), F.lit(0)).alias("taken"), F.coalesce(F.max(at), none).alias("slots")
    )
    blank = rows.where("size = 0").withColumns({"taken": F.lit(0).cast("long"), "slots": none})
    columns = [F.col("id").alias(id_column), "size", "source_size", "target", "taken", "slots"]
    return mixed.select(*columns).unionByName(blank.select(*columns))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as the mix takes them, all columns as they are, in slot order.

    Rows are sorted by the slot at which each time begins, in ranges over the partitions,
    so a stretch of the result holds the sources in their proportions.  The one document
    of a source where the mix ends comes with the words that are still taken, joined by
    single spaces, and with its own ``n_chars``.
    """
    row = "__row"
    while row in docs.columns:
        row += "_"
    numbered = Stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    hashed = [f.name for f in docs.schema if "map" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    drawn = mix(numbered.df, id_column=row, draw_by=tuple(hashed), **options)
    counts = Stored(drawn.select(row, "size", "taken", "slots").where("taken > 0"), "taken")
    size, taken, slots, nth, slot, words = (f"{row}_{c}" for c in ("size", "taken", "slots", "nth", "slot", "words"))
    counted = maybe_broadcast(counts).toDF(row, size, taken, slots)
    rows = numbered.df.join(counted, row).select("*", F.posexplode(slots).alias(nth, slot))
    left = F.col(taken) - F.col(nth) * F.col(size)
    some = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), left.cast("int"))
    rows = rows.withColumn(words, F.when(left < F.col(size), F.array_join(some, " ")))
    replaced = {"text": F.coalesce(F.col(words), F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        replaced["n_chars"] = F.coalesce(F.length(words).cast(kind), F.col("n_chars"))
    order = [slot, *(c for c in ("doc_id",) if c in docs.columns)]
    ordered = rows.withColumns(replaced).repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select(*docs.columns)
