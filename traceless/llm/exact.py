"""Exact dedup with an extendible-hash index on shared files.

Every text has a 64-bit key.  The directory holds buckets, each a prefix of the
key space; a bucket with more distinct keys than its capacity is split by one
more bit, which doubles the directory where its depth is reached.  A bucket is
a key range with one owner, so no two tasks decide about one key: rows look their
bucket up and go to its owner.  Within a key the different texts form a chain:
whole texts are compared, not their digests.

Copies never crowd a bucket, because they share one key and are combined before
they go to the owner; a key of very many copies is combined in shards first.  Very
long texts are cells of a row, up to Spark's 2 GB.  Results of defined cases: a null
text is the empty text; rows that repeat both text and ``doc_id`` count each, but one
of them stays (the least by all columns as JSON, where the others differ); a null
``doc_id`` counts as larger than any other; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceless.llm.shared import SPACE, attach, maybe_broadcast, text_of
from traceless.plans.workspace import Stored, union_stored

#: Distinct keys a bucket holds before it is split.
CAPACITY = 16_384
KEY_BITS = 64
#: Copies of one key that are combined in one shard, and the most shards of a key.
SHARD_ROWS = 1024
MAX_SHARDS = 64


def normalised(text: str | Column = "text") -> Column:
    """The text with every run of white space replaced by one space."""
    return F.regexp_replace(text_of(text), SPACE, " ")


def prefix(key: str, depth: int) -> Column:
    """The first ``depth`` bits of the key."""
    if depth == 0:
        return F.lit(0).cast("long")
    return F.shiftrightunsigned(F.col(key), KEY_BITS - depth)


@dataclass
class ExtendibleIndex:
    """Buckets ``(depth, prefix, n_keys)``, rows ``entries`` and ``chains`` of equal texts.

    A chain row is one text of a bucket: ``link`` is its place among the different
    texts of its key, 1 unless keys collide.
    """

    directory: DataFrame
    entries: Stored
    chains: Stored


def build_directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Split buckets of distinct ``key`` values until each holds ``capacity`` at most."""
    total = keys.count()
    depth = max(0, math.ceil(math.log2(max(1, total / capacity))) - 1)
    full, rounds = keys, []
    while True:
        fill = full.groupBy(prefix("key", depth).alias("prefix")).agg(
            F.count(F.lit(1)).alias("n_keys")
        )
        rounds.append(Stored(fill.select(F.lit(depth).alias("depth"), "prefix", "n_keys"), "fill"))
        over = rounds[-1].df.where(F.col("n_keys") > capacity).select("prefix")
        if depth == KEY_BITS or over.isEmpty():
            break
        full = full.withColumn("prefix", prefix("key", depth)).join(over, "prefix", "left_semi")
        full, depth = full.select("key"), depth + 1
    leaf = (F.col("n_keys") <= capacity) | (F.col("depth") == KEY_BITS)
    return union_stored(rounds).where(leaf)


def bucket_of(directory: DataFrame) -> Column:
    """Name of the key's bucket: its depth and prefix, found at the directory's own depths."""
    depths = sorted(row.depth for row in directory.select("depth").distinct().collect())
    tests = [
        F.struct(F.lit(d).alias("depth"), prefix("key", d).alias("prefix")) for d in depths
    ]
    return F.array(*tests) if tests else F.array(F.struct(F.lit(0).alias("depth"), prefix("key", 0).alias("prefix")))


def placed(keys: DataFrame, directory: Stored) -> DataFrame:
    """The keys with the bucket that holds them: ``depth`` and ``prefix`` as in the directory."""
    slots = keys.select("*", F.explode(bucket_of(directory.df)).alias("slot"))
    slots = slots.select("*", "slot.depth", "slot.prefix").drop("slot")
    return slots.join(maybe_broadcast(directory).drop("n_keys"), ["depth", "prefix"])


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> ExtendibleIndex:
    """Index of all documents; chains exist for keys that more than one row has.

    Keys look up their bucket first.  Copies are combined in shards of about
    ``SHARD_ROWS`` rows, so an owner gets at most ``MAX_SHARDS`` rows of any text; then
    rows move to the task that owns their bucket, which compares whole texts and chains
    those that differ.
    """
    texts = docs.select("doc_id", normalised().alias("norm"))
    entries = Stored(
        texts.select(
            "doc_id", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("text_sha256")
        ),
        "entries",
    )
    counted = Stored(entries.df.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows")), "keys")
    directory = Stored(build_directory(counted.df.select("key"), capacity), "directory")
    shared_keys = Stored(placed(counted.df.where(F.col("n_rows") > 1), directory), "shared-keys")
    rows = texts.withColumn("key", F.xxhash64("norm")).join(maybe_broadcast(shared_keys), "key")
    shards = F.least(F.ceil(F.col("n_rows") / SHARD_ROWS), F.lit(MAX_SHARDS))
    bucket, text = ["depth", "prefix"], ["key", "norm"]
    shard = F.pmod(F.xxhash64("doc_id"), shards).alias("shard")
    combined = rows.groupBy(*bucket, *text, shard).agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")
    )
    owned = combined.repartition(*bucket).groupBy(*bucket, *text).agg(
        F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size")
    )
    in_chain = Window.partitionBy(*bucket, "key").orderBy("norm")
    chain = Stored(
        owned.select(
            *bucket,
            "key",
            F.row_number().over(in_chain).alias("link"),
            F.sha2("norm", 256).alias("text_sha256"),
            "keep_id",
            "group_size",
        ),
        "chain",
    )
    # rows of a chain that repeat their doc_id, too: one of them stays
    member = entries.df.join(maybe_broadcast(Stored(shared_keys.df.select("key"), "shared")), "key", "left_semi")
    again = member.groupBy(
        F.col("key").alias("again_key"), F.col("text_sha256").alias("again_sha"), F.col("doc_id").alias("again_id")
    ).agg(F.count(F.lit(1)).alias("m"))
    repeated = Stored(again.where("m > 1"), "repeated")
    same_row = (F.col("key") == F.col("again_key")) & (F.col("text_sha256") == F.col("again_sha"))
    same_row &= F.col("keep_id").eqNullSafe(F.col("again_id"))
    chains = chain.df.join(maybe_broadcast(repeated), same_row, "left").select(
        *chain.schema.names, F.coalesce("m", F.lit(1)).cast("long").alias("m_keep")
    )
    return ExtendibleIndex(directory.df, entries, Stored(chains, "chains"))


def group_rows(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per document: ``doc_id keep_id group_size kept text_sha256``."""
    index = build_index(docs, capacity)
    keys = ["key", "text_sha256"]
    twins = index.chains.df.groupBy(*keys).count().where("count > 1")
    if not twins.isEmpty():
        raise ValueError("two different texts share key and SHA-256; their rows can't be told apart")
    rows = index.entries
    single = rows.df.join(maybe_broadcast(Stored(index.chains.df.select("key"), "chained")), "key", "left_anti")
    alone = single.select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    grouped = attach(rows, index.chains, keys, "group_size")
    is_first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    result = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    plain = grouped.where(~is_first | (F.col("m_keep") == 1)).withColumn("kept", is_first)
    repeated = index.chains.df.where(F.col("m_keep") > 1)
    ranks = F.explode(F.sequence(F.lit(1).cast("long"), "m_keep")).alias("nth")
    repeated = repeated.select("*", ranks).select(
        F.col("keep_id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("nth") == 1).alias("kept"),
        "text_sha256",
    )
    return alone.unionByName(plain.select(*result)).unionByName(repeated)


def keep_first(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The documents with one row for each different text, all columns as they are."""
    chains = build_index(docs, capacity).chains
    mark = "__text_key"
    while mark in docs.columns:
        mark += "_"
    named = {c: f"{mark}_{c}" for c in ("text_sha256", "keep_id", "m_keep")}
    groups = chains.df.select(*[F.col(c).alias(n) for c, n in named.items()])
    sha, keep, ties = named.values()
    groups = Stored(groups, "groups")
    marked = docs.withColumn(sha, F.sha2(normalised(docs["text"]), 256))
    single = marked.join(maybe_broadcast(groups), sha, "left_anti")
    first = marked.join(maybe_broadcast(groups), sha).where(
        marked["doc_id"].eqNullSafe(F.col(keep))
    )
    once = first.where(F.col(ties) == 1)
    # rows that share id and text may differ elsewhere: the least by all columns stays
    whole = F.struct(*[marked[c] for c in docs.columns])
    tied = first.where(F.col(ties) > 1).groupBy(sha).agg(F.min_by(whole, F.to_json(whole)).alias(mark))
    parts = [part.select(*docs.columns) for part in (single, once)]
    parts.append(tied.select(f"{mark}.*").select(*docs.columns))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
