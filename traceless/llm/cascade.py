"""URL rules through a cascade of Bloom filters.

A list of keys is known exactly, without a join at look-up, over a key universe that is
complete: filter 0 holds the listed keys, filter 1 the keys of the universe that pass
filter 0 falsely, filter 2 the listed keys that pass filter 1, and so on until a filter
passes none of the others.  A key belongs to the list if the number of filters that it
passes before the first refusal is odd (or all filters pass it and their number is odd).

A URL's keys are a suffix of its host's labels followed by a prefix of its path, in the
shapes (labels, path length) that the rules have; the universe is every such key of every
URL, taken from the different (host, path beginning) pairs only.  One cascade says which
keys are rules, a second, over the rules, which of them block.  The longest key that is a
rule decides; a URL without one gets ``default``.

The filters' size goes with the list, not with the corpus: filter 0 is made so sparse that
about as many false keys pass it as the list has, later ones pass half.  A filter beyond
``FILTER_BYTES`` is not broadcast: keys are dealt to shards by a hash, every shard has its own
cascade within that size, and the URLs pass the shards one after another.  Shapes are those
of the rules, a parameter of the job.

Defined cases: a null URL or one without ``://`` has an empty host and path and keys like
any other; a rule ``host`` or ``host/path`` fits its host and all its subdomains if the URL's
path starts with the rule's, in characters and case as written, the host's A-Z in lower case;
of rules as long, that with the longer host wins, of equal rules the blocking one; hosts and
paths of any length cost a key a shape; repeated rows are judged alike; an empty table gives no
rows, an empty list only ``default``; other columns than id and ``url`` are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceless.llm.shared import bound_batches, maybe_broadcast
from traceless.plans.workspace import Stored

ALLOW, BLOCK = "allow", "block"
#: Largest filter that is broadcast.
FILTER_BYTES = 8 << 20
#: A filter's probes at most; more levels than ``MOST_LEVELS`` mean that two keys share both hashes.
MOST_PROBES, MOST_LEVELS = 40, 200
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Filter:
    """Bits in 64-bit words; every level draws its own positions from a key's two hashes."""

    words: np.ndarray
    probes: int
    level: int

    def passes(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        found = np.ones(len(first), bool)
        for k in range(self.probes):
            at = positions(first, second, self.level * MOST_PROBES + k, 64 * len(self.words))
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def positions(first: np.ndarray, second: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The ``k``-th position of each key, whose two hashes are signed longs."""
    mixed = first.view(np.uint64) + np.uint64(k) * (second.view(np.uint64) | np.uint64(1))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _SPREAD
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _SPREAD
    return (mixed ^ (mixed >> np.uint64(32))) % np.uint64(bits)


def members(filters: list[Filter], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Which keys of the universe are listed."""
    listed = np.zeros(len(first), bool)
    open_ = np.arange(len(first))
    for filter_ in filters:
        open_ = open_[filter_.passes(first[open_], second[open_])]
        listed[open_] = ~listed[open_]
    return listed


def hashed(key: Column, salt: int) -> list[Column]:
    """The two hashes of a key; another salt draws them anew."""
    return [F.xxhash64(F.lit(2 * salt + n), key).alias(name) for n, name in enumerate(("h1", "h2"))]


def _numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    first, second = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h1", "h2"))
    return first, second


def build_filter(keys: DataFrame, count: int, rate: float, level: int) -> Filter:
    """A filter of ``count`` keys ``h1, h2`` that passes about ``rate`` of the others."""
    probes = min(MOST_PROBES, max(1, round(math.log2(1 / rate))))
    words = max(1, math.ceil(1.44 * probes * count / 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = _numbers(batch)
            at = np.concatenate([positions(first, second, level * MOST_PROBES + k, 64 * words) for k in range(probes)])
            word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            order = np.argsort(word, kind="stable")
            own, start = np.unique(word[order], return_index=True)
            if len(own):
                sets = np.bitwise_or.reduceat(bit[order], start).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(sets)], ["word", "bits"])

    parts = keys.select("h1", "h2").mapInArrow(run, "word bigint, bits bigint")
    table = parts.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(words, np.uint64)
    bitmap[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return Filter(bitmap, probes, level)


def _passing(keys: DataFrame, filter_: Filter) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(filter_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.passes(*_numbers(batch))))

    return keys.mapInArrow(run, keys.schema)


def build(listed: DataFrame, universe: DataFrame, salt: int = 0) -> list[Filter]:
    """The cascade that tells ``listed`` from the rest of ``universe`` (both different ``key``s)."""
    mine = Stored(listed.select("key", *hashed(F.col("key"), salt)), "listed-keys")
    rest = Stored(universe.select("key", *hashed(F.col("key"), salt)), "universe-keys")
    count, others = mine.df.count(), rest.df.count()
    filters: list[Filter] = []
    while count:
        # the first filter passes about as many others as it holds keys, later ones half
        rate = 0.5 if filters else min(0.5, max(count / max(others, 1), 2.0**-40))
        filters.append(build_filter(mine.df, count, rate, len(filters)))
        passed = _passing(rest.df, filters[-1])
        if len(filters) == 1:
            passed = passed.join(maybe_broadcast(mine).select("key"), "key", "left_anti")
        mine, rest = Stored(passed, "false-keys"), mine
        count = mine.df.count()
        if len(filters) > MOST_LEVELS:
            raise RuntimeError("the filters do not thin out: keys have equal hashes")
        others = rest.df.count()
    return filters


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path."""
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, _URL, 1), ascii_uppercase, ascii_lowercase)
    return host, F.regexp_extract(text, _URL, 2)


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules as a frame ``verdict, key``."""
    return spark.createDataFrame(rules, "verdict string, key string")


def keys_of(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """A URL's keys, the longest first, with the length of each one's host."""
    found = []
    for labels, length in shapes:
        suffix = F.substring_index(host, ".", -labels)
        fits = (F.size(F.split(host, r"\.")) >= labels) & (F.length(path) >= length)
        key = F.concat(suffix, F.substring(path, 1, length))
        found.append(F.when(fits, F.struct(F.length(key).alias("n"), F.length(suffix).alias("host_n"), key.alias("key"))))
    return F.reverse(F.array_sort(F.array_compact(F.array(*found))))


def _shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """Numbers of host labels and path characters that rules have."""
    host = F.substring_index("key", "/", 1)
    shape = rules.select(F.size(F.split(host, r"\.")).alias("labels"), (F.length("key") - F.length(host)).alias("length"))
    return sorted(tuple(r) for r in shape.distinct().collect())


def judge(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", default: str = ALLOW, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``id, host, path, rule, verdict`` of every row of ``pages``; ``rules`` has ``verdict, key``."""
    spark = pages.sparkSession
    host = F.substring_index("key", "/", 1)
    lowered = F.concat(F.translate(host, ascii_uppercase, ascii_lowercase), F.substr("key", F.length(host) + 1))
    kept = rules.where(F.col("key").isNotNull()).select("verdict", lowered.alias("key"))
    rules = Stored(kept.groupBy("key").agg(F.max(F.col("verdict") == BLOCK).alias("blocks")), "url-rules")
    shapes = _shapes(rules.df)
    own_host, own_path = parts_of(F.col("url"))
    urls = bound_batches(pages).select(F.col(id_column).alias("id"), own_host.alias("host"), own_path.alias("path"))
    none = F.lit(None)
    state = urls.select("*", none.cast("string").alias("rule"), none.cast("int").alias("n"), none.cast("int").alias("host_n"), none.cast("boolean").alias("blocks"))
    if shapes:
        longest = max(length for _, length in shapes)
        begun = urls.select("host", F.substring("path", 1, longest).alias("path")).distinct()
        keys = F.transform(keys_of(F.col("host"), F.col("path"), shapes), lambda k: k["key"])
        universe = Stored(begun.select(F.explode(keys).alias("key")).distinct(), "url-keys")
        # the list's bits a key: those of filter 0 and of the halving ones after it
        many, whole = rules.df.count(), universe.df.count()
        a_key = 1.44 * (max(1.0, math.log2(max(whole, 2) / many)) + 4) / 8
        shards = max(1, math.ceil(many * a_key / filter_bytes))
        for shard in range(shards):
            state = _through(state, rules.df, universe.df, shapes, shard, shards)
            if shard + 1 < shards:
                state = Stored(state, "judged").df
    verdict = F.when(F.col("blocks"), BLOCK).when(~F.col("blocks"), ALLOW).otherwise(default)
    return state.select(F.col("id").alias(id_column), "host", "path", "rule", verdict.alias("verdict"))


def _hashes(keys: str, salt: int, n: int) -> Column:
    return F.transform(keys, lambda k: hashed(k["key"], salt)[n])


def _through(state: DataFrame, rules: DataFrame, universe: DataFrame, shapes: list, shard: int, shards: int) -> DataFrame:
    """The URLs after one shard's rules: a longer rule replaces the one found so far."""
    mine = F.pmod(F.xxhash64("key"), F.lit(shards)) == shard
    listed = rules.where(mine)
    is_rule = build(listed.select("key"), universe.where(mine), 2 * shard + 1)
    is_block = build(listed.where("blocks").select("key"), listed.select("key"), 2 * shard + 2)
    shared = state.sparkSession.sparkContext.broadcast((is_rule, is_block))
    names = state.columns
    keys = F.filter(keys_of(F.col("host"), F.col("path"), shapes), lambda k: F.pmod(F.xxhash64(k["key"]), F.lit(shards)) == shard)
    spread = state.withColumn("keys", keys)
    for name, salt in (("r", 2 * shard + 1), ("b", 2 * shard + 2)):
        for n in (0, 1):
            spread = spread.withColumn(f"{name}{n}", _hashes("keys", salt, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule_filters, block_filters = shared.value
        for batch in batches:
            hashes = [batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("r0", "r1", "b0", "b1")]
            found = members(rule_filters, hashes[0], hashes[1])
            sizes = np.diff(batch.column("keys").offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            rows, at = np.unique(row[found], return_index=True)  # keys come longest first
            at = np.flatnonzero(found)[at]
            blocks = members(block_filters, hashes[2][at], hashes[3][at])
            hit = batch.column("keys").flatten().take(pa.array(at))
            yield _merged(batch.select(names), rows, hit, blocks)

    return spread.mapInArrow(run, state.schema)


def _merged(batch: pa.RecordBatch, rows: np.ndarray, hit: pa.StructArray, blocks: np.ndarray) -> pa.RecordBatch:
    """The rows with the found key where it is longer than the one they have."""
    have = [batch.column(c).fill_null(-1).to_numpy(zero_copy_only=False) for c in ("n", "host_n")]
    n, host_n = (hit.field(c).to_numpy(zero_copy_only=False) for c in ("n", "host_n"))
    better = (n > have[0][rows]) | ((n == have[0][rows]) & (host_n > have[1][rows]))
    pick = np.full(batch.num_rows, -1)
    pick[rows[better]] = np.flatnonzero(better)
    index = pa.array(pick, mask=pick < 0)
    fresh = [hit.field("key").take(index), hit.field("n").take(index), hit.field("host_n").take(index), pa.array(blocks).take(index)]
    names = ["rule", "n", "host_n", "blocks"]
    plain = [batch.column(c) for c in batch.schema.names if c not in names]
    merged = [pc.coalesce(new, batch.column(c)) for new, c in zip(fresh, names)]
    return pa.RecordBatch.from_arrays([*plain, *merged], [*(c for c in batch.schema.names if c not in names), *names])
