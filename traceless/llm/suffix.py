"""Suffix-array dedup: repeated byte strings, built blockwise over a difference cover.

A position is *repeated* if the ``width`` bytes from it on also start elsewhere,
in the same text or another.  No array of all suffixes is sorted at once:

1.  Positions of a difference cover modulo ``period`` are the sample.  Any two
    positions have a common distance below ``period`` to sample positions, so two
    equal strings of ``width`` bytes hold, at that distance, two sample positions
    that agree over ``width - period + 1`` bytes.  Sample positions are ranked by
    class: those bytes' hash.  A class of one can end no tie.
2.  Only suffixes that start within ``period`` before a sample position of a
    larger class can tie over the full width.  They are dealt to buckets, and one
    bucket is sorted at a time; its memory is bounded by the number of buckets.

Texts are packed into blocks of ``BLOCK_BYTES``.  A block sends each different
key once, as sorted numbers per bucket, and gets one bit per key back, so a
passage that a third of the documents share costs one key per block and bucket.
Whole texts that occur more than once are repeated from end to end; one of each
takes part for the others' sake.  Keys have 61 bits within a bucket that a second
hash chooses, so the effective length grows with the table.  Both hashes are
polynomials modulo a prime with a base drawn for the search: two different strings agree
with a chance below ``width`` in 2^61, whatever their bytes.

Defined cases: a null text is the empty text; texts shorter than ``width`` lose
nothing; repeated rows are copies of each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import secrets
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from traceless.llm.shared import attach, bound_batches, maybe_broadcast, text_of
from traceless.plans.workspace import Stored

WIDTH = 400
#: Parameter of the difference cover: period 24 r^2 + 36 r + 13, 6 r + 4 positions of it.
COVER = 2
BLOCK_BYTES = 2 << 20
#: Keys that a bucket has on average.
BUCKET_KEYS = 1 << 20
#: Positions hashed at once.
CHUNK = 1 << 18
_PRIME = np.uint64((1 << 61) - 1)
_HALF, _LOW, _LOW_29 = np.uint64(32), np.uint64((1 << 32) - 1), np.uint64((1 << 29) - 1)


def drawn_bases() -> tuple[int, int]:
    """Bases of the two hashes, drawn anew for every search, so that no text can be made to fit them."""
    draw = secrets.SystemRandom()
    return tuple(draw.randrange(1 << 32, int(_PRIME) - 1) for _ in range(2))


def difference_cover(r: int) -> tuple[int, np.ndarray]:
    """Period and positions such that every distance modulo the period is a difference of two."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.concatenate([[0], np.cumsum(steps)])


def times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Products modulo the prime of numbers below it, by halves of 32 bits."""
    a1, a0, b1, b0 = a >> _HALF, a & _LOW, b >> _HALF, b & _LOW
    middle, low = a1 * b0 + a0 * b1, a0 * b0
    total = ((a1 * b1) << np.uint64(3)) + (middle >> np.uint64(29)) + ((middle & _LOW_29) << _HALF) + (low >> np.uint64(61)) + (low & _PRIME)
    return _reduced(total)


def _reduced(total: np.ndarray) -> np.ndarray:
    total = (total >> np.uint64(61)) + (total & _PRIME)
    return np.where(total >= _PRIME, total - _PRIME, total)


@lru_cache(maxsize=8)
def _powers(base: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Halves of the base's powers, and the powers of its inverse."""
    numbers = []
    for b in (base, pow(base, -1, int(_PRIME))):
        powers = np.ones(1, np.uint64)
        while len(powers) < length:
            powers = np.concatenate([powers, times(powers, np.uint64(pow(b, len(powers), int(_PRIME))))])
        numbers.append(powers[:length])
    return numbers[0] >> _HALF, numbers[0] & _LOW, numbers[1]


def window_hashes(data: np.ndarray, at: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash modulo 2^61 - 1 of ``data[i:i + width]`` for the sorted positions ``at``.

    Two different strings agree for at most ``width`` of all bases, whatever their bytes.
    """
    high, low, down = _powers(base, CHUNK + width)
    found = np.empty(len(at), np.uint64)
    cuts = np.searchsorted(at, np.arange(0, len(data) + CHUNK, CHUNK))
    for k, (first, last) in enumerate(zip(cuts, cuts[1:])):
        if first == last:
            continue
        start = k * CHUNK
        letters = data[start : start + CHUNK + width].astype(np.uint64) + np.uint64(1)
        i = at[first:last] - start
        # sums may wrap; a window's own are exact for widths below 2^20
        halves = []
        for half in (high, low):
            sums = np.zeros(len(letters) + 1, np.uint64)
            np.cumsum(letters * half[: len(letters)], out=sums[1:])
            halves.append(sums[i + width] - sums[i])
        value = (halves[0] >> np.uint64(29)) + ((halves[0] & _LOW_29) << _HALF) + halves[1]
        found[first:last] = times(_reduced(value), down[i])
    return found


class Block:
    """Texts of one block side by side, with the sample and candidate positions of each."""

    def __init__(self, texts: list[bytes], width: int, cover: int, bases: tuple[int, int]) -> None:
        self.width, self.bases = width, bases
        self.period, self.cover = difference_cover(cover)
        if self.period > width:
            raise ValueError("the cover's period must not exceed the width")
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(texts), np.uint8)

    def sample(self) -> np.ndarray:
        """Cover positions whose class lies inside their text."""
        reach = self.width - self.period + 1
        found = []
        for start, length in zip(self.starts.tolist(), self.lengths.tolist()):
            grid = np.arange(0, length, self.period)[:, None] + self.cover
            found.append(start + grid[grid + reach <= length])
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def candidates(self, tied: np.ndarray) -> np.ndarray:
        """Starts of whole strings that hold a tied sample position within the period."""
        text = np.searchsorted(self.starts, tied, "right") - 1
        first = np.maximum(self.starts[text], tied - self.period + 1)
        last = np.minimum(tied, self.starts[text] + self.lengths[text] - self.width)
        some = first <= last
        edge = np.zeros(len(self.data) + 2, np.int32)
        np.add.at(edge, first[some], 1)
        np.add.at(edge, last[some] + 1, -1)
        return np.flatnonzero(np.cumsum(edge[:-1]) > 0)

    def keys(self, at: np.ndarray, width: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different keys in order of bucket and value, their buckets, and each position's key.

        The lowest bit of a key says that the block holds it more than once.
        """
        key = window_hashes(self.data, at, width, self.bases[0]) << np.uint64(1)
        bucket = (window_hashes(self.data, at, width, self.bases[1]) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((key, bucket))
        key, bucket = key[order], bucket[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
        number = np.cumsum(fresh) - 1
        of_position = np.empty(len(at), np.int64)
        of_position[order] = number
        more = np.bincount(number, minlength=int(fresh.sum())) > 1
        return key[fresh] | more.astype(np.uint64), bucket[fresh], of_position

    def repeated(self, at: np.ndarray, width: int, buckets: int, answers: list | None) -> np.ndarray:
        """The positions among ``at`` whose keys the buckets found again."""
        if not answers or not len(at):
            return at[:0]
        _, bucket, of_position = self.keys(at, width, buckets)
        flag = np.zeros(len(bucket), bool)
        for answer in answers:
            low, high = np.searchsorted(bucket, [answer["bucket"], answer["bucket"] + 1])
            bits = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=high - low)
            flag[low:high] = bits
        return at[flag[of_position]]

    def results(self, starts: np.ndarray) -> Iterator[tuple[int, int, str]]:
        """Bytes and runs removed and hash of the rest, per text."""
        edge = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + self.width, -1)
        gone = np.cumsum(edge[:-1]) > 0
        for start, length in zip(self.starts.tolist(), self.lengths.tolist()):
            mine, text = gone[start : start + length], self.data[start : start + length]
            removed = int(mine.sum())
            runs = int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum())
            kept = text[~mine] if removed else text
            yield removed, runs, hashlib.sha256(kept.tobytes()).hexdigest()


def _sort_bucket(table: pa.Table) -> pa.Table:
    """One bucket: sort all its keys, tell each block which of its keys are repeated."""
    blobs = [np.frombuffer(b, np.uint64) for b in table.column("keys").to_pylist()]
    keys = np.concatenate(blobs)
    order = np.argsort(keys >> np.uint64(1), kind="stable")
    ranked = keys[order] >> np.uint64(1)
    fresh = np.ones(len(keys), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    number = np.cumsum(fresh) - 1
    many = (np.bincount(number) > 1) | (np.bincount(number, keys[order] & np.uint64(1)) > 0)
    flags = np.empty(len(keys), bool)
    flags[order] = many[number]
    cuts = np.cumsum([len(b) for b in blobs])[:-1]
    parts = np.split(flags, cuts)
    bits = [np.packbits(p).tobytes() if p.any() else None for p in parts]
    result = pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})
    return result.filter(pc.is_valid(result.column("bits")))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


@dataclass(frozen=True)
class Plan:
    """Sizes of a search; all that its tasks need besides their rows."""

    width: int
    cover: int
    sample_buckets: int
    suffix_buckets: int
    bases: tuple[int, int]

    @property
    def reach(self) -> int:
        """Bytes that make a sample position's class."""
        return self.width - difference_cover(self.cover)[0] + 1

    def block(self, row: dict) -> Block:
        return Block([d["text"] for d in row["texts"]], self.width, self.cover, self.bases)

    def candidates(self, block: Block, answers: list | None) -> np.ndarray:
        tied = block.repeated(block.sample(), self.reach, self.sample_buckets, answers)
        return block.candidates(tied)


def plan(total: int, width: int, cover: int, bucket_keys: int) -> Plan:
    period, positions = difference_cover(cover)
    sample = total * len(positions) / period
    # candidates lie near tied sample positions, a part of all positions
    return Plan(width, cover, max(1, math.ceil(sample / bucket_keys)), max(1, math.ceil(total / (4 * bucket_keys))), drawn_bases())


def _sent(blocks: DataFrame, sizes: Plan, second: bool) -> DataFrame:
    """Keys of each block per bucket: sample classes, or whole strings where these are tied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = sizes.block(row)
            if second:
                at = sizes.candidates(block, row["sample"])
                keys, bucket, _ = block.keys(at, sizes.width, sizes.suffix_buckets)
            else:
                keys, bucket, _ = block.keys(block.sample(), sizes.reach, sizes.sample_buckets)
            some, first = np.unique(bucket, return_index=True)
            if len(some):
                blobs = [k.tobytes() for k in np.split(keys, first[1:])]
                columns = [pa.array(some), pa.array([row["block"]] * len(some), pa.int64()), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "block", "keys"])

    return blocks.mapInArrow(run, "bucket bigint, block bigint, keys binary")


def _answers(sent: DataFrame, name: str) -> Stored:
    """Per block, the bits of its keys in every bucket that found one again."""
    found = sent.groupBy("bucket").applyInArrow(_sort_bucket, "block bigint, bucket bigint, bits binary")
    return Stored(found.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(name)), f"{name}-answers")


def _search(packed: Stored, sizes: Plan) -> DataFrame:
    """Two passes over the blocks, each followed by one sort per bucket; then the results."""
    sample = _answers(_sent(packed.df, sizes, False), "sample")
    first = packed.df.join(maybe_broadcast(sample), "block", "left")
    suffix = _answers(_sent(first, sizes, True), "suffix")
    both = first.join(maybe_broadcast(suffix), "block", "left")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = sizes.block(row)
            at = sizes.candidates(block, row["sample"])
            starts = block.repeated(at, sizes.width, sizes.suffix_buckets, row["suffix"])
            results = zip(row["texts"], block.results(starts))
            mine = [(d["doc_id"], len(d["text"]), *found) for d, found in results if not d["whole"]]
            if mine:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in mine], schema)

    id_field = packed.schema["texts"].dataType.elementType["doc_id"]
    spark_schema = StructType(
        [id_field, *[StructField(n, LongType()) for n in names[1:4]], StructField("kept_sha256", StringType())]
    )
    schema = to_arrow_schema(spark_schema)
    return both.mapInArrow(run, spark_schema)


def remove_repeats(
    docs: DataFrame, width: int = WIDTH, cover: int = COVER, block_bytes: int = BLOCK_BYTES, bucket_keys: int = BUCKET_KEYS
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    text = text_of("text")
    texts = bound_batches(docs).select("doc_id", text.cast("binary").alias("text"), F.sha2(text, 256).alias("sha"))
    rows = Stored(texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "sha"), "texts")
    counts = rows.df.where(F.col("n_bytes") >= width).groupBy("sha").agg(F.count(F.lit(1)).alias("n"))
    copied = Stored(counts.where("n > 1"), "copied")
    keys = Stored(copied.df.select("sha"), "copied-keys")

    def plain(frame: DataFrame, removed, kept) -> DataFrame:
        spans = F.when(removed > 0, 1).otherwise(0).cast("long")
        return frame.select("doc_id", "n_bytes", removed.alias("n_removed"), spans.alias("n_spans"), kept.alias("kept_sha256"))

    short = plain(rows.df.where(F.col("n_bytes") < width), F.lit(0).cast("long"), F.col("sha"))
    whole = plain(attach(rows, copied, ["sha"], "n"), F.col("n_bytes"), F.sha2(F.lit(""), 256))
    long_texts = texts.where(F.octet_length("text") >= width)
    single = long_texts.join(maybe_broadcast(keys), "sha", "left_anti").withColumn("whole", F.lit(False))
    one_each = long_texts.join(maybe_broadcast(keys), "sha", "left_semi").dropDuplicates(["sha"])
    pool = single.unionByName(one_each.withColumn("whole", F.lit(True)))
    total = rows.df.where(F.col("n_bytes") >= width).agg(F.sum("n_bytes")).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    placed = pool.withColumn("block", F.pmod(F.xxhash64("sha"), F.lit(blocks)))
    packed = placed.groupBy("block").agg(F.collect_list(F.struct("doc_id", "whole", "text")).alias("texts"))
    found = _search(Stored(packed, "blocks"), plan(total, width, cover, bucket_keys))
    return short.unionByName(whole).unionByName(found)
