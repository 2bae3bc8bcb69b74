"""SimHash near-dedup over a byte-position inverted index with count filtering.

Two 64-bit fingerprints within ``max_bits = 4`` bits differ in at most four of
their eight bytes, so they share at least four positional bytes.  The index
posts each different fingerprint under blocks of three positions, chosen so that
every set of four positions contains a block (20 blocks): no pair within reach
can miss all lists.  A list that is too long is posted again under the block and
one more position, which its linked pairs must share as well; lists that stay
long are worked off in pairs of slices.  In a list, the shared positional bytes
of each pair are tallied, pairs with four or more are kept and their bits are
compared.  Only a spanning star per linked part of a list leaves the task, so a
group of m near copies gives m rows, not m squared.

Texts with equal fingerprints are one node, whatever their number.  Defined
cases: a null or blank text has fingerprint zero and is linked like any other;
fewer words than a shingle form one shingle; an empty table gives no rows; a
null ``doc_id`` takes part and is never the smallest while others exist.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceless.llm.components import components
from traceless.llm.shared import attach, bound_batches, maybe_broadcast, slices, text_of
from traceless.plans.workspace import Stored, union_stored

POSITIONS = 8
SHARED_BYTES = 4
#: Members of a list that are compared in one go.
LIST_ROWS = 512
SEED = 42
_LOW_BITS = np.uint64(0x0101010101010101)
#: Rows summed without a carry between the eight counters of a word.
_CARRY_FREE = 255


def blocks_of_three() -> list[tuple[int, ...]]:
    """Triples of positions such that every four positions contain one (Turan's system)."""
    parts = [(0, 1, 2), (3, 4, 5), (6, 7)]
    where = {p: i for i, part in enumerate(parts) for p in part}

    def chosen(triple: tuple[int, ...]) -> bool:
        count = [sum(where[p] == i for p in triple) for i in range(3)]
        return 3 in count or any(count[i] == 2 and count[(i + 1) % 3] == 1 for i in range(3))

    return [t for t in combinations(range(POSITIONS), 3) if chosen(t)]


def shingle_hashes(text: str, width: int, seed: int = SEED) -> list[int]:
    """XXH64 of every shingle of ``width`` words, A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-width].tolist()]
    digest, stops = xxhash.xxh64_intdigest, (ends[width - 1 :] - 1).tolist()
    return [digest(joined[a:b], seed) for a, b in zip(starts, stops)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint per text: bits set in over half of its hashes; ``counts`` hashes each."""
    result = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return result
    lengths = counts[some]
    firsts = np.cumsum(lengths) - lengths
    pieces = -(-lengths // _CARRY_FREE)
    piece_firsts = np.cumsum(pieces) - pieces
    within = np.arange(pieces.sum()) - np.repeat(piece_firsts, pieces)
    cuts = np.repeat(firsts, pieces) + within * _CARRY_FREE
    found = np.zeros(len(some), np.uint64)
    for bit in range(8):
        lanes = (hashes >> np.uint64(bit)) & _LOW_BITS
        sums = np.add.reduceat(lanes, cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        totals = np.add.reduceat(sums, piece_firsts, axis=0)
        major = (2 * totals > lengths[:, None]).astype(np.uint64)
        for byte in range(8):
            found |= major[:, byte] << np.uint64(8 * byte + bit)
    result[some] = found
    return result


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id, fp`` (64 bits as a signed long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            each = [shingle_hashes(t, width) for t in batch.column("text").to_pylist()]
            counts = np.array([len(h) for h in each], np.int64)
            flat = np.fromiter((h for one in each for h in one), np.uint64, int(counts.sum()))
            bits = majority_bits(flat, counts).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = bound_batches(docs).select("doc_id", text_of("text").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, fp bigint")


def _mask(positions: Iterable[int]) -> int:
    """The bytes at ``positions`` set, as a signed 64-bit number."""
    mask = sum(255 << (8 * p) for p in positions)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _at(positions: Iterable[int]) -> Column:
    """The fingerprint with all bytes but those at ``positions`` cleared."""
    return F.col("fp").bitwiseAND(F.lit(_mask(positions)).cast("long"))


def postings(fps: DataFrame, blocks: list[tuple[int, ...]]) -> DataFrame:
    """``block, key, fp`` for every block; a block is written as the bit set of its positions."""
    entries = [
        F.struct(F.lit(sum(1 << p for p in b)).alias("block"), _at(b).alias("key")) for b in blocks
    ]
    return fps.select("fp", F.explode(F.array(*entries)).alias("e")).select("e.block", "e.key", "fp")


def _extended(long_lists: DataFrame) -> DataFrame:
    """Postings of long lists under one position more."""
    options = [
        F.when(
            F.col("block").bitwiseAND(F.lit(1 << p)) == 0,
            F.struct(
                F.col("block").bitwiseOR(F.lit(1 << p)).alias("block"),
                F.col("key").bitwiseOR(_at([p])).alias("key"),
            ),
        )
        for p in range(POSITIONS)
    ]
    exploded = long_lists.select("fp", F.explode(F.array_compact(F.array(*options))).alias("e"))
    return exploded.select("e.block", "e.key", "fp")


def _sliced(lists: DataFrame, sizes: DataFrame) -> DataFrame:
    """Lists beyond ``LIST_ROWS`` as pairs of slices: every two members meet in one of them."""
    half = LIST_ROWS // 2
    n = F.ceil(F.col("n") / F.lit(half)).cast("int")
    marked = lists.join(sizes, ["block", "key"]).withColumn("n", n)
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda other: F.struct(F.least(F.col("own"), other).alias("i"), F.greatest(F.col("own"), other).alias("j")),
    )
    met = marked.withColumn("own", own).select("block", "key", "fp", F.explode(pairs).alias("s"))
    return met.select("block", "key", "s.i", "s.j", "fp")


def _stars(members: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of lists of one length (rows of ``members``): each member with its part's first one."""
    count, m = members.shape
    differ = members[:, :, None] ^ members[:, None, :]
    shared = (differ.view(np.uint8).reshape(count, m, m, 8) == 0).sum(axis=3)
    near = (shared >= SHARED_BYTES) & (np.bitwise_count(differ) <= max_bits)
    label = np.broadcast_to(np.arange(m), (count, m))
    while True:
        lower = np.where(near, label[:, None, :], m).min(axis=2)
        if (lower == label).all():
            break
        label = lower
    row, col = np.nonzero(label != np.arange(m))
    return members[row, col], members[row, label[row, col]]


def _linker(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("fps")
            flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = np.diff(column.offsets.to_numpy())
            starts = np.cumsum(sizes) - sizes
            for m in np.unique(sizes):
                chosen = starts[sizes == m]
                step = max(1, (1 << 19) // int(m * m))
                for at in range(0, len(chosen), step):
                    index = chosen[at : at + step, None] + np.arange(m)
                    a, b = _stars(np.sort(flat[index], axis=1), max_bits)
                    if len(a):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"]
                        )

    return run


def links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """Links ``a, b`` between different fingerprints that span all pairs within ``max_bits``."""
    if not 0 <= max_bits <= POSITIONS - SHARED_BYTES:
        raise ValueError("the index guarantees pairs of at most four differing bits")
    lists = Stored(postings(fps, blocks_of_three()), "postings")
    parts = []
    while True:
        sizes = lists.df.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n"))
        long_sizes = Stored(sizes.where(F.col("n") > LIST_ROWS), "long-lists")
        short = lists.df
        any_long = not long_sizes.is_empty()
        last = F.bit_count(F.col("block")) >= SHARED_BYTES
        if any_long:
            keys = maybe_broadcast(Stored(long_sizes.df.select("block", "key"), "long-keys"))
            short = short.join(keys, ["block", "key"], "left_anti")
            final = _sliced(lists.df, long_sizes.df.where(last))
            parts.append(_gathered(final, ["block", "key", "i", "j"]))
        parts.append(_gathered(short, ["block", "key"]))
        if not any_long:
            break
        again = lists.df.join(keys, ["block", "key"], "left_semi").where(~last)
        lists = Stored(_extended(again).distinct(), "postings")
        if lists.is_empty():
            break
    run = _linker(max_bits)
    found = [Stored(p.mapInArrow(run, "a bigint, b bigint").distinct(), "links") for p in parts]
    return union_stored(found).distinct()


def _gathered(lists: DataFrame, keys: list[str]) -> DataFrame:
    """Lists with two members or more; none is longer than ``LIST_ROWS`` by much."""
    grouped = lists.groupBy(*keys).agg(F.collect_list("fp").alias("fps"))
    return grouped.where(F.size("fps") > 1).select("fps")


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    rows = Stored(fingerprints(docs, width), "fingerprints")
    nodes = Stored(
        rows.df.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_rows")),
        "nodes",
    )
    edges = Stored(links(nodes.df.select("fp"), max_bits), "fp-links")
    roots = Stored(components(edges.df).withColumnRenamed("node", "fp"), "roots")
    rooted = nodes.df.join(roots.df, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = Stored(rooted.join(least, "root").select("fp", "component_id", "n_rows"), "fp-groups")
    return attach(rows, groups, ["fp"], "n_rows").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
