"""Near-dedup by similarity of word shingles, over the SimHash byte-position index.

Four bits of 64 reach only texts that are almost equal.  Texts of which four
fifths of the shingles agree differ in about a sixth of their bits, so this form
keeps two fingerprints of 64 bits, posts every text under all pairs of positional
bytes of each (28 lists a fingerprint) and under ``BANDS`` hashes of least shingles,
and takes pairs that meet in a list and differ in ``MAX_BITS`` of 128 bits at most
as candidates.  The shingle sets of candidates are compared, so only true pairs link.

A list yields a spanning tree of its closest pairs and, for a longer list, each member's
pair with the one nearest to the list's centre, since edited copies are closer to their
original than to each other: one row a member, with both pairs.  Of all these a row's
nearest one and the one of its longest list are compared, two pairs a row at most.  Where parts that lists hold together are still
apart, their members are searched again: each names its nearest partners in other parts, eight
times as many per round, until no pair within reach is left untried between two parts.
There the count filter comes in: of ``MARKS`` positional bytes, each of the least shingle
in an order of its own, two texts with a similarity of s share s of all in the mean, and
pairs that share fewer than four deviations under the mean of 0.8 are not named.

Fingerprints are taken over the different shingles, as the comparison is.  Texts with the
same shingles are one entry; others are entries of their own even with equal
fingerprints.  A list longer than ``LIST_ROWS`` is worked off in pairs of slices,
whatever its length; two different slices yield only what joins their trees.

Defined cases: a null or blank text has no shingles and is similar to every other
such text; repeated rows are copies; an empty table gives no rows; of a group, the
row with the smallest ``doc_id`` stays, rows without one only if all lack it; a text
of any length is hashed whole, alone in its batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceless.llm.components import components
from traceless.llm.shared import bound_batches, maybe_broadcast, slices, text_of
from traceless.llm.simhash import POSITIONS, SEED, majority_bits, shingle_hashes
from traceless.plans.workspace import Stored, shuffled, union_stored

#: Mean distance of texts with similarity 0.8 is 19 of 128 bits; this is over three deviations more.
MAX_BITS = 34
LIST_ROWS = 4096
#: One in so many entries is counted to find the long lists.
COUNTED = 16
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
#: Lists by the least of ``BAND_ROWS`` orders of the shingles each; at 0.8 one list is shared with 41 %.
BANDS, BAND_ROWS = 12, 4
_ORDERS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Positional bytes of a text, and how many of them a pair named by the search shares at least.
MARKS = 96
SHARED_MARKS = int(0.8 * MARKS - 4 * (0.16 * MARKS) ** 0.5)
_MORE_ORDERS = np.random.default_rng(SEED + 1).integers(0, 1 << 63, MARKS - BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Members of a list from which on its centre is used.
CENTRE_ROWS = 8
#: Partners that a member names in the first search after the trees, and their growth per round.
PARTNERS = 8
#: Rows of a group up to which its pairs are rows; larger groups are compared slice by slice.
GROUP_ROWS = 64
#: Rows and characters of a group's slice at most, and the rows from which on up to ``SPREAD`` slices share a group.
SLICE_ROWS, SLICE_CHARS, SPREAD_ROWS, SPREAD = 4096, 4 << 20, 512, 8
#: Counts, and shingles met, that are held at once.
COUNTS = 1 << 21


def least_bands(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``BANDS`` hashes per text of the least of its hashes in several orders, and ``MARKS`` bytes of these."""
    marks = np.zeros((len(counts), MARKS), np.uint8)
    result = np.zeros((len(counts), BANDS), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        firsts = np.cumsum(counts[some]) - counts[some]
        for n, order in enumerate([*_ORDERS, *_MORE_ORDERS]):
            least = np.minimum.reduceat(hashes * order, firsts)
            marks[some, n] = ((least ^ (least >> np.uint64(31))) * _SPREAD) >> np.uint64(56)
            if n < len(_ORDERS):
                band = result[some, n // BAND_ROWS] * _SPREAD
                result[some, n // BAND_ROWS] = (band ^ (band >> np.uint64(32))) + least
    return result, marks


def two_fingerprints(rows: DataFrame, width: int) -> DataFrame:
    """``row, fp0, fp1, whole, bands, marks`` of every whole text's different shingles.

    ``fp1`` has bits of the remixed hashes; ``whole`` is a hash of the shingle set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            each = [set(shingle_hashes(t, width)) for t in batch.column("text").to_pylist()]
            counts = np.array([len(h) for h in each], np.int64)
            flat = np.fromiter((h for one in each for h in one), np.uint64, int(counts.sum()))
            again = (flat ^ (flat >> np.uint64(31))) * _SPREAD
            again ^= again >> np.uint64(29)
            bits = [pa.array(majority_bits(h, counts).view(np.int64)) for h in (flat, again)]
            sums = np.zeros(len(counts), np.uint64)
            some = np.flatnonzero(counts)
            if len(some):
                sums[some] = np.add.reduceat(again * _ORDERS[0] ^ (again >> np.uint64(32)), np.cumsum(counts[some]) - counts[some])
            bits.append(pa.array(sums.view(np.int64)))
            found, marks = least_bands(flat, counts)
            flat_bands = pa.array(found.view(np.int64).ravel())
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * BANDS), flat_bands)
            columns = [batch.column("row"), *bits, bands, pa.array([m.tobytes() for m in marks], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "fp0", "fp1", "whole", "bands", "marks"])

    return rows.mapInArrow(run, "row bigint, fp0 bigint, fp1 bigint, whole bigint, bands array<bigint>, marks binary")


def _postings(entries: DataFrame, columns: list[str]) -> DataFrame:
    """Entries under every pair of positional bytes of either fingerprint and under every band."""
    places = []
    for word in (0, 1):
        for pair in combinations(range(POSITIONS), 2):
            mask = sum(255 << (8 * p) for p in pair)
            mask -= (1 << 64) * (mask >= 1 << 63)
            block = F.lit(word << 8 | sum(1 << p for p in pair)).cast("int")
            key = F.col(f"fp{word}").bitwiseAND(F.lit(mask).cast("long"))
            places.append(F.struct(block.alias("block"), key.alias("key")))
    for band in range(BANDS):
        places.append(F.struct(F.lit(2 << 8 | band).cast("int").alias("block"), F.col("bands")[band].alias("key")))
    return entries.select("*", F.explode(F.array(*places)).alias("p")).select("p.block", "p.key", *columns)


def _trees(first: np.ndarray, second: np.ndarray, max_bits: int) -> tuple[np.ndarray, ...]:
    """Spanning trees of closest pairs (Prim's method) of lists of one length.

    Returns list number, member, its partner and their distance for all tree edges within reach.
    """
    count, m = first.shape
    lists = np.arange(count)
    far = np.int16(1000)
    near = np.full((count, m), far)
    partner = np.zeros((count, m), np.int64)
    done = np.zeros((count, m), bool)
    node = np.zeros(count, np.int64)
    found = []
    for _ in range(m - 1):
        done[lists, node] = True
        distance = np.bitwise_count(first ^ first[lists, node][:, None]).astype(np.int16)
        distance += np.bitwise_count(second ^ second[lists, node][:, None])
        closer = distance < near
        near[closer] = distance[closer]
        partner = np.where(closer, node[:, None], partner)
        node = np.where(done, far, near).argmin(axis=1)
        # nodes all done give the first one again; the loop ends before that
        hit = near[lists, node] <= max_bits
        found.append((lists[hit], node[hit], partner[lists, node][hit], near[lists, node][hit]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _centre(words: np.ndarray) -> np.uint64:
    """The word whose bits most of ``words`` have."""
    ones = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(words)).view(np.uint64)[0]


def _distances(words: tuple[np.ndarray, np.ndarray], others: tuple) -> np.ndarray:
    return sum(np.bitwise_count(mine ^ other).astype(np.int16) for mine, other in zip(words, others))


def _partners(words: tuple, marks: list[bytes | None], root: np.ndarray, max_bits: int, most: int) -> Iterator[tuple]:
    """Members of one list, each with its ``most`` nearest partners of other parts that share enough marks.

    Yields members, their partners, the distances, and the members that have more of them.
    """
    m = len(root)
    plain = np.array([x is None for x in marks])
    own = np.frombuffer(b"".join(x or bytes(MARKS) for x in marks), np.uint8).reshape(m, MARKS)
    step = max(1, (1 << 20) // m)
    for at in range(0, m, step):
        part = slice(at, at + step)
        distance = _distances([w[part, None] for w in words], words)
        distance[root[part, None] == root] = 1000
        row, col = np.nonzero(distance <= max_bits)
        alike = np.empty(len(row), bool)
        for k in range(0, len(row), 1 << 14):
            some = slice(k, k + (1 << 14))
            alike[some] = (own[row[some] + at] == own[col[some]]).sum(axis=1) >= SHARED_MARKS
        alike |= plain[row + at] | plain[col]
        row, col = row[alike], col[alike]
        near = distance[row, col]
        order = np.lexsort((near, row))
        row, col, near = row[order], col[order], near[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        first = place < most
        yield row[first] + at, col[first], near[first], np.unique(row[~first]) + at


def _searcher(max_bits: int, most: int):
    """Rows ``a, b, d``: a member names a partner; one with ``b`` null says that ``a`` has further partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("members")
            fields = dict(zip(("row", "fp0", "fp1", "root", "marks"), column.flatten().flatten()))
            row, fp0, fp1, root = (fields[f].to_numpy(zero_copy_only=False) for f in ("row", "fp0", "fp1", "root"))
            offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
            for start, stop in zip(offsets[:-1], offsets[1:]):
                own = slice(start, stop)
                names, marks = row[own], fields["marks"].slice(start, stop - start).to_pylist()
                words = (fp0[own].view(np.uint64), fp1[own].view(np.uint64))
                for a, b, d, more in _partners(words, marks, root[own], max_bits, most):
                    none = pa.nulls(len(more), pa.int64())
                    ends = pa.concat_arrays([pa.array(names[b]), none])
                    far = pa.concat_arrays([pa.array(d.astype(np.int32)), pa.nulls(len(more), pa.int32())])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([names[a], names[more]])), ends, far], ["a", "b", "d"])

    return run


def _crossing(words: list[np.ndarray], own: np.ndarray, max_bits: int) -> tuple[np.ndarray, ...]:
    """Two slices of a list: those tree edges between them that join what trees within a slice leave apart."""
    label = np.arange(len(own))
    for side in np.unique(own):
        index = np.flatnonzero(own == side)
        if len(index) > 1:
            _, node, partner, _ = _trees(*(w[None, index] for w in words), max_bits)
            for one, other in zip(index[node].tolist(), index[partner].tolist()):
                label[label == label[one]] = label[other]
    _, node, partner, d = _trees(*(w[None] for w in words), max_bits)
    across = own[node] != own[partner]
    joins = list(_joining(label, iter([(node[across], partner[across])])))
    a, b = np.array(joins, np.int64).reshape(-1, 2).T
    return a, b, _distances([w[a] for w in words], [w[b] for w in words])


def _linker(max_bits: int):
    """Rows ``a < b, d, member, centre, away, size``: a tree edge, and the distance of its member to the list's centre.

    A list has a row for each member at most.  Without a centre within reach ``member`` is
    null; ``a``, ``b`` and ``d`` are null for a member that has an edge to the centre only.
    Two slices of a long list (members with ``own``) have fewer: what the lists of either
    slice do not join already.
    """
    names = ["a", "b", "d", "member", "centre", "away", "size"]

    def edges(one: np.ndarray, other: np.ndarray, d: np.ndarray, size: int, centre: tuple | None = None) -> pa.RecordBatch:
        pair = np.sort(np.stack([one, other]), axis=0)
        none, longs, ints = np.zeros(len(one), bool), pa.int64(), pa.int32()
        blank, member, to, away, near = centre or (none, one, one, d, none)
        columns = [(pair[0], longs, blank), (pair[1], longs, blank), (d, ints, blank), (member, longs, ~near), (to, longs, ~near), (away, ints, ~near)]
        arrays = [pa.array(values, kind, mask=mask) for values, kind, mask in columns]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(one), size, np.int32))], names)

    def with_centre(row: np.ndarray, words: list[np.ndarray], node: np.ndarray, partner: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        m = len(row)
        other, distance, blank = np.arange(m), np.zeros(m, np.int64), np.ones(m, bool)
        other[node], distance[node], blank[node] = partner, d, False
        centre = int(_distances(words, [_centre(w) for w in words]).argmin())
        away = _distances(words, [w[centre] for w in words]).astype(np.int64)
        near = (away <= max_bits) & (np.arange(m) != centre)
        use = near | ~blank
        found = (blank[use], row[use], np.full(use.sum(), row[centre]), away[use], near[use])
        return edges(row[use], row[other[use]], distance[use], m, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("members")
            row, *fields = (f.to_numpy(zero_copy_only=False) for f in column.flatten().flatten())
            words = [f.view(np.uint64) for f in fields[:2]]
            sizes = np.diff(column.offsets.to_numpy())
            starts = np.cumsum(sizes) - sizes
            plain = np.ones(len(sizes), bool)
            if len(fields) > 2 and len(sizes):
                plain = np.minimum.reduceat(fields[2], starts) == np.maximum.reduceat(fields[2], starts)
            for k in np.flatnonzero(~plain):
                own = slice(starts[k], starts[k] + sizes[k])
                a, b, d = _crossing([w[own] for w in words], fields[2][own], max_bits)
                yield edges(row[own][a], row[own][b], d.astype(np.int64), sizes[k])
            for m in np.unique(sizes[plain]):
                chosen = starts[plain & (sizes == m)]
                step = max(1, (1 << 18) // int(m))
                for at in range(0, len(chosen), step):
                    index = chosen[at : at + step, None] + np.arange(m)
                    which, a, b, d = _trees(words[0][index], words[1][index], max_bits)
                    d = d.astype(np.int64)
                    if m < CENTRE_ROWS:
                        yield edges(row[index[which, a]], row[index[which, b]], d, m)
                        continue
                    order = np.argsort(which, kind="stable")
                    cut = np.searchsorted(which[order], np.arange(len(index) + 1))
                    for k, own in enumerate(index):
                        mine = order[cut[k] : cut[k + 1]]
                        yield with_centre(row[own], [w[own] for w in words], a[mine], b[mine], d[mine])

    return run


def candidates(entries: DataFrame, max_bits: int = MAX_BITS, most: int = 0) -> DataFrame:
    """Pairs of rows that meet in a list and lie within ``max_bits``.

    Without ``most``, what :func:`_linker` finds in the lists; else what :func:`_searcher`
    finds between the parts in the column ``root``.
    """
    columns = ["row", "fp0", "fp1", "root", "marks"] if most else ["row", "fp0", "fp1"]
    counted = _postings(entries.where(F.pmod(F.xxhash64("row"), F.lit(COUNTED)) == 0), ["row"])
    sizes = counted.groupBy("block", "key").agg((F.count(F.lit(1)) * COUNTED).alias("n"))
    long_lists = Stored(sizes.where(F.col("n") > LIST_ROWS), "long-lists")
    half = LIST_ROWS // 2
    parts = F.coalesce(F.ceil(F.col("n") / F.lit(half)), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    met = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.struct(F.least("own", other).alias("i"), F.greatest("own", other).alias("j")),
    )
    marked = _postings(entries, columns)
    if not long_lists.is_empty():
        marked = marked.join(maybe_broadcast(long_lists), ["block", "key"], "left").withColumn("parts", parts)
        marked = marked.withColumn("own", own).withColumn("s", F.explode(met)).select("*", "s.i", "s.j")
    else:
        marked = marked.withColumns({"i": F.lit(0), "j": F.lit(0)})
    if not most and "own" in marked.columns:
        columns = [*columns, "own"]
    listed = marked.groupBy("block", "key", "i", "j").agg(F.collect_list(F.struct(*columns)).alias("members"))
    listed = listed.where(F.size("members") > 1).select("members")
    if most:
        return listed.mapInArrow(_searcher(max_bits, most), "a bigint, b bigint, d int").distinct()
    kind = "a bigint, b bigint, d int, member bigint, centre bigint, away int, size int"
    found = listed.mapInArrow(_linker(max_bits), kind)
    longest = F.when(F.col("centre").isNotNull(), F.struct((-F.col("size")).alias("size"), "away", "centre"))
    found = found.groupBy("a", "b", "member").agg(F.min("d").alias("d"), F.min(longest).alias("longest"))
    return found.select("a", "b", "member", "d", "longest.size", "longest.away", "longest.centre")


def verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of ``similarity`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_a"):
            keep = []
            for one, other in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                x, y = (set(shingle_hashes(t, width, SEED)) for t in (one, other))
                both = len(x & y)
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def _shared_counts(own: list[np.ndarray], others: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of rows of the matrix of shared hashes, each with the number of its first row."""
    lengths, m = np.array([len(h) for h in own], np.int64), len(others)
    _, ids = np.unique(np.concatenate([*own, *others]), return_inverse=True)
    mine, theirs = ids[: lengths.sum()], ids[lengths.sum() :]
    order = np.argsort(theirs, kind="stable")
    holders = np.repeat(np.arange(m), [len(h) for h in others])[order]
    low, high = (np.searchsorted(theirs[order], mine, side) for side in ("left", "right"))
    row = np.repeat(np.arange(len(own)), lengths)
    met = np.cumsum(high - low)
    step = max(1, COUNTS // m)
    for first in range(0, len(own), step):
        last = min(first + step, len(own))
        counts = np.zeros((last - first) * m, np.int64)
        at, stop = np.searchsorted(row, [first, last])
        while at < stop:
            to = min(stop, max(at + 1, int(np.searchsorted(met, (met[at - 1] if at else 0) + COUNTS, "right"))))
            many = high[at:to] - low[at:to]
            inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            cells = np.repeat((row[at:to] - first) * m, many) + holders[np.repeat(low[at:to], many) + inside]
            counts += np.bincount(cells, minlength=len(counts))
            at = to
        yield first, counts.reshape(-1, m)


def _joining(root: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """Those of the pairs that join two parts, in order; ``root`` names each row's part at the start."""
    _, label = np.unique(root, return_inverse=True)
    for a, b in pairs:
        for at in range(0, len(a), COUNTS >> 9):
            x, y = a[at : at + (COUNTS >> 9)], b[at : at + (COUNTS >> 9)]
            apart = label[x] != label[y]
            for one, other in zip(x[apart].tolist(), y[apart].tolist()):
                if label[one] != label[other]:
                    label[label == label[other]] = label[one]
                    yield one, other


def _compared(width: int, similarity: float):
    """Two slices of a group (or one with itself): the links that join parts, fewer than rows."""

    def run(table: pa.Table) -> pa.Table:
        first, second = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        slice_of, names, root = (table.column(c).to_numpy() for c in ("own", "row", "root"))
        texts = table.column("text")
        hashes = [np.array(list(set(shingle_hashes(texts[k].as_py(), width, SEED))), np.uint64) for k in range(len(names))]
        lengths = np.array([len(h) for h in hashes], np.int64)
        left, right = (np.flatnonzero(slice_of == s) for s in (first, second))

        def alike() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for start, both in _shared_counts([hashes[k] for k in left], [hashes[k] for k in right]):
                total = lengths[left[start : start + len(both)], None] + lengths[right]
                a, b = np.nonzero(both >= similarity * (total - both))
                yield left[a + start], right[b]

        links = list(_joining(root, alike())) if len(left) and len(right) else []
        pair = np.sort(names[np.array(links, np.int64).reshape(-1, 2)], axis=1)
        return pa.table({"a": pair[:, 0], "b": pair[:, 1]})

    return run


def compared_whole(rows: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links ``a, b`` that join parts within the groups of ``rows(row, root, group, parts)``."""
    own = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    met = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j"))
    )
    dealt = rows.join(texts, "row").withColumn("own", own).withColumn("s", F.explode(met))
    blocks = dealt.select("group", "s.i", "s.j", "own", "row", "root", "text").groupBy("group", "i", "j")
    return blocks.applyInArrow(_compared(width, similarity), "a bigint, b bigint").distinct()


def _groups(apart: DataFrame, rooted: DataFrame, texts: DataFrame) -> Stored:
    """``row, root, group, m, parts`` of rows whose part a list holds together with another part."""
    group = Stored(components(apart, "groups"), "open-groups").df.toDF("root", "group")
    rows = Stored(rooted.select("row", "root").join(shuffled(group), "root"), "group-rows")
    sizes = texts.join(maybe_broadcast(rows), "row").groupBy("group").agg(F.count(F.lit(1)).alias("m"), F.sum(F.length("text")).alias("chars"))
    at_most = lambda column, most: F.ceil(F.col(column) / F.lit(most))
    parts = F.greatest(at_most("m", SLICE_ROWS), at_most("chars", SLICE_CHARS), F.least(at_most("m", SPREAD_ROWS), F.lit(SPREAD)))
    sizes = Stored(sizes.select("group", "m", parts.cast("int").alias("parts")), "group-sizes")
    return Stored(rows.df.join(maybe_broadcast(sizes), "group"), "grouped-rows")


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Every pair from either end: ``row, other`` and the rest."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    there = pairs.select(F.col("a").alias("row"), F.col("b").alias("other"), *rest)
    return there.unionByName(pairs.select(F.col("b").alias("row"), F.col("a").alias("other"), *rest))


def _pairs(named: DataFrame) -> DataFrame:
    return named.select(F.least("row", "other").alias("a"), F.greatest("row", "other").alias("b")).distinct()


def _first_pairs(found: DataFrame) -> DataFrame:
    """Of the lists' pairs each row's nearest one and that with the centre of its longest list."""
    trees = found.where("a is not null").select("a", "b", "d")
    nearest = _both_ways(trees).groupBy("row").agg(F.min(F.struct("d", "other")).alias("p")).select("row", "p.other")
    own = found.where("centre is not null").groupBy(F.col("member").alias("row"))
    centre = own.agg(F.min(F.struct("size", "away", "centre")).alias("p")).select("row", F.col("p.centre").alias("other"))
    return _pairs(nearest.unionByName(centre))


def _named(found: DataFrame, most: int) -> tuple[Stored, Stored]:
    """The ``most`` nearest partners of each member over all its lists, and the members that have more."""
    each = found.groupBy("a").agg(
        F.sort_array(F.collect_set(F.when(F.col("b").isNotNull(), F.struct("d", "b")))).alias("near"), F.bool_or(F.col("b").isNull()).alias("cut")
    )
    each = Stored(each, "named-partners")
    pairs = each.df.select(F.col("a").alias("row"), F.explode(F.slice("near", 1, most)).alias("p")).select("row", F.col("p.b").alias("other"))
    more = each.df.where(F.col("cut") | (F.size("near") > most)).select(F.col("a").alias("row"))
    return Stored(_pairs(pairs), "named-pairs"), Stored(more, "open-rows")


def _linked(found: Stored, entries: Stored, texts: DataFrame, width: int, similarity: float) -> Stored:
    """``node, root`` of the rows that true pairs link, from what the lists yield on."""
    plain = entries.df
    if "marks" not in plain.columns:
        plain = plain.withColumn("marks", F.lit(None).cast("binary"))
    tried: list[Stored] = []
    links: list[Stored] = []
    pairs, most, more = _first_pairs(found.df), PARTNERS, None
    while True:
        for earlier in tried:
            pairs = pairs.join(earlier.df, ["a", "b"], "left_anti")
        tried.append(Stored(pairs, f"pairs-{len(tried)}"))
        pairs = tried[-1].df
        wanted = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
        some = texts.join(maybe_broadcast(Stored(wanted, "candidate-rows")), "row", "left_semi")
        links.append(Stored(verified(pairs, some, width, similarity), f"similar-{len(links)}"))
        roots = Stored(components(union_stored(links), "similar"), "similar-roots")
        rooted = plain.join(roots.df.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
        whole = None
        if more is None:
            # lists whose trees lie within one part have no further pair to try
            ends = rooted.select(F.col("row").alias("node"), "root")
            apart = found.df.where("a is not null").select("a", "b").distinct()
            for end in ("a", "b"):
                apart = apart.join(ends.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end)
            apart = apart.where("a_root <> b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct()
            grouped = _groups(apart, rooted, texts)
            large = grouped.df.where(F.col("m") > GROUP_ROWS).select("row", "root", "group", "parts")
            whole = Stored(compared_whole(large, texts, width, similarity), "compared-whole")
            links.append(whole)
            few = Stored(grouped.df.where(F.col("m") <= GROUP_ROWS).select("row"), "few-rows")
            active = rooted.join(maybe_broadcast(few), "row", "left_semi")
        else:
            # a row that is not open has named all its partners, so untried pairs lie between open ones
            active = rooted.join(maybe_broadcast(more), "row", "left_semi")
        active = Stored(active, "open-entries")
        if active.is_empty():
            return roots if whole is None else Stored(components(union_stored(links), "similar"), "similar-roots")
        pairs, more = _named(candidates(active.df, most=most), most)
        pairs = pairs.df
        most *= PARTNERS


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents with one of each group of linked texts, all columns as they are."""
    mark = "__row"
    while mark in docs.columns:
        mark += "_"
    numbered = Stored(bound_batches(docs).withColumn(mark, F.monotonically_increasing_id()), "numbered")
    texts = numbered.df.select(F.col(mark).alias("row"), text_of("text").alias("text"))
    prints = Stored(two_fingerprints(texts, width), "two-fingerprints")
    least = [F.min_by(c, "row").alias(c) for c in ("bands", "marks")]
    entries = Stored(prints.df.groupBy("fp0", "fp1", "whole").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n"), *least), "fp-entries")
    shared = Stored(entries.df.where("n > 1").select("fp0", "fp1", "whole", F.col("row").alias("first")), "fp-shared")
    same = prints.df.join(maybe_broadcast(shared), ["fp0", "fp1", "whole"]).where("row <> first")
    near = candidates(entries.df)
    copies = same.select(F.col("first").alias("a"), F.col("row").alias("b"), F.lit(0).alias("d"))
    found = Stored(near.unionByName(copies, allowMissingColumns=True), "candidates")
    roots = _linked(found, entries, texts, width, similarity)
    ids = numbered.df.select(F.col(mark).alias("node"), "doc_id")
    grouped = roots.df.join(ids, "node")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")
    first = grouped.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.node").alias("node"))
    gone = roots.df.select("node").join(first, "node", "left_anti").withColumnRenamed("node", mark)
    return numbered.df.join(maybe_broadcast(Stored(gone, "gone")), mark, "left_anti").select(*docs.columns)
