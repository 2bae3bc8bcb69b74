"""Approximate nearest neighbours by cross-polytope hashing.

A vector is turned by fast pseudo-rotations (sign flips and Hadamard transforms)
and hashed to its nearest signed axis, ``parts`` times per table; several tables
hold every vector.  A query probes the buckets of its own axes and of the next
nearest ones, and all vectors found there are ranked by their exact cosine in
double precision.  Work meets per bucket: queries and members of a bucket form
one matrix product, and only the best of each query leave the task.  A query that met fewer
than ``k`` others is compared with all entries, block by block.

Equal vectors are one entry with the smallest ids that can matter, so a vector
that a third of the rows share costs one entry.  Buckets with more than
``MEMBER_ROWS`` entries are split, with the queries sent to all parts, and so are
buckets with more than ``QUERY_ROWS`` queries.

Defined cases: rows with a null id, and vectors that are null, empty, zero or
hold a null or non-finite component, take no part; vectors of different length
are never compared; rows that repeat an id and its vector count once, and no row
with the query's own id is its neighbour; equal cosines go by the smaller id; a query
with fewer than ``k`` candidates has all of them; components of any finite size are
compared without overflow; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceless.llm.shared import attach, bound_batches, maybe_broadcast
from traceless.operators.ranking import group_rank
from traceless.plans.workspace import Stored

TABLES = 12
#: Share of a table's buckets that a query probes, by the number of hash parts: finer buckets
#: are probed in a better order, so a smaller share finds as many of the nearest.
PROBED = (1 / 16, 1 / 40, 1 / 80)
MEMBER_ROWS = 8192
#: Queries of a bucket that meet its members in one task.
QUERY_ROWS = 2048
#: Entries per bucket beyond which a further hash part is used.
BUCKET_ROWS = 16_384
SEED = 5


def rotations(size: int, count: int, seed: int) -> np.ndarray:
    """Signs of ``count`` pseudo-rotations of three rounds each."""
    return np.random.default_rng(seed).integers(0, 2, (count, 3, size)) * 2.0 - 1.0


def rotate(vectors: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of sign flips and a normalised Hadamard transform."""
    turned = vectors
    for round_signs in signs:
        turned = turned * round_signs
        step, size = 1, turned.shape[1]
        while step < size:
            halves = turned.reshape(len(turned), -1, 2, step)
            turned = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2).reshape(len(turned), size)
            step *= 2
        turned = turned / math.sqrt(size)
    return turned


class Hasher:
    """Buckets of unit vectors of one length."""

    def __init__(self, length: int, tables: int, parts: int, seed: int) -> None:
        self.size = 1 << max(1, (length - 1).bit_length())
        self.tables, self.parts = tables, parts
        self.signs = rotations(self.size, tables * parts, seed).reshape(tables, parts, 3, self.size)

    def axes(self, vectors: np.ndarray, table: int, part: int) -> np.ndarray:
        """Closeness to the ``2 * size`` signed axes."""
        padded = np.zeros((len(vectors), self.size))
        padded[:, : vectors.shape[1]] = vectors
        turned = rotate(padded, self.signs[table, part])
        return np.concatenate([turned, -turned], axis=1)

    def buckets(self, vectors: np.ndarray, table: int, probes: int = 1) -> np.ndarray:
        """The ``probes`` best buckets per vector; of one, the own one."""
        best = np.zeros((len(vectors), 1))
        number = np.zeros((len(vectors), 1), np.int64)
        for part in range(self.parts):
            near = self.axes(vectors, table, part)
            width = min(probes, near.shape[1])
            top = np.argsort(-near, axis=1, kind="stable")[:, :width]
            gain = np.take_along_axis(near, top, 1)
            best = (best[:, :, None] + gain[:, None, :]).reshape(len(vectors), -1)
            number = (number[:, :, None] * near.shape[1] + top[:, None, :]).reshape(len(vectors), -1)
            if probes == 1:
                keep = best.argmax(axis=1)[:, None]
            elif best.shape[1] > probes:
                keep = np.argpartition(-best, probes - 1, axis=1)[:, :probes]
            else:
                keep = np.argsort(-best, axis=1, kind="stable")
            best, number = np.take_along_axis(best, keep, 1), np.take_along_axis(number, keep, 1)
        return number


def valid(rows: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(vector, lambda x: x == 0)
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null")
    return kept.where(F.coalesce((F.size(vector) > 0) & ~bad & ~zero, F.lit(False)))


def _entries(rows: DataFrame, k: int) -> tuple[Stored, Stored]:
    """Ids with their vector's key, and one entry per different vector with its ``k`` smallest ids."""
    text = F.array_join(F.transform("embedding", lambda x: x.cast("string")), ",")
    keyed = valid(bound_batches(rows)).withColumn("vkey", F.sha2(text, 256))
    stored = Stored(keyed, "vectors")
    ids = Stored(stored.df.select("vkey", "vec_id").distinct(), "vector-ids")
    counts = Stored(ids.df.groupBy("vkey").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n")), "vector-counts")
    many = Stored(counts.df.where("n > 1").select("vkey"), "shared-vectors")
    again = ids.df.join(maybe_broadcast(many), "vkey", "left_semi")
    ranked = group_rank(again, ["vkey"], ["vec_id"]).where(F.col("position") <= k)
    lists = ranked.groupBy("vkey").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    one = counts.df.where("n = 1").select("vkey", F.array("first").alias("ids"))
    vectors = stored.df.groupBy("vkey").agg(F.first("embedding").alias("embedding"))
    return ids, Stored(vectors.join(one.unionByName(lists), "vkey"), "entries")


def _vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(row numbers, matrix)`` for each vector length in a list column."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    found = []
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        found.append((at, flat[starts[at][:, None] + np.arange(size)]))
    return found


def _tamed(matrix: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, which changes no cosine and lets no square overflow."""
    return np.ldexp(matrix, -np.frexp(np.abs(matrix).max(axis=1, keepdims=True))[1])


def _unit(matrix: np.ndarray) -> np.ndarray:
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _posted(entries: DataFrame, columns: str, tables: int, parts: int, probed: float, seed: int) -> DataFrame:
    """Entries once per table and probed bucket: ``dim, place, bucket`` and their columns."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, matrix in _vectors(batch.column("embedding")):
                hasher = Hasher(matrix.shape[1], tables, parts, seed)
                probes = max(1, math.ceil((2 * hasher.size) ** parts * probed)) if probed else 1
                unit = _unit(matrix)
                for table in range(tables):
                    buckets = hasher.buckets(unit, table, probes)
                    rows = pa.array(np.repeat(at, buckets.shape[1]))
                    n = len(rows)
                    head = [pa.array(np.full(n, matrix.shape[1], np.int32)), pa.array(np.full(n, table, np.int32)), pa.array(buckets.ravel())]
                    yield pa.RecordBatch.from_arrays([*head, *[batch.column(c).take(rows) for c in names]], ["dim", "place", "bucket", *names])

    return entries.select(*names).mapInArrow(run, f"dim int, place int, bucket bigint, {columns}")


def _best(k: int):
    """The ``k`` nearest members per query of one bucket part."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["qkey", "vkey", "ids", "score"]
        schema = pa.schema([("qkey", pa.string()), ("vkey", pa.string()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        q = _tamed(_vectors(left.column("embedding").combine_chunks())[0][1])
        x = _tamed(_vectors(right.column("embedding").combine_chunks())[0][1])
        ids = right.column("ids").combine_chunks()
        first = np.array([i[0].as_py() for i in ids], np.int64)
        unit = _unit(x).T
        rows, cols, scores = [], [], []
        q_norm, x_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
        for a in range(0, len(q), 256):
            near = _unit(q[a : a + 256]) @ unit
            floor = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -2.0)
            for i, col in enumerate(near >= (floor - 1e-9)[:, None]):
                col = np.flatnonzero(col)
                exact = (q[a + i] * x[col]).sum(axis=1) / (q_norm[a + i] * x_norm[col])
                chosen = np.lexsort((first[col], -exact))[:k]
                rows.extend([a + i] * len(chosen))
                cols.extend(col[chosen].tolist())
                scores.extend(exact[chosen].tolist())
        columns = [left.column("vkey").take(pa.array(rows)), right.column("vkey").take(pa.array(cols)), ids.take(pa.array(cols)), pa.array(scores)]
        return pa.table(columns, names).cast(schema)

    return run


def _met(members: DataFrame, probes: DataFrame, k: int, label: str) -> Stored:
    """``qkey, vkey, ids, score`` of each query's ``k`` nearest among the members of its buckets.

    Buckets with many members or queries are split both ways, so no task holds one whole.
    """
    place = ["dim", "place", "bucket"]

    def sized(frame: DataFrame, rows: int, name: str) -> DataFrame:
        return frame.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias(name))

    sizes = sized(members, MEMBER_ROWS, "n_parts").join(sized(probes, QUERY_ROWS, "n_sets"), place)
    sizes = Stored(sizes, "bucket-sizes")

    def dealt(frame: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        mine = F.pmod(F.xxhash64("vkey"), F.col(own)).cast("int").alias(names[0])
        met = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(names[1])
        return frame.join(maybe_broadcast(sizes), place).select("*", mine).select("*", met)

    group = [*place, "part", "set"]
    left = dealt(probes, "n_sets", "n_parts", ("set", "part"))
    right = dealt(members, "n_parts", "n_sets", ("part", "set"))
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(
        _best(k), "qkey string, vkey string, ids array<bigint>, score double"
    )
    once = found.groupBy("qkey", "vkey").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    order = [F.col("score").desc(), F.col("ids")[0]]
    # a query has at most k rows per table, probe and bucket part
    best = once.withColumn("nth", F.row_number().over(Window.partitionBy("qkey").orderBy(*order)))
    return Stored(best.where(F.col("nth") <= k).drop("nth"), label)


def nearest(
    rows: DataFrame, queries, k: int = 5, tables: int = TABLES, probed: float | None = None, parts: int | None = None, seed: int = SEED
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest rows found for each query row.

    ``queries`` is a condition on ``vec_id``.  ``parts`` follows from the number of
    vectors, so that a bucket's expected size stays bounded.
    """
    ids, entries = _entries(rows, k + 1)
    total = entries.df.count()
    if parts is None:
        width = 2 * (entries.df.agg(F.max(F.size("embedding"))).first()[0] or 1)
        parts = min(len(PROBED), 1 + max(0, math.ceil(math.log(max(1, total) / BUCKET_ROWS, width) - 1)))
    share = PROBED[min(parts, len(PROBED)) - 1] if probed is None else probed
    query_ids = Stored(ids.df.where(queries).withColumnRenamed("vec_id", "query_id"), "query-ids")
    wanted = entries.df.join(query_ids.df.select("vkey").distinct(), "vkey", "left_semi")
    kind = entries.df.schema["embedding"].dataType.simpleString()
    columns = f"vkey string, ids array<bigint>, embedding {kind}"
    members = _posted(entries.df, columns, tables, parts, 0, seed)
    probes = _posted(wanted, f"vkey string, embedding {kind}", tables, parts, share, seed)
    best = _met(members, probes, k + 1, "met")
    # a query that met too few others is compared with all entries, block by block
    others = F.filter(F.flatten(F.collect_list("ids")), lambda i: i != F.col("query_id"))
    counted = query_ids.df.join(best.df.select("qkey", "ids"), F.col("vkey") == F.col("qkey"), "left").groupBy("vkey", "query_id").agg(others.alias("others"))
    short = Stored(counted.where(F.size(F.coalesce("others", F.array())) < k).select("vkey").distinct(), "short-queries")
    if not short.is_empty():
        blocks = max(1, math.ceil(total / MEMBER_ROWS))
        own = F.pmod(F.xxhash64("vkey"), F.lit(blocks)).cast("bigint")
        head = [F.size("embedding").alias("dim"), F.lit(-1).alias("place")]
        every = entries.df.select(*head, own.alias("bucket"), "vkey", "ids", "embedding")
        again = wanted.join(maybe_broadcast(short), "vkey", "left_semi")
        to_all = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("bucket")
        exact = _met(every, again.select(*head, to_all, "vkey", "embedding"), k + 1, "met-exactly")
        kept = best.df.join(maybe_broadcast(short).withColumnRenamed("vkey", "qkey"), "qkey", "left_anti")
        best = Stored(kept.unionByName(exact.df), "met-all")
    expanded = best.df.select(F.col("qkey").alias("vkey"), F.explode("ids").alias("vec_id"), "score")
    first = Window.partitionBy("vkey").orderBy(F.col("score").desc(), "vec_id")
    listed = expanded.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    found = listed.groupBy("vkey").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("found"))
    sized = query_ids.df.groupBy("vkey").agg(F.count(F.lit(1)).alias("n_queries"))
    answers = Stored(found.join(sized, "vkey"), "answers")
    joined = attach(query_ids, answers, ["vkey"], "n_queries")
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    result = joined.select("query_id", F.posexplode(others).alias("rank", "hit"))
    return result.select("query_id", (F.col("rank") + 1).alias("rank"), "hit.vec_id", "hit.score")
