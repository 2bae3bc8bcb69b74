"""Helpers of several operators: text columns, hot-group joins, batches of texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceless.plans.workspace import Stored

#: Largest frame, in bytes of its files, that is broadcast.
BROADCAST_BYTES = 32 << 20
#: Text bytes handled at once inside a task.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch between the JVM and a task's Python.
BATCH_BYTES = 8 << 20

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def text_of(column: str | Column) -> Column:
    """The column as text, null as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(frame: Stored) -> bool:
    """Whether a written frame may be broadcast."""
    return frame.size_in_bytes() <= BROADCAST_BYTES


def bound_batches(df: DataFrame) -> DataFrame:
    """The frame; its session sends Arrow batches of ``BATCH_BYTES`` at most, a longer row alone.

    Without this a batch has ten thousand rows, however long they are.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    plain = conf.get(name).rstrip("bB")  # Spark writes its default with a unit
    if not plain.isdigit() or int(plain) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def maybe_broadcast(frame: Stored) -> DataFrame:
    """The written frame, marked for broadcast only if its files are small."""
    return F.broadcast(frame.df) if small(frame) else frame.df


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def attach(rows: Stored, groups: Stored, keys: list[str], size: str) -> DataFrame:
    """Inner join of rows with their group's columns, safe for groups of any size.

    A group is hot when its ``size`` exceeds a fair share of the rows, so there
    are fewer hot groups than shuffle partitions and they may be broadcast; the
    others are joined by a shuffle that no group can dominate.
    """
    spark = rows.spark
    fair = max(1, rows.df.count() // partitions(spark))
    if small(groups):
        return rows.df.join(F.broadcast(groups.df), keys)
    hot = F.broadcast(groups.df.where(F.col(size) > fair))
    cold = groups.df.where(F.col(size) <= fair)
    rest = rows.df.join(hot.select(*keys), keys, "left_anti")
    return rows.df.join(hot, keys).unionByName(rest.join(cold, keys))


def attach_left(rows: DataFrame, groups: Stored, keys: list[str], size: str) -> DataFrame:
    """Left join of rows with the groups that some of them have, safe for groups of any size."""
    if small(groups):
        return rows.join(F.broadcast(groups.df), keys, "left")
    fair = max(1, rows.count() // partitions(groups.spark))
    hot = F.broadcast(groups.df.where(F.col(size) > fair))
    rest = rows.join(F.broadcast(groups.df.where(F.col(size) > fair).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(groups.df.where(F.col(size) <= fair), keys, "left"))


def slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the texts of ``column`` stay near ``limit`` bytes.

    A single longer text forms a slice of its own.
    """
    for batch in batches:
        start = used = 0
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        for row, length in enumerate(sizes):
            if used and used + (length or 0) > limit:
                yield batch.slice(start, row - start)
                start, used = row, 0
            used += length or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)
