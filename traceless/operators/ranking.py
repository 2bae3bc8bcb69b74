"""Ranks and running sums that never put a whole group or table in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceless.plans.workspace import Stored


def _ranged(df: DataFrame, keys: list[str], order: list, label: str) -> DataFrame:
    """Range-partition by (keys, order) and write the result with its slice number."""
    columns = [F.col(c) if isinstance(c, str) else c for c in [*keys, *order]]
    split = df.repartitionByRange(*columns).withColumn("slice", F.spark_partition_id())
    return Stored(split, label).df


def group_rank(df: DataFrame, keys: list[str], order: list, name: str = "position") -> DataFrame:
    """1-based row number per group.

    Rows are range-partitioned on group and order, numbered inside each slice,
    and shifted by the row counts of the group's earlier slices; a group that
    holds a large share of the table is spread over many slices.
    """
    slices = _ranged(df, keys, order, "rank")
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    inner = Window.partitionBy(*keys, "slice").orderBy(*columns)
    numbered = slices.withColumn(name, F.row_number().over(inner).cast("long"))
    return _shift(slices, numbered, keys, {name: F.count(F.lit(1))})


def running_sum(
    df: DataFrame, keys: list[str], order: list, values: dict[str, str]
) -> DataFrame:
    """Inclusive running sums per group; ``values`` maps result names to columns."""
    slices = _ranged(df, keys, order, "running")
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    inner = (
        Window.partitionBy(*keys, "slice")
        .orderBy(*columns)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = slices.withColumns({name: F.sum(c).over(inner) for name, c in values.items()})
    return _shift(slices, summed, keys, {name: F.sum(c) for name, c in values.items()})


def exact_percentile(df: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """``(*keys, name)``: the percentile that ``F.percentile`` gives, without a buffer per group.

    Values are ranked in range slices, so a group of any size is spread over many tasks; the
    two values around the wanted place are kept.  Null values don't count, a group without
    values has a null, and no keys means one row for the table.
    """
    by = ["of"] if keys else []
    group = [F.struct(*keys).alias("of")] if keys else []  # equal where keys are null, too
    rows = Stored(df.select(*group, F.col(value).cast("double").alias("v")), "percentile")
    counts = Stored(rows.df.groupBy(*by).agg(F.count("v").alias("n")), "percentile-counts")
    place = (F.col("n") - 1) * F.lit(share)
    wanted = counts.df.where("n > 0").select(*by, place.alias("place"))
    ranked = group_rank(rows.df.where(F.col("v").isNotNull()), by, ["v"], "position").withColumn("at", F.col("position") - 1)
    placed = ranked.join(wanted, by) if keys else ranked.crossJoin(F.broadcast(wanted))
    first, last = (F.col("at") == step("place") for step in (F.floor, F.ceil))
    found = placed.where(first | last).groupBy(*by, "place").agg(
        F.min(F.when(first, F.col("v"))).alias("low"), F.max(F.when(last, F.col("v"))).alias("high")
    )
    between = (F.ceil("place") - F.col("place")) * F.col("low") + (F.col("place") - F.floor("place")) * F.col("high")
    result = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between).alias(name)
    empty = counts.df.where("n = 0").select(*by, F.lit(None).cast("double").alias(name))
    columns = [*(f"of.{k}" for k in keys), name]
    return found.select(*by, result).unionByName(empty).select(*columns)


def _shift(slices: DataFrame, numbered: DataFrame, keys: list[str], totals: dict) -> DataFrame:
    """Add the totals of a group's earlier slices to the in-slice values."""
    per_slice = slices.groupBy(*keys, "slice").agg(
        *[total.alias(f"before_{name}") for name, total in totals.items()]
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_slice.withColumns(
        {
            f"before_{name}": F.coalesce(F.sum(f"before_{name}").over(earlier), F.lit(0))
            for name in totals
        }
    )
    joined = numbered.join(offsets, [*keys, "slice"])
    shifted = joined.withColumns({name: F.col(name) + F.col(f"before_{name}") for name in totals})
    return shifted.drop("slice", *[f"before_{name}" for name in totals])
