"""Arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def unit(values: Column) -> Column:
    """The vector divided by its length (at least 1e-12)."""
    length = F.greatest(F.sqrt(dot(values, values)), F.lit(1e-12))
    return F.transform(values, lambda x: x / length)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def component_sums(values: Column, width: int) -> list[Column]:
    """Aggregates that add the vectors of a group, one per component."""
    return [F.sum(F.element_at(values, i + 1)).alias(f"s{i}") for i in range(width)]


def as_vector(width: int) -> Column:
    return F.array(*[F.col(f"s{i}") for i in range(width)])
