"""Scalar statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054  # fixed value: two-sided 95 % normal quantile


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null for a zero denominator."""
    return F.when(denominator != 0, numerator.cast("double") / denominator)


def wilson95(successes: Column, trials: Column) -> Column:
    """Struct ``(low, high)`` of the Wilson score interval; null without trials."""
    n = trials.cast("double")
    p = successes / n
    scale = 1 + Z95 * Z95 / n
    centre = (p + Z95 * Z95 / (2 * n)) / scale
    spread = Z95 * F.sqrt(p * (1 - p) / n + Z95 * Z95 / (4 * n * n)) / scale
    interval = F.struct(
        F.greatest(F.lit(0.0), centre - spread).alias("low"),
        F.least(F.lit(1.0), centre + spread).alias("high"),
    )
    return F.when(trials > 0, interval)


_PRIME = 2147483647


def mix(*parts: Column) -> Column:
    """Integer columns folded into one residue, in 64-bit arithmetic."""
    state = F.lit(20011).cast("long")
    for part in parts:
        state = F.pmod(state * 48271 + F.pmod(part.cast("long"), F.lit(_PRIME)) * 69621, F.lit(_PRIME))
    return state


def scramble(state: Column) -> Column:
    return F.pmod(state * state + 12345, F.lit(_PRIME))


def draw(*parts: Column) -> Column:
    """Deterministic integer in [0, 1 000 000) from integer columns."""
    return F.pmod(scramble(scramble(mix(*parts))), F.lit(1_000_000))


# Poisson(1) distribution function times one million.
_POISSON_STEPS = (367879, 735759, 919699, 981012, 996340, 999406, 999917, 999990)


def poisson_weight(uniform: Column) -> Column:
    """Poisson(1) resampling weight of a draw in [0, 1 000 000)."""
    steps = F.lit(0)
    for bound in _POISSON_STEPS:
        steps = steps + F.when(uniform >= bound, 1).otherwise(0)
    return steps.cast("long")


def nearest_rank(values: Column, probability: float) -> Column:
    """Entry of the sorted array at the half-even rounded index ``(n-1)*p``."""
    index = F.bround((F.size(values) - 1) * F.lit(probability), 0).cast("int")
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), index + 1))


def linear_quantile(values: Column, probability: float) -> Column:
    """Linearly interpolated quantile of an array."""
    ordered = F.array_sort(values)
    place = (F.size(values) - 1) * F.lit(probability)
    low = F.floor(place).cast("int")
    high = F.ceil(place).cast("int")
    lower, upper = F.element_at(ordered, low + 1), F.element_at(ordered, high + 1)
    return F.when(F.size(values) > 0, lower + (upper - lower) * (place - low))
