"""Subsets of a few choices packed into the bits of a long.

A *block* holds 64 subsets.  Subset number ``m`` of a case sits in block
``m div 64`` at bit ``m % 64``; a label column then says for all 64 subsets at
once whether a fact holds, and boolean algebra on labels is bitwise arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALL = -1
BLOCK_BITS = 6


def _pattern(index: int) -> int:
    value = sum(1 << m for m in range(64) if m >> index & 1)
    return value - (1 << 64) if value >= 1 << 63 else value


def shift_right(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits.cast("int"))


def shift_left(value: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", value, bits.cast("int"))


def membership(index: Column, block: Column) -> Column:
    """Label of the subsets that contain choice ``index``."""
    inside = F.element_at(
        F.array(*[F.lit(_pattern(i)) for i in range(BLOCK_BITS)]), index.cast("int") + 1
    )
    high = F.when(
        shift_right(block, F.greatest(index - BLOCK_BITS, F.lit(0))).bitwiseAND(1) == 1, F.lit(ALL)
    ).otherwise(F.lit(0))
    return F.when(index < BLOCK_BITS, inside).otherwise(high).cast("long")


def blocks(choices: Column) -> Column:
    """Array of block numbers for ``choices`` choices."""
    extra = F.greatest(choices - BLOCK_BITS, F.lit(0)).cast("int")
    return F.sequence(F.lit(0).cast("long"), shift_left(F.lit(1).cast("long"), extra) - 1)


def subsets_in_block(choices: Column) -> Column:
    """Array of bit positions in use per block."""
    used = F.least(choices, F.lit(BLOCK_BITS)).cast("int")
    return F.sequence(F.lit(0), (shift_left(F.lit(1), used) - 1).cast("int"))


def has(label: Column, bit: Column) -> Column:
    return F.getbit(label, bit) == 1


def both(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def either(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def without(a: Column, b: Column) -> Column:
    return a.bitwiseAND(F.bitwise_not(b))


def chosen(ids: Column, mask: Column) -> Column:
    """Entries of a short id array whose position is set in ``mask``."""
    return F.filter(ids, lambda x, i: shift_right(mask, i).bitwiseAND(1) == 1)


def subset_key(costs: Column, mask: Column, limit: int) -> list[Column]:
    """Long columns that order subsets by (cost, size, ids) and end with the mask.

    Ids are numbered in sorted order, so among equally large subsets the one
    with the smaller id sequence has the larger mirrored mask.
    """
    zero = F.lit(0).cast("long")
    taken = [shift_right(mask, F.lit(i)).bitwiseAND(1) for i in range(limit)]
    cost, mirrored = zero, zero
    for i, bit in enumerate(taken):
        cost = cost + F.coalesce(F.get(costs, F.lit(i)), zero) * bit
        mirrored = mirrored + bit * (1 << (limit - 1 - i))
    return [
        cost.alias("total_cost"),
        F.bit_count(mask).cast("long").alias("size"),
        (-mirrored).alias("order"),
        mask.cast("long").alias("mask"),
    ]
