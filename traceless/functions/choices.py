"""Exact selection among the few choices of one case, for use inside tasks.

A demand is a bit mask of the choices that meet it.  Callers reduce a case to its
different masks first, so a row holds a case whatever the number of its demands.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from heapq import heappop, heappush


def reduced(masks: Iterable[int]) -> list[int]:
    """Demands that are not met anyway when another one is, fewest choices first."""
    kept: list[int] = []
    for mask in sorted(set(masks), key=lambda m: (m.bit_count(), m)):
        if not any(other & mask == other for other in kept):
            kept.append(mask)
    return kept


def bits(mask: int) -> list[int]:
    return [i for i in range(mask.bit_length()) if mask >> i & 1]


def parts(masks: list[int]) -> list[list[int]]:
    """Groups of demands that share no choice with each other."""
    groups: list[tuple[int, list[int]]] = []
    for mask in masks:
        joined, members, rest = mask, [mask], []
        for union, group in groups:
            if union & joined:
                joined, members = joined | union, members + group
            else:
                rest.append((union, group))
        groups = [*rest, (joined, members)]
    return [sorted(group, key=lambda m: (m.bit_count(), m)) for _, group in groups]


class BudgetExceeded(Exception):
    """A search that took more nodes than it may."""


def cheapest(masks: Iterable[int], costs: Sequence[int], budget: int | None = None) -> list[int]:
    """Choices that meet every demand, least by (cost, size, numbers); empty masks are left out.

    With a ``budget`` a search that needs more nodes raises :class:`BudgetExceeded`.
    """
    found: list[int] = []
    for group in parts(reduced(m for m in masks if m)):
        found += _search(group, costs, budget)
    return sorted(found)


def _bound(open_masks: list[int], costs: Sequence[int]) -> tuple[int, int]:
    """Cost and size that demands without a common choice need at least."""
    used = cost = size = 0
    for mask in open_masks:
        if not mask & used:
            used |= mask
            cost += min(costs[i] for i in bits(mask))
            size += 1
    return cost, size


def _search(masks: list[int], costs: Sequence[int], budget: int | None = None) -> list[int]:
    best: tuple | None = None
    visited = 0

    def visit(taken: tuple[int, ...], cost: int, barred: int, open_masks: list[int]) -> None:
        nonlocal best, visited
        visited += 1
        if budget is not None and visited > budget:
            raise BudgetExceeded
        if not open_masks:
            key = (cost, len(taken), tuple(sorted(taken)))
            best = key if best is None or key < best else best
            return
        least, size = _bound(open_masks, costs)
        if best is not None and (cost + least, len(taken) + size) > best[:2]:
            return
        pick = min(open_masks, key=lambda m: (m & ~barred).bit_count())
        for i in sorted(bits(pick & ~barred), key=lambda i: (costs[i], i)):
            visit((*taken, i), cost + costs[i], barred, [m for m in open_masks if not m >> i & 1])
            barred |= 1 << i
            if any(not m & ~barred for m in open_masks):
                return

    visit((), 0, 0, masks)
    return list(best[2])


def all_smallest(masks: Iterable[int]) -> list[list[int]] | None:
    """Every smallest set that meets all demands; none if a demand can't be met."""
    demands = reduced(masks)
    if 0 in demands:
        return None
    ones = [1] * max((m.bit_length() for m in demands), default=0)
    size = len(cheapest(demands, ones))
    found: set[tuple[int, ...]] = set()

    def visit(taken: tuple[int, ...], barred: int, open_masks: list[int]) -> None:
        if not open_masks:
            if len(taken) == size:
                found.add(tuple(sorted(taken)))
            return
        if len(taken) + _bound(open_masks, ones)[1] > size:
            return
        for i in bits(open_masks[0] & ~barred):
            visit((*taken, i), barred, [m for m in open_masks if not m >> i & 1])
            barred |= 1 << i

    visit((), 0, demands)
    return [list(s) for s in sorted(found)]


def least_assignment(clauses: Iterable[tuple[int, int]], costs: Sequence[int], budget: int) -> tuple[list[int], str]:
    """Cheapest choices that satisfy every clause, least by (cost, size, numbers).

    A clause ``(add, drop)`` holds if a choice of ``add`` is taken or one of ``drop`` is
    not.  Returns the choices with OPTIMAL, no choices with INFEASIBLE, or, after
    ``budget`` nodes, the cheapest start of a set that is still open with LIMIT: its cost
    bounds that of every set from below.
    """
    rules = sorted(set(clauses), key=lambda c: (c[0].bit_count(), c))
    order = 0
    # best first, so that the first complete set is the least one
    queue: list[tuple] = [((0, 0, ()), order, 0, 0)]
    weight = [(costs[i], 1) for i in range(len(costs))]
    while queue:
        if order > budget:
            return list(queue[0][0][2]), "LIMIT"
        (cost, size, numbers), _, taken, barred = heappop(queue)
        broken = [add for add, drop in rules if not add & taken and drop & ~taken == 0]
        if not broken:
            return list(numbers), "OPTIMAL"
        pick = min(broken, key=lambda m: (m & ~barred).bit_count())
        for i in bits(pick & ~barred):
            more, one = weight[i]
            order += 1
            key = (cost + more, size + one, tuple(sorted((*numbers, i))))
            heappush(queue, (key, order, taken | 1 << i, barred))
            barred |= 1 << i
    return [], "INFEASIBLE"
