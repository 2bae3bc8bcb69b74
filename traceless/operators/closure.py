"""Level-by-level graph expansion with hot sources split over several tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceless.plans.workspace import Stored, shuffled, union_stored

HOT_ROWS = 200_000
SALTS = 32


class Adjacency:
    """Written edges; every hot key's edges are spread over ``SALTS`` tasks.

    A key is hot when it owns more than ``hot_rows`` edges, so there are at most
    ``len(edges) / hot_rows`` hot keys.  Without hot keys no salt is used.
    """

    def __init__(self, edges: DataFrame, keys: list[str], payload: str, hot_rows: int = HOT_ROWS):
        self.keys = keys
        plain = Stored(edges, "edges")
        counts = plain.df.groupBy(*keys).count()
        self.hot = None
        if not counts.where(F.col("count") > hot_rows).isEmpty():
            hot = counts.where(F.col("count") > hot_rows).select(*keys)
            self.hot = Stored(hot, "hot-keys").df.withColumn("is_hot", F.lit(True))
        if self.hot is None:
            self.edges = plain.df
            return
        salt = F.when(F.col("is_hot"), F.pmod(F.xxhash64(payload), F.lit(SALTS))).otherwise(0)
        marked = plain.df.join(self.hot, keys, "left").withColumn("salt", salt.cast("int"))
        self.edges = Stored(marked.drop("is_hot"), "salted-edges").df

    def join(self, frontier: DataFrame) -> DataFrame:
        """Frontier rows with their outgoing edges (equi-join on the edge keys)."""
        if self.hot is None:
            return frontier.join(self.edges, self.keys)
        salts = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(
            F.array(F.lit(0))
        )
        copies = frontier.join(self.hot, self.keys, "left").withColumn("salt", F.explode(salts))
        return copies.drop("is_hot").join(self.edges, [*self.keys, "salt"]).drop("salt")


def levels(
    seed: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    keys: list[str],
    label: str,
    max_rounds: int | None = None,
    grows: str = "true",
) -> list[Stored]:
    """Breadth-first levels: ``step`` proposes rows, known ``keys`` are dropped.

    ``step`` must return one row per key.  The loop ends with the first empty
    level, or with one without rows that meet the condition ``grows``; every level
    is a written table.
    """
    found = [Stored(seed, f"{label}-0")]
    while max_rounds is None or len(found) <= max_rounds:
        if found[-1].df.where(grows).isEmpty():
            break
        known = union_stored(found).select(*keys)
        level = Stored(
            step(found[-1].df).join(shuffled(known), keys, "left_anti"), f"{label}-{len(found)}"
        )
        if level.is_empty():
            break
        found.append(level)
    return found
