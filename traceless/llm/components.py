"""Connected components by contraction: every round shrinks the graph by a constant factor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceless.plans.workspace import Stored


def components(edges: DataFrame, label: str = "component") -> DataFrame:
    """``node, root`` for every node that has an edge ``(a, b)``; equal roots mean connected.

    In each round a node joins the neighbour (or itself) with the smallest hash
    of this round, edges move to the chosen nodes, and loops go.  The hash
    changes with the round, so long chains shrink as fast as stars do.  Nodes
    with many edges are reduced before the shuffle by partial minima.
    """
    rest = Stored(_both_ways(edges), f"{label}-edges")
    moves: list[Stored] = []
    while not rest.is_empty():
        rank = F.xxhash64(F.lit(len(moves)), "b")
        chosen = rest.df.groupBy("a").agg(F.min(F.struct(rank.alias("h"), "b")).alias("best"))
        own = F.struct(F.xxhash64(F.lit(len(moves)), "a").alias("h"), F.col("a").alias("b"))
        move = chosen.select(F.col("a").alias("node"), F.least("best", own)["b"].alias("root"))
        moves.append(Stored(move, f"{label}-moves"))
        left = moves[-1].df.toDF("a", "a_root")
        right = moves[-1].df.toDF("b", "b_root")
        moved = rest.df.join(left, "a").join(right, "b").select(
            F.col("a_root").alias("a"), F.col("b_root").alias("b")
        )
        rest = Stored(moved.where("a <> b").distinct(), f"{label}-edges")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    found = moves[0].df
    for move in moves[1:]:
        step = move.df.toDF("root", "next")
        found = found.join(step, "root", "left").select(
            "node", F.coalesce("next", "root").alias("root")
        )
    return found


def _both_ways(edges: DataFrame) -> DataFrame:
    there = edges.select("a", "b")
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return there.unionByName(back).where("a <> b").distinct()
