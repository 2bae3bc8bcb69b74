"""Pairs drawn from all combinations of an identity."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from traceless.operators import sampling as W


def test_ranks_are_pairs(spark):
    first, second = W._unranked(F.col("id"))
    rows = spark.range(5000).select(first.alias("i"), second.alias("j")).collect()
    assert [(r.i, r.j) for r in rows] == sorted(combinations(range(101), 2), key=lambda p: (p[1], p[0]))[:5000]


def test_sampled_pairs(spark):
    sizes = {"a": 40, "b": 3, "c": 1, "d": 9, None: 5}
    rows = [(label, [float(k), 1.0]) for label, n in sizes.items() for k in range(n)]
    rows = [(k, *r) for k, r in enumerate(rows)]
    frame = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").repartition(3)
    labels, every = {r[0]: r[1] for r in rows}, 40 * 39 // 2 + 3 + 36
    for wanted in (60, every, every + 50):
        got = W.sample_pairs(frame, "vec_id", "label", "embedding", wanted, 4).collect()
        same = {frozenset((r.left_id, r.right_id)) for r in got if r.is_member}
        other = [r for r in got if not r.is_member]
        assert len(same) == sum(r.is_member for r in got) == len(other) == min(wanted, every)
        assert all(len({labels[v] for v in pair}) == 1 and len(pair) == 2 for pair in same)
        assert all(labels[r.left_id] != labels[r.right_id] and None not in (labels[r.left_id], labels[r.right_id]) for r in other)
        vectors = {r[0]: r[2] for r in rows}
        assert all(r.score == sum(x * y for x, y in zip(vectors[r.left_id], vectors[r.right_id])) for r in got)
    alone = frame.where("label = 'b'")
    assert [r.is_member for r in W.sample_pairs(alone, "vec_id", "label", "embedding", 10, 4).collect()] == [True] * 3
    assert W.sample_pairs(frame.where("label = 'c'"), "vec_id", "label", "embedding", 10, 4).count() == 0
