from __future__ import annotations

import hashlib
import random
from itertools import groupby

import numpy as np
import pytest

from traceless.operators import discovery as D
from traceless.operators import influence as M
from traceless.operators import ledger as H
from traceless.operators import passages as P
from traceless.operators import stores as X
from traceless.operators.ranking import exact_percentile, group_rank, running_sum
from traceless.sources import documents as S


def test_rank_and_running_sum_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randint(0, 5)}", i, rng.randint(0, 9)) for i in range(4000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o long, v long")
    ranks = {(r.g, r.o): r.position for r in group_rank(df, ["g"], ["o"]).collect()}
    sums = {(r.g, r.o): r.s for r in running_sum(df, ["g"], ["o"], {"s": "v"}).collect()}
    for g, part in groupby(sorted(rows), key=lambda r: r[0]):
        total = 0
        for place, (_, o, v) in enumerate(part, start=1):
            total += v
            assert ranks[(g, o)] == place and sums[(g, o)] == total


def test_ordered_digest_folds_large_groups(spark, monkeypatch):
    monkeypatch.setattr(H, "FAN", 4)
    rows = [(g, i, f"d{g}{i}") for g, n in (("a", 3), ("b", 21)) for i in range(n)]
    got = {r.g: r.root for r in H.ordered_digest(spark.createDataFrame(rows, "g string, o long, d string"), ["g"], ["o"], "d").collect()}
    for g in "ab":
        level = [d for x, _, d in rows if x == g]
        while True:
            level = [hashlib.sha256(",".join(level[i : i + 4]).encode()).hexdigest() for i in range(0, len(level), 4)]
            if len(level) == 1:
                break
        assert got[g] == "sha256:" + level[0]


def test_flat_digest_hashes_large_groups_as_one_text(spark, monkeypatch):
    monkeypatch.setattr(H, "FAN", 4)
    sizes = [("a", 3), ("b", 2100), (None, 9)]
    rows = [(g, i, None if i == 5 else hashlib.sha256(f"{g}{i}".encode()).hexdigest()) for g, n in sizes for i in range(n)]
    rows += [("empty", i, None) for i in range(9)] + [("none", 0, None)]
    got = {r.g: r.root for r in H.ordered_digest(spark.createDataFrame(rows, "g string, o long, d string").repartition(5), ["g"], ["o"], "d", flat=True).collect()}
    for g, _ in sizes:
        text = ",".join(d for x, _, d in rows if x == g and d is not None)
        assert got[g] == "sha256:" + hashlib.sha256(text.encode()).hexdigest()
    assert got["empty"] is None and got["none"] is None and len(got) == 5


def test_small_groups_of_commitments_take_one_shuffle(spark, monkeypatch):
    written = []
    kept = H.Stored
    monkeypatch.setattr(H, "Stored", lambda df, label: written.append(label) or kept(df, label))
    rows = [(g, i, "sha256:" + hashlib.sha256(f"{g}{i}".encode()).hexdigest()) for g in "ab" for i in range(30)]
    got = {r.g: r.root for r in H.ordered_digest(spark.createDataFrame(rows, "g string, o long, d string"), ["g"], ["o"], "d").collect()}
    for g in "ab":
        assert got[g] == "sha256:" + hashlib.sha256(",".join(d for x, _, d in rows if x == g).encode()).hexdigest()
    assert written == ["digest-large", "digest-roots"]  # no table of the rows themselves


def test_corpus_scan_finds_every_containment(spark):
    rng = random.Random(5)
    words = ["ab", "cd", "ef", "gh", "ij", "kl"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(120)]
    passages = [(i, docs[rng.randrange(120)][1][rng.randint(0, 5) : rng.randint(8, 90)]) for i in range(60)]
    got = {
        (r.passage_id, r.doc_id)
        for r in X.scan_corpus_text(
            spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "passage_id long, passage string")
        ).collect()
    }
    assert got == {(p, d) for p, s in passages if s for d, t in docs if s in t}


@pytest.mark.parametrize("limit", [1 << 25, -1])
def test_corpus_scan_of_short_passages(spark, monkeypatch, limit):
    """Byte grams find passages of any length, with broadcasts and with shuffles and shards."""
    monkeypatch.setattr(P, "BROADCAST_BYTES", limit)
    rng = random.Random(6)
    letters = "ab\u00e9\u4e16 \n"
    docs = [(i, "".join(rng.choices(letters, k=rng.randint(0, 40)))) for i in range(80)] + [(90, None), (91, ""), (92, "ab" * 3000)]
    passages = [(i, "".join(rng.choices(letters, k=rng.randint(1, 12)))) for i in range(40)] + [(98, None), (99, ""), (97, "ba" * 9)]
    frames = [spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(passages, "passage_id long, passage string")]
    got = [tuple(r) for r in X.scan_corpus_text(*frames).collect()]
    want = [(p, d) for p, s in passages if s for d, t in docs if t and s in t]
    assert sorted(got) == sorted(want) and len(want) > 60
    plan = X.scan_corpus_text(*frames)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert X.scan_corpus_text(frames[0], frames[1].limit(0)).count() == 0 and X.scan_corpus_text(frames[0].limit(0), frames[1]).count() == 0


@pytest.mark.parametrize("spread, share", [(0.02, 0.4), (5.0, 1.01)])
def test_nearest_member_by_pivot_cells(spark, spread, share):
    """Equal to all products, of which vectors with structure need a fraction."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    values = centres[rng.integers(12, size=600)] + spread * rng.normal(size=(600, 8))
    values[5] = 0.0
    values[7] = values[6]
    member = rng.random(600) < 0.5
    rows = [(i, v.tolist(), bool(m)) for i, (v, m) in enumerate(zip(values, member))]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, member boolean")
    got = {r.vec_id: r for r in M.nearest_member_work(df, "vec_id", "v", "member", 16).collect()}
    unit = values / np.maximum(np.linalg.norm(values, axis=1), 1e-12)[:, None]
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, -np.inf)
    want = cosine[:, member].max(axis=1)
    assert sorted(got) == list(range(600))
    assert all(abs(got[i].cosine - want[i]) < 1e-9 for i in got)
    assert sum(r.products for r in got.values()) <= share * 600 * member.sum()
    assert M.nearest_member(df.where("vec_id < 0"), "vec_id", "v", "member").count() == 0
    alone = df.where("vec_id < 3").withColumn("member", M.F.col("vec_id") == 1)
    assert {r.vec_id for r in M.nearest_member(alone, "vec_id", "v", "member").collect()} == {0, 2}


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 1.0])
def test_exact_percentile_equals_the_built_in(spark, share):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, rng.random(), 0.25, -3e9])) for _ in range(700)]
    df = spark.createDataFrame(rows + [("alone", 4.5), ("void", None)], "g string, v double")
    want = {r.g: r.p for r in df.groupBy("g").agg(M.F.percentile("v", M.F.lit(share)).alias("p")).collect()}
    assert {r.g: r.p for r in exact_percentile(df, ["g"], "v", share, "p").collect()} == want
    whole = df.agg(M.F.percentile("v", M.F.lit(share)).alias("p")).first().p
    assert [r.p for r in exact_percentile(df, [], "v", share, "p").collect()] == [whole]
    assert [r.p for r in exact_percentile(df.limit(0), [], "v", share, "p").collect()] == [None]


def test_active_discovery_matches_a_simulation(spark):
    rng = random.Random(9)
    graphs, probes = [f"g{i}" for i in range(9)], {f"p{i}": rng.randint(1, 4) for i in range(5)}
    trace = {(g, p): rng.randint(0, 3) for g in graphs for p in probes}
    predicted = spark.createDataFrame([(g, p, t) for (g, p), t in trace.items()], "graph_id string, probe_id string, trace long")
    catalogue = spark.createDataFrame(list(probes.items()), "probe_id string, declared_cost long")
    cases = spark.createDataFrame([(g, True, 0) for g in graphs], "case_id string, evidence_ok boolean, budget long")
    answers = predicted.withColumnRenamed("graph_id", "case_id")
    log = {}
    for r in D.discover(predicted, catalogue, cases, lambda asked: asked.join(answers, ["case_id", "probe_id"])).collect():
        log.setdefault(r.case_id, []).append((r.step, r.probe_id, r.graphs))
    for g in graphs:
        alive, used, steps = list(graphs), [], []
        while True:
            options = []
            for p, cost in probes.items():
                if p not in used:
                    sizes = [len(list(x)) for _, x in groupby(sorted(trace[(a, p)] for a in alive))]
                    if len(sizes) > 1:
                        options.append((max(sizes), sum(s * s for s in sizes), cost, p))
            if not options:
                break
            p = min(options)[3]
            used.append(p)
            alive = [a for a in alive if trace[(a, p)] == trace[(g, p)]]
            steps.append((len(used), p, alive))
        assert sorted(log.get(g, [])) == steps


def test_strict_documents(spark, tmp_path):
    good = '{"nodes":[{"id":"n","subject_id":"s","type":"CACHE_ENTRY","state":"ERASED","active_sink":false,"purpose":"","commitment":"","evidence_id":null}],"edges":[]}'
    (tmp_path / "good.json").write_text(good)
    (tmp_path / "bad.json").write_text(good.replace('"purpose":"",', ""))
    nodes, edges = S.read_artifact_graphs(spark, str(tmp_path / "good.json"), whole_files=True)
    assert nodes.collect()[0].artifact_id == "n" and edges.count() == 0
    with pytest.raises(ValueError, match="missing field at graph.nodes: purpose"):
        S.read_artifact_graphs(spark, str(tmp_path / "bad.json"), whole_files=True)
    (tmp_path / "twice.json").write_text('[{"id":"1","artifact_id":"a","kind":"K"},{"id":"2","artifact_id":"a","kind":"K"}]')
    assert [r.evidence_id for r in S.read_evidence(spark, str(tmp_path / "twice.json")).collect()] == ["2"]
    with pytest.raises(ValueError, match="duplicate evidence"):
        S.read_evidence(spark, str(tmp_path / "twice.json"), on_duplicate="error")


def test_certify_needs_every_stage(spark):
    find = spark.createDataFrame(
        [("a", "GRAPH_DISCOVERED", True, True), ("b", "NO_OBSERVED_RECURRENCE", True, True), ("c", "GRAPH_DISCOVERED", True, True), ("d", "GRAPH_DISCOVERED", True, False)],
        "request_id string, find_verdict string, evidence_ok boolean, reconciled boolean",
    )
    erase = spark.createDataFrame([("a", "COMPLETE"), ("b", "COMPLETE"), ("c", "COMPLETE"), ("e", "INCOMPLETE")], "request_id string, erase_verdict string")
    prove = spark.createDataFrame([("a", "OPTIMAL"), ("c", "INFEASIBLE")], "request_id string, prove_status string")
    got = {r.request_id: r.verdict for r in D.certify(find, erase, prove).collect()}
    assert got == {"a": "COMPLETE_WITHIN_ENVELOPE", "b": "UNVERIFIED", "c": "INCOMPLETE", "d": "UNVERIFIED", "e": "INCOMPLETE"}


def test_redaction_of_nested_values():
    from traceless.functions.digests import redacted_text

    keys = frozenset({"token", "secret"})
    cases = {
        '{"token": {"a": {"b": "SECRET"}}, "x":1}': '{"token": "[REDACTED]", "x":1}',
        '[{"Secret":["}", [2]]}, {"a": "token"}]': '[{"Secret":"[REDACTED]"}, {"a": "token"}]',
        '{"tok\\u0065n" : "\\"x", "deep": {"token": null}}': '{"tok\\u0065n" : "[REDACTED]", "deep": {"token": "[REDACTED]"}}',
        '"token"': '"token"',
        '{"token": 1': None,
        None: None,
        "[" * 100_000: None,
    }
    for text, want in cases.items():
        assert redacted_text(text, keys) == want
