"""Vectors, pages and conversations: awkward rows and whole round trips."""

from __future__ import annotations

import gzip
import io
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from traceless.llm import ann, chat, warc


def vectors(n: int = 900) -> list[tuple]:
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 16)).astype(np.float32)
    x[100:160] = x[3]
    x[200] = 2 * x[3]
    return [(k, v.tolist()) for k, v in enumerate(x)]


def test_nearest_neighbours(spark):
    rows = vectors()
    odd = [(5000, None), (5050, []), (5100, [0.0] * 16), (5150, [float("nan")] * 16), (5200, [1.0] * 15 + [None]), (None, [1.0] * 16), (5250, [1.0] * 8)]
    frame = spark.createDataFrame([(*r, 1) for r in rows + odd + [rows[50]]], "vec_id long, embedding array<float>, bucket int")
    got = defaultdict(list)
    for r in sorted(ann.nearest(frame, F.col("vec_id") % 50 == 0).collect()):
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    want = brute.cosine_neighbours(rows, range(0, 900, 50))
    assert not set(got) - set(want)
    hits = sum(len({v for v, _ in want[q]} & {v for v, _ in got[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    # vectors with many copies: the smallest ids in order
    assert [v for v, _ in got[100]] == [3, 101, 102, 103, 104] or got[100][0][1] == pytest.approx(1.0)
    assert all(dict(want[q]).get(v, s) == pytest.approx(s, abs=1e-12) for q in got for v, s in got[q])


@pytest.mark.parametrize("parts,n", [(1, 4000), (2, 4000), (3, 800)])
def test_recall_of_unstructured_vectors(parts, n):
    """The buckets that a query probes hold its nearest, whatever the number of hash parts."""
    unit = ann._unit(np.random.default_rng(parts).normal(size=(n, 64)))
    hasher, q = ann.Hasher(64, ann.TABLES, parts, ann.SEED), unit[: 40 if parts < 3 else 6]
    truth = np.argsort(-(q @ unit.T), axis=1)[:, 1:6]
    met = np.zeros((len(q), n), bool)
    for table in range(ann.TABLES):
        own = hasher.buckets(unit, table)[:, 0]
        probes = hasher.buckets(q, table, int(np.ceil(128**parts * ann.PROBED[parts - 1])))
        for i in range(len(q)):
            met[i] |= np.isin(own, probes[i])
    assert np.take_along_axis(met, truth, 1).mean() >= 0.9


def test_few_vectors_and_great_ones(spark):
    for n in (2, 6, 9):
        rows = [(50 * k, [float(x) * 1e200 for x in v]) for k, (_, v) in enumerate(vectors()[:n])]
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = defaultdict(list)
        for r in sorted(ann.nearest(frame, F.col("vec_id") % 50 == 0).collect()):
            got[r.query_id].append((r.vec_id, pytest.approx(r.score, abs=1e-12)))
        want = brute.cosine_neighbours([(k, [x / 1e200 for x in v]) for k, v in rows], [k for k, _ in rows])
        # up to k others all are found; of more, as many as asked for
        assert {q: len(found) for q, found in got.items()} == {q: len(found) for q, found in want.items()}
        assert n > 6 or dict(got) == want


def test_split_buckets_and_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "MEMBER_ROWS", 7)
    rows = vectors(300)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    full = ann.nearest(frame, F.col("vec_id") % 50 == 0, probed=1.0, tables=1)
    want = brute.cosine_neighbours(rows, range(0, 300, 50))
    got = defaultdict(set)
    for r in full.collect():
        got[r.query_id].add(r.vec_id)
    assert all({v for v, _ in want[q]} == got[q] for q in want)
    monkeypatch.setattr(ann, "QUERY_ROWS", 2)
    many = ann.nearest(frame, F.col("vec_id") % 10 == 0, parts=2).collect()
    want = brute.cosine_neighbours(rows, range(0, 300, 10))
    assert len(many) == 5 * 30
    assert sum(r.vec_id in {v for v, _ in want[r.query_id]} for r in many) >= 0.9 * len(many)
    assert ann.nearest(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_rotations_keep_lengths():
    x = np.random.default_rng(1).normal(size=(5, 32))
    turned = ann.rotate(x, ann.rotations(32, 1, 3)[0])
    assert np.allclose((turned**2).sum(1), (x**2).sum(1)) and not np.allclose(turned, x)


def test_archives(spark, tmp_path):
    pages = [(0, "http://a/ b\r\nc", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "http://c", None), (3, "http://d", ""), (4, "http://e", "x\r\n\r\nWARC/1.1\r\n" * 9000), (None, "http://f", "<p>é</p>"), (5, "http://g", "one"), (5, "http://g", "one")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("copies", F.lit(0)).repartition(3)
    got = Counter(tuple(r) for r in warc.archive_pages(frame).collect())
    first = {}
    for p, _, h in pages:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    import base64
    import hashlib

    want = Counter()
    for p, _, h in pages:
        data = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        response = p == first[h or ""]
        want[(p, len(data), digest, "response" if response else "revisit", None if response else first[h or ""])] += 1
    assert got == want
    bounded = warc.archive_pages(frame, min_revisit_bytes=1).where("payload_bytes = 0").collect()
    assert {r.record_type for r in bounded} == {"response"} and len(bounded) == 2
    assert warc.archive_pages(frame.limit(0)).count() == 0


def test_members_and_sidecar():
    parts = []
    for k in range(20):
        body = f"payload {k} ".encode() * (k * 400)
        parts.append(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n" % (k, len(body)) + body + b"\r\n\r\n")
    plain = b"".join(parts)
    for packed in (gzip.compress(plain), b"".join(map(gzip.compress, parts))):
        out = io.BytesIO()
        index = list(warc.rewrite(io.BytesIO(packed), out))
        data = out.getvalue()
        assert gzip.decompress(data) == plain
        for entry, part in zip(index, parts, strict=True):
            assert zlib.decompress(data[entry["offset"] : entry["offset"] + entry["length"]], 31) == part
            json.dumps(entry)
    with pytest.raises(ValueError):
        list(warc.rewrite(io.BytesIO(gzip.compress(plain[:-900])), io.BytesIO()))


def conversations() -> list[tuple]:
    rng = random.Random(1)
    bits = ["<|im_end|>", "<|im_start|>", "<|", "<\\|", "<\\\\|x", "n|", "<n|", "assistant", "\n", " ok ", "é", "\\", "|>"]
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 6)):
            text = None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randrange(0, 6)))
            role = rng.choice(["user", "assistant", "system", None, "a\nb", "<n|", "<|im_end|>"])
            rows.append((c, t, role, text))
    rows += [(None, 0, "user", "lost"), (7, None, "assistant", "no turn"), (8, 0, "user", "twice"), (8, 0, "user", "twice")]
    rows += [(99, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(3000)]
    return rows


def test_chat_round_trip(spark):
    rows = conversations()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit(9)).repartition(4)
    formatted = chat.format_conversations(frame)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    source = defaultdict(list)
    for c, t, role, text in rows:
        source[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(source)
    for c, turns in source.items():
        turns.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        assert [(t.role, t.text) for t in got[c].turns] == [x[2:] for x in turns]
        assert got[c].loss_text == "".join(x[3] for x in turns if x[2] == "assistant")
    for r in formatted.collect():
        at, under = 0, []
        for run in r.loss_mask:
            under.append(r.formatted[at + run.skip : at + run.skip + run["take"]])
            at += run.skip + run["take"] + run.rest
        assert at == len(r.formatted)
        assert len([u for u in under if u]) <= len(source[r.conv_id])
        if r.level == 0:
            assert "".join(under) == got[r.conv_id].loss_text
    assert {r.level for r in formatted.select("level").distinct().collect()} == {0, 1}
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0


def test_many_proposals_cost_their_length():
    """Selecting spans is linear in a text's spans: four times the numbers take about four times as long."""
    import time

    from traceless.llm import pii

    model = {"trees": [], "slope": 0.0, "shift": 9.0, "limits": [0.5] * len(pii.KINDS)}

    def seconds(n: int) -> float:
        text = " ".join(f"call 0{k % 10}0 555 {1000 + k % 9000} now" for k in range(n))
        began = time.perf_counter()
        spans = pii.added_spans(text, pii.base_spans(text), model)
        taken = sorted((s, e) for s, _, e in spans)
        assert all(a[1] <= b[0] for a, b in zip(taken, taken[1:]))
        return time.perf_counter() - began

    seconds(500)
    assert seconds(8000) < 8 * seconds(2000) + 0.5


def test_archive_of_hot_payloads_without_broadcasts(spark, monkeypatch):
    from compare import compare

    from traceless.llm import shared
    from traceless.llm.queries import ORACLES, QUERIES

    monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
    name = "op4_warc_normaliser"
    ok, message, rows = compare(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLES[name])
    assert ok and rows > 0, message
