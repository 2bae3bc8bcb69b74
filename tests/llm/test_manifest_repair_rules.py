"""Merkle manifest, conversation repair and URL cascades against plain versions."""

from __future__ import annotations

import random
import re
import zlib
from itertools import product as ways

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import sha
from traceless.llm import cascade, merkle, repair

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["key", "row", "id", "digest", "position", "slice", "block", "n", "host", "rule", "draw", "conv", "segment", "share"]


def clash(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH if c not in df.columns])


# --- manifest


def plain_manifest(rows: list[tuple], arity: int) -> list[tuple]:
    """Rows of the manifest by a tree that is built in full."""

    def leaf(doc, text, lang, source, chars):
        parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, chars, text)]
        return sha("".join(parts))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([sha("".join(last[k : k + arity])) for k in range(0, len(last), arity)])
        return levels

    def folded(levels, index, digest):
        proof = ""
        for level in levels[:-1]:
            first = index // arity * arity
            run = level[first : first + arity]
            proof += "".join(d for k, d in enumerate(run) if k != index - first)
            run[index - first] = digest
            index, digest = index // arity, sha("".join(run))
        return proof, digest

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[g] = tree([leaf(*r) for r in groups[g]])
    crown = tree([trees[g][-1][0] for g in order])
    root, found = crown[-1][0], []
    for at, g in enumerate(order):
        for k, r in enumerate(groups[g]):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            new = leaf(*r[:4], r[4] + 1) if changed else leaf(*r)
            low, top = folded(trees[g], k, new)
            high, top = folded(crown, at, top)
            found.append((r[0], leaf(*r), trees[g][-1][0], root, sha(low + high), top, top == root))
    return sorted(found, key=str)


def manifest_rows(spark, rows, arity, depth):
    df = clash(spark.createDataFrame(rows, DOCS)).repartition(3)
    where = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    found = merkle.manifest(
        df, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"n_chars": F.col("n_chars") + 1}, where, arity, depth
    )
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("arity,depth", [(2, 2), (3, 1), (2, 11)])
def test_manifest_matches_full_tree(spark, arity, depth):
    rng = random.Random(arity)
    rows = [(k, f"text é {k}", rng.choice(["en", "en", "en", "de", "", "É"]), rng.choice([None, "a:b"]), k * 3) for k in range(70)]
    rows += [(7, "same", None, "s", 4), (7, "same", None, "s", 4), (None, None, None, None, None), (500, "x" * 300_000, "zz", "", None)]
    assert manifest_rows(spark, rows, arity, depth) == plain_manifest(rows, arity)


def test_manifest_of_one_and_none(spark):
    one = [(5, "a", "en", "s", 1)]
    assert manifest_rows(spark, one, 2, 3) == plain_manifest(one, 2)
    assert manifest_rows(spark, [], 2, 3) == []


def test_midstates_resume():
    digests = np.stack([np.frombuffer(sha(str(k)).encode(), np.uint8) for k in range(5)])
    level = merkle.Level(digests, 3)
    changed = np.stack([np.frombuffer(sha(f"new {k}").encode(), np.uint8) for k in range(5)])
    found = [bytes(d).decode() for d in level.fold(np.arange(5), changed)]
    for k in range(5):
        run = [bytes(d).decode() for d in digests[k // 3 * 3 : k // 3 * 3 + 3]]
        run[k % 3] = bytes(changed[k]).decode()
        assert found[k] == sha("".join(run))


# --- repair


def plain_faults(rows):
    seen, faults = set(), []
    for role, text in rows:
        tail = text.rstrip(" \t\n\x0b\x0c\r")
        if not tail:
            faults.append("b")
        elif (role, text) in seen:
            faults.append("d")
        else:
            faults.append("o" if tail[-1] in ".!?" else "t")
        seen.add((role, text))
    return faults


def plain_repair(rows):
    """Cost, audit and lines by trying all edits; for a few rows only."""
    faults, best = plain_faults(rows), None
    options = []
    for (role, text), fault in zip(rows, faults):
        edits = [(4, "D", None)]
        if fault in "ot":
            more = 3 * (fault == "t")
            edits += [(more, "K", role), (3 + more, "R", "user"), (3 + more, "R", "assistant")]
        options.append([(c + 3 * len(pre), "I" * len(pre) + e, pre, r, text) for pre in ((), ("user",), ("user", "assistant"), ("assistant",), ("assistant", "user")) for c, e, r in edits])
    for end in ((), ("user",), ("user", "assistant"), ("assistant",)):
        for chosen in ways(*options):
            lines = [x for _, _, pre, r, text in chosen for x in [*((p, "") for p in pre), *([(r, text)] if r is not None else [])]]
            lines += [(p, "") for p in end]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)):
                way = (sum(c[0] for c in chosen) + 3 * len(end), "".join(c[1] for c in chosen) + "I" * len(end), [f"{r}:{t}" for r, t in lines])
                best = min(best or way, way)
    return best


def frame(spark, convs):
    rows = [(c, k if k % 5 else None if c == 3 else k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    return clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


@pytest.mark.parametrize("segment_rows", [1, 3, 2048])
def test_repair_matches_all_edits(spark, segment_rows):
    rng = random.Random(segment_rows)
    convs = {
        c: [(rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), rng.choice(["Yes.", f"no {k}", " \n", "fine! ", f"{k}?"])) for k in range(rng.randrange(1, 5))]
        for c in range(40)
    }
    found, repaired = repair.repair(frame(spark, convs), segment_rows=segment_rows)
    got = {r.conv_id: r for r in found.collect()}
    lines = {}
    for r in sorted(repaired.collect(), key=lambda r: r.segment):
        lines.setdefault(int(r.conv[1:]), []).extend(r.lines)
    for c, turns in convs.items():
        if c != 3:
            faults, (cost, audit, want) = plain_faults(turns), plain_repair(turns)
            initials = [r[:1] for r, _ in turns]
            illegal = sum((a + "," + b) not in ("s,u", "u,a", "a,u") for a, b in zip(initials, initials[1:]))
            assert (got[c].cost, got[c].audit, lines[c], got[c].illegal) == (cost, audit, want, illegal)
            assert (got[c].blank, got[c].duplicate, got[c].truncated) == tuple(map(faults.count, "bdt"))
            assert got[c].repaired_sha256 == sha("\n".join(want)) and got[c].gaps == 0


def test_long_conversation_is_the_same_in_segments(spark):
    rng = random.Random(4)
    runs = [[("user", f"q {k} {j}?") for j in range(rng.randrange(1, 60))] + [("assistant", "It is so.")] for k in range(30)]
    turns = [t for run in runs for t in run] + [("assistant", "x" * 400_000)]
    df = frame(spark, {9: turns})
    whole, cut = (repair.repair(df, segment_rows=n)[0].collect() for n in (100_000, 7))
    assert whole == cut
    # a plain forward DP over states, with all letters kept
    best = {repair.START: (0, "")}
    for (role, _), fault in zip(turns, plain_faults(turns)):
        step = repair.power({"user": 2, "assistant": 3}[role], {"o": 0, "t": 1, "b": 2, "d": 3}[fault], 0)
        fresh = {}
        for i, (cost, letters) in best.items():
            for j, entry in enumerate(step[i]):
                if entry:
                    way = (cost + entry[0], letters + entry[1])
                    fresh[j] = min(fresh.get(j, way), way)
        best = fresh
    ends = [(best[i][0] + e[0], best[i][1] + e[1]) for i in best for j in repair.ENDS if (e := repair.INSERTS[i][j])]
    assert (whole[0].cost, whole[0].audit) == min(ends)


def test_repair_of_awkward_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(None, None, None, None), (None, 2, "user", "Hi."), (1, None, "assistant", "a."), (1, 9, "user", "b."), (2, 5, "user", "x")]
    df = spark.createDataFrame(rows, schema)
    got = {r.conv_id: r for r in repair.repair(df.where("conv_id is null or conv_id < 2"), df)[0].collect()}
    assert (got[2].cost, got[2].audit, got[2].repaired_sha256) == (0, "", sha(""))
    assert (got[None].audit, got[None].blank, got[None].gaps) == ("DKI", 1, 0)
    assert (got[1].audit, got[1].gaps) == ("IKKI", 0)
    none = spark.createDataFrame([], schema)
    assert repair.repair(repair.damage(none), none)[0].count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", f"A {c}. B!") for c in range(20) for t in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        draw = zlib.crc32(f"{c}:{t}".encode()) % 20
        if draw:
            text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
            want += [(c, t, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    got = repair.damage(df).select("conv_id", "turn", "role", "text").collect()
    assert sorted(map(tuple, got)) == sorted(want)


# --- URL rules


def plain_judge(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({k: k + 32 for k in range(65, 91)}), m[2]) if m else ("", "")
    fits = []
    for verdict, key in rules:
        rule_host, slash, rest = key.partition("/")
        rule_path = slash + rest
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            fits.append((len(key), len(rule_host), verdict == "block", key, verdict))
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


@pytest.mark.parametrize("filter_bytes", [8 << 20, 64])
def test_rules_match_plain_search(spark, filter_bytes):
    rng = random.Random(8)
    hosts = [f"{a}{b}.{c}" for a in ("", "www.", "A.b.") for b in ("one", "two", "x1", "ééé") for c in ("org", "com", "co.uk")]
    paths = ["", "/", "/a", "/a/", "/a/b?q=/c", "/b#f", "/é/x", "/A/"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    urls += [None, "", "no scheme", "x://", "://h.org/a", "http://a://b/c", "ftp://org", "http://a.org.", "http://" + "d." * 3000 + "org/" + "p" * 50_000]
    rules = [("allow", "org/"), ("block", "one.org/a/"), ("block", "b.two.com"), ("allow", "com/é/"), ("block", "com/a"), ("allow", "com/a"), ("block", "co.uk/b")]
    rules += [(rng.choice(["allow", "block"]), f"r{k}.{rng.choice(['one.org', 'com'])}/p{k % 7}") for k in range(150)]
    df = clash(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).repartition(4)
    got = {r.page_id: tuple(r)[1:] for r in cascade.judge(df, cascade.rules_frame(spark, rules), filter_bytes=filter_bytes).collect()}
    assert got == {k: plain_judge(u, rules) for k, u in enumerate(urls)}


def test_cascade_is_exact_over_its_universe(spark):
    listed = spark.range(0, 3000, 3).select(F.col("id").cast("string").alias("key"))
    universe = spark.range(6000).select(F.col("id").cast("string").alias("key"))
    filters = cascade.build(listed, universe)
    assert len(filters) > 2  # false positives were encoded again
    hashes = universe.select("key", *cascade.hashed(F.col("key"), 0)).toPandas()
    found = cascade.members(filters, hashes.h1.to_numpy(), hashes.h2.to_numpy())
    assert set(hashes.key[found]) == {str(k) for k in range(0, 3000, 3)}


def test_rules_of_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert cascade.judge(none, cascade.rules_frame(spark, [("block", "org/")])).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    empty = spark.createDataFrame([], "verdict string, key string")
    assert [tuple(r) for r in cascade.judge(one, empty).collect()] == [(1, "a.org", "/", None, "allow")]


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_conversation_repair", "op13_url_cascade"])
def test_query_matches_sql(spark, name):
    from compare import compare

    from traceless.llm.queries import ORACLES, QUERIES

    ok, message, rows = compare(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLES[name])
    assert ok, message
    assert rows > 0
