"""Operators over documents: awkward rows, ties, hot groups, empty tables, clashing columns."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import brute
from traceless.llm import bpe, exact, mixing, pii, similar, simhash, suffix, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["key", "norm", "size", "block", "row", "draw", "fp", "slice", "sha", "bucket", "stop", "__row", "prefix", "whole", "position"]
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def awkward() -> list[tuple]:
    long_text = prose(1, 3000)
    texts = [
        (0, None), (1, ""), (2, " \t\n"), (3, "a b c d e f"), (4, "a  b\tc d e f"), (4, "a  b\tc d e f"),
        (None, "a b c d e f"), (5, long_text), (6, long_text), (7, "x" * 120_000), (8, "É <|endoftext|>ΑΣ a\x1cb　c'll"),
        (9, "mail a.b@c.d.org, +1 (017) 555-7713 and 4111 1111 1111 1111 at 10.0.0.1"), (10, long_text.replace("beta1 ", "new ", 1)),
        (None, None), (11, prose(2, 40)), (12, prose(2, 40) + " end"),
    ]
    texts += [(100 + k, "copied text of many rows " + "\n" * (k % 3)) for k in range(60)]
    return [(d, t, "en", None if k % 5 == 0 else f"s{k % 4}", len(t or "")) for k, (d, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(awkward(), SCHEMA)
    return df.select("*", *[F.lit("other").alias(c) for c in CLASH]).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def folded(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup(docs, none):
    groups = defaultdict(list)
    for d, t, *_ in awkward():
        groups[folded(t)].append(d)
    rows = exact.group_rows(docs, capacity=4).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in awkward())
    by_sha = {brute.sha(t): ids for t, ids in groups.items()}
    kept = Counter(r.text_sha256 for r in rows if r.kept)
    assert kept == Counter(list(by_sha))
    for r in rows:
        ids = [i for i in by_sha[r.text_sha256] if i is not None]
        assert r.keep_id == (min(ids) if ids else None) and r.group_size == len(by_sha[r.text_sha256])
    left = exact.keep_first(docs, capacity=4)
    assert left.columns == docs.columns
    assert sorted(folded(r.text) for r in left.collect()) == sorted(groups)
    assert exact.group_rows(none).count() == 0 and exact.keep_first(none).count() == 0


def test_directory_splits_full_buckets(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    leaves = exact.build_directory(keys, capacity=80).collect()
    assert sum(r.n_keys for r in leaves) == 5000 and max(r.n_keys for r in leaves) <= 80
    assert sum(2.0**-r.depth for r in leaves) <= 1.0 and len({r.depth for r in leaves}) > 1


def test_keys_meet_in_their_bucket(spark, monkeypatch):
    """Owners hold the keys of their prefix; colliding texts of a key form a chain of links."""
    monkeypatch.setattr(exact, "SHARD_ROWS", 8)
    rows = [(d, f"text {d % 60}") for d in range(240)] + [(1000 + d, "hot  text") for d in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    plain = exact.F.xxhash64
    few = lambda *c: exact.F.shiftleft(exact.F.pmod(plain(*c), exact.F.lit(16)), 59)
    monkeypatch.setattr(exact.F, "xxhash64", few)
    index = exact.build_index(docs, capacity=3)
    chains = index.chains.df.collect()
    leaves = {(r.depth, r.prefix) for r in index.directory.collect()}
    assert len(leaves) > 4
    for r in chains:
        bits = r.key & (1 << 64) - 1
        assert (r.depth, r.prefix) in leaves and bits >> 64 - r.depth == r.prefix
    links = defaultdict(list)
    for r in chains:
        links[r.key].append(r.link)
    assert max(map(len, links.values())) > 1
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in links.values())
    sizes = {r.text_sha256: (r.keep_id, r.group_size) for r in chains}
    assert sizes == {brute.sha(f"text {d}"): (d, 4) for d in range(60)} | {brute.sha("hot text"): (1000, 90)}


def test_repeated_ids_keep_the_same_row(spark):
    rows = [(7, "same text", f"s{n}") for n in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [exact.keep_first(docs.repartition(n, "source")).collect() for n in (1, 3, 5)]
    assert [[r.source for r in rows] for rows in kept] == [["s0"]] * 3


def test_simhash(docs, none):
    rows = [(d, t) for d, t, *_ in awkward()]
    known = [(k, t) for k, (_, t) in enumerate(rows)]
    want = brute.simhash_components(known)
    got = Counter(tuple(r) for r in simhash.near_duplicates(docs).collect())
    members = defaultdict(list)
    for k, (d, _) in enumerate(rows):
        members[want[k][1]].append(d)
    least = {c: min((i for i in ids if i is not None), default=None) for c, ids in members.items()}
    assert got == Counter((d, want[k][0], least[want[k][1]]) for k, (d, _) in enumerate(rows))
    assert simhash.near_duplicates(none).count() == 0


def test_every_four_positions_hold_a_block():
    from itertools import combinations

    blocks = simhash.blocks_of_three()
    assert len(blocks) == 20
    assert all(any(set(b) <= set(four) for b in blocks) for four in combinations(range(8), 4))


@pytest.mark.parametrize("rows", [4, 512])
def test_links_of_fingerprints(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "LIST_ROWS", rows)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 6, np.uint64)
    values = {int(c) for c in centres}
    for c in centres:
        for _ in range(30):
            flips = rng.choice(64, rng.integers(1, 6), replace=False)
            values.add(int(c) ^ sum(1 << int(b) for b in flips))
    values = np.array(sorted(values), np.uint64)
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    from traceless.llm.components import components

    got = {r.node: r.root for r in components(simhash.links(frame)).collect()}
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    label = np.arange(len(values))
    for _ in values:
        label = np.where(near, label[None, :], len(values)).min(axis=1)
    signed = values.view(np.int64)
    roots = [got.get(int(v), int(v)) for v in signed]
    assert len(set(zip(label.tolist(), roots))) == len(set(label.tolist())) == len(set(roots))


def test_components_of_chains_and_stars(spark):
    from traceless.llm.components import components

    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5, 5), (7, 6)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {r.node: r.root for r in rows}
    assert len({roots[k] for k in range(201)}) == 1 and len({roots[1000 + k] for k in range(200)}) == 1
    assert roots[0] != roots[1000] and len(roots) == 401
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_texts(spark, docs, none):
    rng = random.Random(5)
    texts = []
    for group in range(8):
        base = prose(100 + group, 120).split()
        for _ in range(6):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(99)}"
            texts.append(" ".join(words))
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    want = {k for k, g in enumerate(brute.jaccard_groups(texts)) if k == g}
    got = {r.doc_id for r in similar.keep_one(frame).collect()}
    assert want <= got and len(got) <= len(want) + 1
    left = similar.keep_one(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(4) + ids.count(3) == 1 and 10 not in ids and 6 not in ids and 0 in ids
    assert similar.keep_one(none).count() == 0


def edited_copies(groups: int, copies: int) -> list[str]:
    """Groups of copies of which most pairs have a similarity between 0.7 and 0.85."""
    rng = random.Random(11)
    texts = []
    for group in range(groups):
        base = prose(500 + group, 120).split()
        for copy in range(copies):
            words = list(base)
            for place in rng.sample(range(5, 115), rng.randrange(1, 3)):
                words[place] = f"edit{group}x{copy}x{place}"
            texts.append(" ".join(words))
    return texts


def test_groups_of_edited_copies(spark):
    texts = edited_copies(60, 12)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = {k for k, g in enumerate(brute.jaccard_groups(texts)) if k == g}
    assert {r.doc_id for r in similar.keep_one(frame).collect()} == want


def one_chained_group(copies: int) -> list[str]:
    """Texts around one base, most pairs below 0.8, all close enough to meet in lists."""
    rng = random.Random(17)
    base = prose(940, 60).split()
    texts = []
    for copy in range(copies):
        words = list(base)
        for place in rng.sample(range(5, 55), 1 + copy % 2):
            words[place] = f"edit{copy}x{place}"
        texts.append(" ".join(words))
    return texts


def test_a_large_group_names_no_pairs(spark, monkeypatch):
    compared = []
    real = similar.verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(similar, "verified", counted)
    monkeypatch.setattr(similar, "GROUP_ROWS", 20, raising=False)
    monkeypatch.setattr(similar, "SPREAD_ROWS", 30, raising=False)
    monkeypatch.setattr(similar, "COUNTS", 4096, raising=False)
    texts = one_chained_group(160)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = {k for k, g in enumerate(brute.jaccard_groups(texts)) if k == g}
    assert {r.doc_id for r in similar.keep_one(frame).collect()} == want
    # two pairs a row at most; before, every pair of the group was a row
    assert 10 < len(want) and sum(compared) <= 2 * len(texts)


def linked_lists(words: list[list[int]], own: list[list[int]] | None = None) -> list[dict]:
    """What the linker yields for lists of members with one word and, for two slices, their slice."""
    import pyarrow as pa

    each = own or [[None] * len(one) for one in words]
    fields = [("row", pa.int64()), ("fp0", pa.int64()), ("fp1", pa.int64()), *([("own", pa.int32())] if own else [])]
    lists = [[{"row": 100 * k + n, "fp0": w, "fp1": 0, "own": o} for n, (w, o) in enumerate(zip(one, side))] for k, (one, side) in enumerate(zip(words, each))]
    column = pa.array(lists, pa.list_(pa.struct(fields)))
    return [r for b in similar._linker(similar.MAX_BITS)([pa.RecordBatch.from_arrays([column], ["members"])]) for r in b.to_pylist()]


def test_a_list_yields_a_row_a_member():
    # 40 copies around one centre, and 5 others out of reach of them but not of each other
    copies = [0, *(1 << k for k in range(39))]
    others = [(1 << 60) - 1 ^ 1 << k for k in range(5)]
    rows = linked_lists([copies + others, [0, 1, 3]])
    first = [r for r in rows if r["size"] == 45]
    assert len(first) <= 45 and len(rows) - len(first) == 2  # before, 82 and 2
    to_centre = {r["member"]: (r["centre"], r["away"]) for r in first if r["member"] is not None}
    assert to_centre == {k: (0, 1) for k in range(1, 40)}
    trees = [(r["a"], r["b"]) for r in rows if r["a"] is not None]
    assert all(a < b for a, b in trees)
    groups = {frozenset(range(40)), frozenset(range(40, 45)), frozenset(range(100, 103))}
    ends = {k: {k} for g in groups for k in g}
    for a, b in trees:
        both = ends[a] | ends[b]
        ends |= dict.fromkeys(both, both)
    assert {frozenset(g) for g in ends.values()} == groups and len(trees) == 39 + 4 + 2


def test_two_slices_yield_what_joins_them():
    copies = [1 << k for k in range(40)]
    rows = linked_lists([[*copies, -1, -2]], [[k % 2 for k in range(40)] + [0, 1]])
    # 40 copies and a pair apart from them: one edge each; before, all edges of the tree and of the centre
    assert len(rows) == 2 and all(r["a"] % 2 != r["b"] % 2 and r["member"] is None for r in rows)
    assert [(r["a"] < 40, r["b"] < 40) for r in sorted(rows, key=lambda r: r["a"])] == [(True, True), (False, False)]


def test_repeated_shingles_weigh_once(spark):
    line = prose(900, 20)
    texts = []
    for k in range(6):
        own = prose(910 + k, 300)
        texts += [own, f"{own} " + f"{line} " * 30]
    want = {k for k, g in enumerate(brute.jaccard_groups(texts)) if k == g}
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(want) == 6 and {r.doc_id for r in similar.keep_one(frame).collect()} == want


def test_equal_fingerprints_of_different_texts(spark, monkeypatch):
    texts = [prose(950, 60), prose(951, 60), prose(951, 60) + " end", prose(952, 60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def equal(rows, width, real=similar.two_fingerprints):
        return real(rows, width).withColumns({"fp0": F.lit(0).cast("long"), "fp1": F.lit(0).cast("long")})

    monkeypatch.setattr(similar, "two_fingerprints", equal)
    assert {r.doc_id for r in similar.keep_one(frame).collect()} == {0, 1, 3}


def test_pairs_behind_a_refused_tree(spark, monkeypatch):
    # the closest pairs by fingerprint, a-c and b-c, are refused; a-b is true
    texts = {0: "a", 1: "b", 2: "c", 3: "far"}
    bits = {0: 0, 1: (1 << 20) - 1, 2: (1 << 10) - 1, 3: -1}
    bands = [7] * similar.BANDS
    entries = spark.createDataFrame([(r, b, 0, bands) for r, b in bits.items()], "row long, fp0 long, fp1 long, bands array<long>")
    monkeypatch.setattr(similar, "verified", lambda pairs, *_: pairs.where("a = 0 and b = 1"))
    rows = spark.createDataFrame(list(texts.items()), "row long, text string")
    found = similar.Stored(similar.candidates(entries), "found")
    assert {(r.a, r.b) for r in found.df.collect()} == {(0, 2), (1, 2)}
    roots = {r.node: r.root for r in similar._linked(found, similar.Stored(entries, "entries"), rows, 5, 0.8).df.collect()}
    assert set(roots) == {0, 1} and roots[0] == roots[1]


def test_every_partner_is_named_in_the_end(spark, monkeypatch):
    monkeypatch.setattr(similar, "PARTNERS", 2)
    tried = []
    monkeypatch.setattr(similar, "verified", lambda pairs, *_: tried.extend((r.a, r.b) for r in pairs.collect()) or pairs.limit(0))
    schema = "row long, fp0 long, fp1 long, bands array<long>"
    entries = similar.Stored(spark.createDataFrame([(k, (1 << k) - 1, 0, [7] * similar.BANDS) for k in range(30)], schema), "entries")
    found = similar.Stored(similar.candidates(entries.df), "found")
    texts = spark.createDataFrame([(k, "") for k in range(30)], "row long, text string")
    similar._linked(found, entries, texts, 5, 0.8)
    assert sorted(tried) == [(a, b) for a in range(30) for b in range(a + 1, 30)]


def test_mix(docs, none):
    rows = awkward()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(brute.WORD.findall(t or ""))
    want = brute.mix_targets(sizes)
    got = mixing.mix(docs, block_words=16).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    taken, target = Counter(), {}
    for r in got:
        taken[round(r.target, 6)] += r.taken
        target[r.source_size] = r.target
    assert sum(r.size for r in got) == sum(sizes.values())
    assert sorted(target.values()) == pytest.approx(sorted({want[s]: 1 for s in sizes}), abs=1e-6)
    assert all(abs(v - t) <= 1 for t, v in taken.items())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3), block_words=16).collect()))
    applied = mixing.apply_mix(docs, block_words=16)
    assert applied.columns == docs.columns
    words = sum(len(brute.WORD.findall(r.text or "")) for r in applied.collect())
    assert words == sum(r.taken for r in got)
    again = mixing.apply_mix(docs.repartition(7, "text").sortWithinPartitions("lang"), block_words=16)
    assert sorted(map(str, applied.collect())) == sorted(map(str, again.collect()))
    assert mixing.mix(none).count() == 0 and mixing.apply_mix(none).count() == 0


def test_schedule_mixes_every_stretch(spark):
    sizes = spark.createDataFrame([(f"s{k}", 40_000 * (k + 1)) for k in range(5)], "source string, size long")
    sources = mixing.targets(sizes)
    slots = mixing.schedule(sources.df).orderBy("slot").collect()
    share = Counter(r.source_index for r in slots)
    for start in range(0, len(slots) - 200, 200):
        some = Counter(r.source_index for r in slots[start : start + 200])
        assert all(abs(some[s] - 200 * n / len(slots)) <= 8 for s, n in share.items())
    assert len({(r.source_index, r.block, r.epoch) for r in slots}) == len(slots)


def test_documents_come_in_slot_order(spark):
    """A stretch of the result holds the sources in their proportions, whatever the input's order."""
    rows = [(d, f"{'abc'[d * 3 // 900]} {d} " + prose(d, 30), "abc"[d * 3 // 900]) for d in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2)
    taken = {r.doc_id: r for r in mixing.mix(docs, block_words=8).collect()}
    plan = mixing.schedule(mixing.targets(docs.groupBy("source").agg(F.sum(mixing.word_count()).alias("size"))).df, 8)
    every = {r.slot for r in plan.select("slot").collect()}
    assert all(set(r.slots) <= every and len(r.slots) == -(-r.taken // r.size) for r in taken.values())
    times = sorted((s, r.doc_id) for r in taken.values() for s in r.slots)
    applied = [r.doc_id for r in mixing.apply_mix(docs, block_words=8).collect()]
    assert len(applied) == len(times)
    sources = ["abc"[d * 3 // 900] for d in applied]
    share = Counter(sources)
    for start in range(0, len(sources) - 90, 90):
        some = Counter(sources[start : start + 90])
        assert all(abs(some[s] - 90 * n / len(sources)) <= 9 for s, n in share.items())


VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(VOCABULARY)
    found.no_truncation()
    found.no_padding()
    return found


def test_bpe_documents(docs, none, library):
    want = Counter()
    for d, t, *_ in awkward():
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[(d, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(decoded))] += 1
    assert Counter(tuple(r) for r in bpe.round_trip(docs, VOCABULARY).collect()) == want
    assert bpe.round_trip(none, VOCABULARY).count() == 0


def test_streaming_equals_the_library(library):
    encoder = bpe.Transducer(bpe.load(VOCABULARY))
    rng = random.Random(9)
    assert encoder.lookahead < 2000
    for trial in range(60):
        letters = rng.choice(["ab", "aeinorst", "abcdefghijklmnopqrstuvwxyz", "éßñaöü日本"])
        word = "".join(rng.choice(letters) for _ in range(rng.choice([5, 300, 3000])))
        encoder.window = rng.choice([encoder.lookahead + 20, 4 * encoder.lookahead])
        assert list(encoder.stream(word.encode())) == library.encode(word, add_special_tokens=False).ids


def test_decoder_restores_bytes():
    model = bpe.load(VOCABULARY)
    encoder, decoder = bpe.Transducer(model), bpe.Decoder(model, as_library=False)
    text = "grüße aus 東京 , it 's fine !"
    ids = np.frombuffer(b"".join(encoder.encode(text)), "<u4").tolist()
    pieces = [decoder.feed([i]) for i in ids]
    assert ("".join(pieces) + decoder.end()).split() == "grüße aus 東 京 , it 's fine !".replace("東 京", "東京").split()


def test_lookahead_of_a_small_list():
    # "ab" and "abc" wait for what follows; nothing is longer than its chain
    assert bpe.sufficient_lookahead([("a", "b"), ("x", "ab"), ("y", "xab")]) == 3
    assert bpe.sufficient_lookahead([("x", "a"), ("a", "b")]) == 1


def test_personal_data(docs, none):
    rows = pii.find(docs, pii.fit(docs)).collect()
    want = Counter()
    for d, t, *_ in awkward():
        spans = brute.base_spans(t or "")
        kinds = Counter(k for _, k, _ in spans)
        want[(d, *(kinds[k] for k in pii.KINDS), brute.sha(",".join(f"{k}:{s}:{e}" for s, k, e in spans)))] += 1
    assert Counter(tuple(r)[:6] for r in rows) == want
    assert pii.find(none, pii.fit(none)).count() == 0


def test_base_spans_of_odd_texts():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(["@", ".", "a", "b-", "1", "23", "+1", " ", "(", ")", "256", "4111 1111", "-", "\n", "é"]) for _ in range(rng.randrange(1, 30)))
        assert [(s, pii.KINDS[k], e) for s, k, e in pii.base_spans(text)] == brute.base_spans(text)
    assert pii.base_spans("1" * 300_000) == [] and pii.base_spans("a." * 200_000) == []


def test_boosted_proposals():
    rng = random.Random(4)

    def number():
        digits = [rng.randrange(10) for _ in range(15)]
        last = next(c for c in "0123456789" if pii.luhn("".join(map(str, digits)) + c))
        return "".join(map(str, digits)) + last

    texts = []
    for _ in range(400):
        texts.append(f"call +1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)} or mail u{rng.randrange(99)}@host.example.org now")
        texts.append(f"card {number()} and order {rng.randrange(10**7, 10**8)} id={rng.randrange(10**15, 10**16)}")
    examples = [e for t in texts for e in pii.examples(t)]
    x, y = np.array([e[0] for e in examples]), np.array([e[1] for e in examples])
    model = pii.learn(x, y, np.arange(len(y)) % 5)
    text = "please call 1 (415) 555-2671 or write to jane at mail dot example dot org today; order 12345678"
    found = pii.added_spans(text, pii.base_spans(text), model)
    assert {text[s:e].strip() for s, _, e in found} >= {"1 (415) 555-2671"}
    assert not any("12345678" in text[s:e] for s, _, e in found)
    assert "[PHONE]" in pii.redact(text, pii.joined(found))
    assert pii.added_spans("nothing to see here in 1999", [], model) == []


def test_toxicity(spark, none):
    rng = random.Random(6)
    rows, labels = [], []
    for d in range(600):
        bad = d % 6 == 0
        words = prose(d, 60).split()
        if bad:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["Vile", "foul", "nasty"])
        rows.append((d, " ".join(words)))
        labels.append((d, int(bad)))
    rows += [(1000, None), (1001, ""), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("draw", F.lit(1)).withColumn("toxic", F.lit(1))
    marks = spark.createDataFrame([*labels, (5000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = toxicity.score(docs, model).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(1 - r.predicted for r in got)
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, empty)).collect()} == {0.5}
    assert toxicity.score(none, model).count() == 0 and toxicity.reject(none, model).count() == 0


@pytest.mark.parametrize("r", [0, 1, 2, 3])
def test_difference_cover(r):
    period, cover = suffix.difference_cover(r)
    assert {int(d) % period for d in (cover[:, None] - cover[None, :]).ravel()} == set(range(period))
    assert len(cover) == 6 * r + 4


def test_window_hashes(monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 64)
    suffix._powers.cache_clear()
    data = np.frombuffer(bytes(np.random.default_rng(1).integers(0, 3, 500, np.uint8)), np.uint8)
    at = np.arange(0, 470)
    for base in suffix.drawn_bases():
        hashes = suffix.window_hashes(data, at, 7, base)
        strings = [data[i : i + 7].tobytes() for i in at]
        assert len({*zip(strings, hashes.tolist())}) == len(set(strings)) == len(set(hashes.tolist()))
    suffix._powers.cache_clear()


def test_repeats(spark, none):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(90))
    texts = [None, "", "short", "z" * 400, "ab" * 60]
    for k in range(60):
        own = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz é") for _ in range(rng.randrange(20, 300)))
        cut = rng.randrange(len(own))
        texts.append(own[:cut] + (passage[rng.randrange(20) : 60 + rng.randrange(30)] if k % 3 else "") + own[cut:])
    texts += [texts[7], texts[7], texts[9]]
    rows = [(k if k != 20 else None, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit(0)).repartition(4)
    want = brute.repeats([(t or "").encode() for t in texts], 40)
    got = suffix.remove_repeats(docs, width=40, cover=0, block_bytes=600, bucket_keys=50)
    assert Counter(tuple(r) for r in got.collect()) == Counter((d, *w) for (d, _), w in zip(rows, want))
    assert suffix.remove_repeats(none).count() == 0


def test_without_broadcasts(spark, docs, none, monkeypatch):
    """The same results where no written frame is small enough to be broadcast."""
    from traceless.llm import shared

    monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
    test_exact_dedup(docs, none)
    test_simhash(docs, none)
    test_repeats(spark, none)
    test_similar_texts(spark, docs, none)


def test_similar_texts_in_long_lists(spark, docs, none, monkeypatch):
    monkeypatch.setattr(similar, "LIST_ROWS", 4)
    monkeypatch.setattr(similar, "COUNTED", 1)
    test_similar_texts(spark, docs, none)


def thue_morse(letters: str, length: int) -> str:
    return "".join(letters[k.bit_count() % 2] for k in range(length))


def test_repeats_at_the_registered_width(spark):
    """Width 400 and cover 2, with texts longer than a block and made pairs that weak hashes confuse."""
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    tail = "".join(rng.choice("xyz ") for _ in range(272))
    texts = [prose(40 + k, 60) + passage[k * 30 : k * 30 + 420] + prose(80 + k, 70) for k in range(12)]
    texts += [thue_morse("ab", 128) + tail, thue_morse("ba", 128) + tail, thue_morse("ab", 2048), thue_morse("cd", 2048) + thue_morse("dc", 2048)]
    texts += ["q" * 1500, passage[:399], passage[:400], prose(3, 1500) + passage + prose(4, 1500) + passage[100:700]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in suffix.remove_repeats(frame, block_bytes=4000, bucket_keys=300).collect()}
    assert got == dict(enumerate(brute.repeats([t.encode() for t in texts], 400)))
    assert got[12][1] == got[13][1] == 0 < got[19][1]
