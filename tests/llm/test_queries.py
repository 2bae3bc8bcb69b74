"""Registered queries next to their SQL, and the pipeline next to plain versions of its stages."""

from __future__ import annotations

import sys
from collections import Counter

import numpy as np
import pytest

import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op4_warc_normaliser", "op8_chat_format", "op10_exact_dedup"])
def test_query_matches_sql(spark, name):
    from compare import compare

    from traceless.llm.queries import ORACLES, QUERIES

    ok, message, rows = compare(spark, SF, QUERIES[name], ORACLES[name])
    assert ok, message
    assert rows > 0


def test_all_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_pipeline_stages(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from traceless.llm.queries import VOCABULARY
    from traceless.plans.workspace import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, results = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        results.append(stored(stage(spark, results[-1], SF), name))
    clean, unique, distinct, mixed, encoded = results[1:]
    assert all(r.columns == columns for r in (clean, unique, distinct, mixed))
    assert 0 < clean.count() <= docs.count()
    rows = sorted((r.doc_id, r.text) for r in clean.collect())
    first = {}
    for d, t in rows:
        first.setdefault(" ".join((t or "").split()) if (t or "").strip() else (t or ""), d)
    assert {r.doc_id for r in unique.collect()} <= {d for d, _ in rows}
    assert unique.count() >= len(first)
    rows = sorted((r.doc_id, r.text) for r in unique.collect())
    groups = brute.jaccard_groups([t for _, t in rows])
    want = {rows[g][0] for g in groups}
    kept = {r.doc_id for r in distinct.collect()}
    assert want <= kept and len(kept) <= len(want) + 2
    sizes = Counter()
    for r in distinct.collect():
        sizes[r.source] += len(brute.WORD.findall(r.text or ""))
    taken = Counter()
    for r in mixed.collect():
        taken[r.source] += len(brute.WORD.findall(r.text or ""))
    assert all(abs(taken[s] - t) <= 1 for s, t in brute.mix_targets(sizes).items())
    library = Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    want = Counter()
    for r in mixed.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[(r.doc_id, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(library.decode(ids, skip_special_tokens=False)))] += 1
    assert Counter(tuple(r) for r in encoded.collect()) == want
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == want
    assert "traceless.llm" in sys.modules
