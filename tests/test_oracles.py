"""A cross-section of registered queries against DuckDB; tools/compare.py runs all of them."""

from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
NAMES = [
    "audit_status",
    "residual_paths",
    "request_verdicts",
    "min_cost_actions",
    "exact_cover",
    "minimum_cost_controls",
    "version_space_verdicts",
    "probe_selection_minimax",
    "membership_attack",
    "outcome_report",
    "receipt_chain_checks",
    "request_lifecycles",
    "stream_recurrence_alerts",
    "row_violations",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    import __spark_entry__ as entry
    from compare import compare

    ok, message, rows = compare(spark, SF, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message
    assert rows > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["subject_id", "path_length", "path", "reason"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
