"""Registered queries: a Spark callable and, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from traceless.plans.catalog import duckdb_text

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: dict[str, str] | None = None, materialized: bool = False):
    """Register ``fn(spark, sf_dir)``; ``sql`` names projections as ``{name}``."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = duckdb_text(sql, ctes, materialized)
        return fn

    return register
