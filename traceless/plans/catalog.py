"""Named table projections, written once in SQL that Spark and DuckDB both accept.

Each projection names the tables it reads as ``{table}``.  Spark binds those
names to DataFrames; the DuckDB text turns them into common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from traceless.plans.workspace import Stored

SOURCE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

PROJECTIONS: dict[str, str] = {}
_WRITTEN: set[str] = set()
_TABLES: dict[tuple, Stored] = {}

_NAME = re.compile(r"\{([a-z_0-9]+)\}")


def projection(name: str, text: str, written: bool = False) -> None:
    """Define a projection; ``written`` ones are derived once per session and kept as files."""
    if name in PROJECTIONS or name in SOURCE_TABLES:
        raise ValueError(f"projection {name} is already defined")
    PROJECTIONS[name] = text
    if written:
        _WRITTEN.add(name)


def inputs_of(text: str) -> list[str]:
    return sorted(set(_NAME.findall(text)))


def sources_of(name: str) -> set[str]:
    """The given tables that a projection is derived from."""
    if name in SOURCE_TABLES:
        return {name}
    return set().union(*(sources_of(item) for item in inputs_of(PROJECTIONS[name])))


def file_state(spark: SparkSession, path: str) -> tuple:
    """Times and lengths of a table's files; another state means other data."""
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(context._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in system.listStatus(hadoop)))


def data_state(spark: SparkSession, sf_dir: str, names: Iterable[str]) -> tuple:
    return tuple(file_state(spark, f"{sf_dir}/{name}.parquet") for name in sorted(names))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named source table or projection as a lazy DataFrame."""
    if name in SOURCE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = PROJECTIONS[name]
    key = ()
    if name in _WRITTEN:
        key = (spark.sparkContext.applicationId, sf_dir, name, data_state(spark, sf_dir, sources_of(name)))
        if key in _TABLES:
            return _TABLES[key].df
    frames = {item: table(spark, sf_dir, item) for item in inputs_of(text)}
    df = spark.sql(text, **frames)
    if name not in _WRITTEN:
        return df
    _TABLES[key] = Stored(df, name)
    return _TABLES[key].df


def write_projections(spark: SparkSession, sf_dir: str) -> None:
    """Derive all projections that are kept as files."""
    for name in sorted(_WRITTEN):
        table(spark, sf_dir, name)


def _ordered(names: Iterable[str], done: list[str]) -> None:
    for name in names:
        if name in SOURCE_TABLES or name in done:
            continue
        _ordered(inputs_of(PROJECTIONS[name]), done)
        done.append(name)


def duckdb_text(body: str, extra: dict[str, str] | None = None, materialized: bool = False) -> str:
    """``body`` with every ``{projection}`` it needs prepended as a CTE.

    ``extra`` holds further CTEs (DuckDB only) that may refer to projections and
    to each other in the given order.  ``materialized`` keeps DuckDB from working
    out a part again for each of its uses.
    """
    extra = extra or {}
    wanted: list[str] = []
    for text in [*extra.values(), body]:
        _ordered([n for n in inputs_of(text) if n not in extra], wanted)
    kept = "as materialized" if materialized else "as"
    parts = [f"{name} {kept} ({_NAME.sub(lambda m: m.group(1), PROJECTIONS[name])})" for name in wanted]
    parts += [f"{name} {kept} ({_NAME.sub(lambda m: m.group(1), text)})" for name, text in extra.items()]
    plain = _NAME.sub(lambda m: m.group(1), body)
    return f"with recursive {', '.join(parts)} {plain}" if parts else plain
