"""Written intermediate tables that cut lineage inside iterative operators.

Intermediate frames go to the shared folder that the session names in
``spark.checkpoint.dir``, so a lost executor never loses them and every later
round starts from files (with file statistics) instead of a growing plan.
"""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for written tables: the session's own, else a local one in tests."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get(
        "spark.checkpoint.dir", ""
    )
    if not named:
        present = context._jsc.sc().getCheckpointDir()
        named = present.get() if present.isDefined() else ""
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder that every executor can reach"
        )
    folder = tempfile.mkdtemp(prefix="spark-traceless-", dir="/tmp")
    context.setCheckpointDir(folder)
    return checkpoint_root(spark)


def _folder(spark: SparkSession) -> str:
    application = spark.sparkContext.applicationId
    if application not in _FOLDERS:
        _FOLDERS[application] = f"{checkpoint_root(spark)}/traceless-{uuid.uuid4().hex}"
    return _FOLDERS[application]


class Stored:
    """A frame written once as Parquet and read back with its own schema."""

    def __init__(self, df: DataFrame, label: str) -> None:
        self.spark = df.sparkSession
        self.schema = df.schema
        self.path = f"{_folder(self.spark)}/{label}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def size_in_bytes(self) -> int:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        system = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return int(system.getContentSummary(hadoop).getLength())


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the workspace and return the frame over the files."""
    return Stored(df, label).df


def union_stored(parts: list[Stored]) -> DataFrame:
    """One scan over several written tables of the same schema."""
    first = parts[0]
    return first.spark.read.schema(first.schema).parquet(*[part.path for part in parts])


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a join side with a row or more per case, which is never broadcast.

    Spark broadcasts by the size of the files; rows that repeat a few values take a
    hundredth of their size there and would fill the driver.
    """
    return df.hint("merge")


def local_path(path: str) -> str:
    """Plain path of a ``file:`` URI; other paths are returned as they are."""
    parsed = urlparse(path)
    return unquote(parsed.path) if parsed.scheme == "file" else path
