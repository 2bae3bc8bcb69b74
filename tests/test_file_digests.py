"""Files of any size are hashed: large ones as a stream of lines through Spark's reader."""

from __future__ import annotations

import hashlib

import pytest

from traceless.operators import ledger as H

FILES = {
    "plain.parquet": b"PAR1" + bytes(range(256)) * 40 + b"end",
    "feed.parquet": b"\n\r\n\xff\x00" * 900 + b"\n",
    "marked.parquet": b"\xef\xbb\xbf" + b"ab\n" * 800,
    "marked open.parquet": b"\xef\xbb\xbf" + b"ab\n" * 800 + b"c",
    "one line%20[1].parquet": b"x" * 5000,
    "small.parquet": b"s\n",
}


@pytest.fixture
def files(spark, tmp_path, monkeypatch):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    # What a value may hold is 2 GB; here 1 000 bytes stand for it.
    monkeypatch.setattr(H, "WHOLE_BYTES", 1000, raising=False)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    yield spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(str(tmp_path))
    spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_beyond_a_value_are_hashed_whole(spark, files):
    expected = {name: hashlib.sha256(data).hexdigest() for name, data in FILES.items()}
    declared = {**expected, "plain.parquet": "0", "gone.parquet": "0"}
    del declared["feed.parquet"]
    manifest = spark.createDataFrame(list(declared.items()), "name string, digest string")
    found = {r.name: r.outcome for r in H.verify_manifest(manifest, files).collect()}
    other = {"plain.parquet": "digest mismatch", "feed.parquet": "undeclared file", "gone.parquet": "missing file"}
    assert found == {**dict.fromkeys(FILES, "ok"), **other}
    assert {r.name: r.digest for r in H.file_digests(files).collect()} == expected
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "600"
