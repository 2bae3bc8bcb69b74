"""WARC archives: writing, turning a monolithic gzip into one member per record, reading by offset.

Spark writes the records as one gzip stream per file.  ``normalise`` inflates each
stream once, compresses every record again as a member of its own and writes the
offsets to a sidecar, ``<archive>.idx``, one JSON line per record.  Readers then
seek to a record and inflate that member alone.  A record is never held whole:
its bytes pass through in chunks.  Outputs are written under a temporary name and
moved, and depend on their input alone, so a task may be run again at any time.

Archives lie in the folder that ``spark.checkpoint.dir`` names, which every
executor reaches; files are opened through ``pyarrow.fs`` by their URI.

Defined cases: a null payload is empty; a null or broken URL is written without
line breaks or not at all; a null ``page_id`` stays null and is never referred to
while the payload has another one; repeated rows are records each, and all rows
that carry the smallest ``page_id`` of a payload are responses; an empty table
gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceless.llm.shared import attach_left, column_or_null, text_of
from traceless.plans.workspace import Stored, checkpoint_root

CHUNK = 1 << 16
RECORDS_PER_FILE = 20_000
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
RECORD_END = "\r\n\r\n"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Base32 SHA-1: four base32 digits for every five hex digits."""
    digest = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """``value``: a whole record per page; repeats of a payload refer to its smallest ``page_id``."""
    url = F.regexp_replace(column_or_null(pages, "url", "string"), r"[\x00-\x20\x7F]+", "%20")
    rows = pages.select("page_id", url.alias("url"), text_of("html").alias("payload"))
    rows = rows.withColumn("sha", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload"))
    found = rows.where(F.col("n") >= min_revisit_bytes).groupBy("sha").agg(
        F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")
    )
    shared = Stored(found.where("copies > 1").select("sha", "first_id", "copies"), "payloads")
    rows = attach_left(rows, shared, ["sha"], "copies")
    revisit = F.col("copies").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("n").cast("string"),
        F.lit(RECORD_END),
    )
    body = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))

    def urn(page: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("")), F.lit(">"))

    lines = F.array_compact(
        F.array(
            F.lit(VERSION),
            F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
            F.concat(F.lit("WARC-Record-ID: "), urn("page_id")),
            F.lit(f"WARC-Date: {DATE}"),
            F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_sha1(F.col("payload"))),
            F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
            F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn("first_id"))),
            F.lit("Content-Type: application/http; msgtype=response"),
            F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
        )
    )
    return rows.select(F.concat(F.array_join(lines, "\r\n"), F.lit(RECORD_END), body).alias("value"))


def write_monolithic(rows: DataFrame, folder: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Records as files of one gzip stream each."""
    writer = rows.write.option("compression", "gzip").option("lineSep", RECORD_END)
    writer.option("maxRecordsPerFile", records_per_file).text(folder)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; Spark writes ``file:/path`` where others expect ``file:///path``."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri)


def inflate(stream) -> Iterator[bytes]:
    """Bytes of a gzip file of one or many members, in chunks of bounded size."""
    state = zlib.decompressobj(31)
    data = stream.read(CHUNK)
    while data:
        out = state.decompress(data, CHUNK)
        if out:
            yield out
        if state.eof:
            data = state.unused_data or stream.read(CHUNK)
            state = zlib.decompressobj(31)
        else:
            data = state.unconsumed_tail or stream.read(CHUNK)


class Reader:
    """Records of a byte stream: headers whole, bodies in chunks."""

    def __init__(self, chunks: Iterator[bytes]) -> None:
        self.chunks, self.buffer = chunks, b""

    def _more(self) -> bool:
        found = next(self.chunks, b"")
        self.buffer += found
        return bool(found)

    def header(self) -> bytes | None:
        """Header block with its empty line, or nothing at the end of the stream."""
        while (end := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("a record is cut off")
                return None
        head, self.buffer = self.buffer[: end + 4], self.buffer[end + 4 :]
        return head

    def line(self) -> bytes | None:
        while (end := self.buffer.find(b"\n")) < 0:
            if not self._more():
                return None
        found, self.buffer = self.buffer[:end], self.buffer[end + 1 :]
        return found

    def body(self, length: int) -> Iterator[bytes]:
        while length:
            if not self.buffer and not self._more():
                raise ValueError("a record is cut off")
            part, self.buffer = self.buffer[:length], self.buffer[length:]
            length -= len(part)
            yield part


def fields(header: bytes) -> dict[str, str]:
    lines = header.decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines) if k}


def rewrite(source, target) -> Iterator[dict]:
    """Copy an archive with one gzip member per record; yields the index entries."""
    reader, offset = Reader(inflate(source)), 0
    while (head := reader.header()) is not None:
        named = fields(head)
        member, length = zlib.compressobj(6, zlib.DEFLATED, 31), 0

        def put(data: bytes) -> int:
            target.write(data)
            return len(data)

        length += put(member.compress(head))
        for part in reader.body(int(named["content-length"])):
            length += put(member.compress(part))
        for part in reader.body(len(RECORD_END)):
            length += put(member.compress(part))
        length += put(member.flush())
        yield {"offset": offset, "length": length, "id": named["warc-record-id"], "type": named["warc-type"]}
        offset += length


def normalise(spark, folder: str, target: str) -> DataFrame:
    """``archive, records`` of the normalised copies of all gzip files of a folder, once written."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path")
    files = Stored(files, "archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, source = _open(path)
                out_system, folder_path = _open(target)
                out_system.create_dir(folder_path, recursive=True)
                name = f"{folder_path}/{source.rsplit('/', 1)[-1].split('.')[0]}.warc.gz"
                draft, count = f"{name}.{uuid.uuid4().hex}", 0
                with system.open_input_stream(source, compression=None) as inp, out_system.open_output_stream(
                    draft, compression=None
                ) as out, out_system.open_output_stream(f"{draft}.idx") as index:
                    for entry in rewrite(inp, out):
                        index.write(json.dumps(entry).encode() + b"\n")
                        count += 1
                out_system.move(f"{draft}.idx", f"{name}.idx")
                out_system.move(draft, name)
                yield pa.RecordBatch.from_pydict({"archive": [f"{target}/{name.rsplit('/', 1)[-1]}"], "records": pa.array([count], pa.int64())})

    spread = files.df.repartition(max(1, min(files.df.count(), 10_000)), "path")
    return Stored(spread.mapInArrow(run, "archive string, records bigint"), "normalised").df


def _page(urn: str | None) -> int | None:
    value = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def _read(system: pafs.FileSystem, path: str) -> Iterator[dict]:
    with system.open_input_file(path) as archive, system.open_input_stream(f"{path}.idx", compression=None) as index:
        for line in iter(Reader(iter(lambda: index.read(CHUNK), b"")).line, None):
            entry = json.loads(line)
            archive.seek(entry["offset"])
            reader = Reader(_bounded(archive, entry["length"]))
            named = fields(reader.header())
            http = fields(reader.header())
            size = int(http["content-length"])
            stated = found = named["warc-payload-digest"].removeprefix("sha1:")
            if named["warc-type"] == "response":
                digest = hashlib.sha1()
                for part in reader.body(size):
                    digest.update(part)
                found = base64.b32encode(digest.digest()).decode()
            if found != stated:
                raise ValueError(f"{path}: the payload at {entry['offset']} does not match its digest")
            yield {
                "page_id": _page(named["warc-record-id"]),
                "payload_bytes": size,
                "payload_digest": found,
                "record_type": named["warc-type"],
                "refers_to": _page(named.get("warc-refers-to")),
            }


def _bounded(archive, length: int) -> Iterator[bytes]:
    """Inflated chunks of one member."""
    state = zlib.decompressobj(31)
    while length:
        data = archive.read(min(CHUNK, length))
        length -= len(data)
        while data:
            yield state.decompress(data, CHUNK)
            data = state.unconsumed_tail


def read_archives(archives: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record.

    Each record is reached by its offset; payloads of responses are hashed again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                rows = []
                for row in _read(*_open(uri)):
                    rows.append(row)
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    spread = archives.select("archive").repartition(max(1, min(archives.count(), 10_000)), "archive")
    return spread.mapInArrow(run, schema)


_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def archive_pages(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write, normalise and read back the archives of all pages."""
    spark = pages.sparkSession
    folder = f"{checkpoint_root(spark)}/warc-{uuid.uuid4().hex}"
    write_monolithic(records(pages, min_revisit_bytes), f"{folder}/monolithic")
    return read_archives(normalise(spark, f"{folder}/monolithic", f"{folder}/members"))
