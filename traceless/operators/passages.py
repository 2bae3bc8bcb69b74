"""Which documents contain which passages verbatim, without comparing each with each.

Both sides of a containment share keys.  Passages of several words share hashes of word
triples, of which one in ``ANCHOR_EVERY`` is an anchor; passages without an anchor share
byte grams.  Documents emit only keys that some passage has.  Each passage is then looked
up by its rarest key, counted over all documents, and only documents with that key are
compared in full.  A passage with a key that no document has is settled without a look-up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceless.plans.workspace import Stored

ANCHOR_EVERY = 8
#: Byte lengths of grams: a passage uses the longest one it holds.
GRAM_SIZES = (8, 4, 3, 2, 1)
#: Bits of the map of wanted grams that tasks get, whatever the number of passages.
MAP_BITS = 20
#: Bytes of text whose grams are made at once.
WINDOW = 4 << 20
#: Largest written frame, in bytes, that is broadcast.
BROADCAST_BYTES = 32 << 20


def _checked(frame: Stored) -> DataFrame:
    """The frame, marked for broadcast only if its files are small."""
    return F.broadcast(frame.df) if frame.size_in_bytes() <= BROADCAST_BYTES else frame.df


# --- keys --------------------------------------------------------------------


def anchors(text: str, inner: bool) -> Column:
    """Distinct hashes of the word triples in the anchor class; ``inner`` skips the edge words.

    The triples come from zipping the word array with its own shifts, so the
    text is split a fixed number of times, not once per triple.
    """
    words = F.split(text, r"\s+")
    if inner:
        words = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    shifted = [F.slice(words, F.lit(n), F.size(words)) for n in (2, 3)]
    pairs = F.zip_with(words, shifted[0], lambda x, y: F.concat(x, F.lit(" "), y))
    triples = F.zip_with(pairs, shifted[1], lambda x, y: F.xxhash64(F.concat(x, F.lit(" "), y)))
    complete = F.slice(triples, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    return F.array_distinct(F.filter(complete, lambda h: F.pmod(h, F.lit(ANCHOR_EVERY)) == 0))


def grams_of(data: np.ndarray, size: int) -> np.ndarray:
    """Keys of all ``size``-byte strings of the data; the high bits are well mixed."""
    count = len(data) - size + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    value = np.zeros(count, dtype=np.uint64)
    for place in range(size):
        value |= data[place : place + count].astype(np.uint64) << np.uint64(8 * place)
    return (value + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)


def byte_grams(df: DataFrame, id_column: str, text: str, sizes: list[int], wanted: bytes | None = None) -> DataFrame:
    """``(id_column, key)`` of the byte grams of every text, those that ``wanted`` maps; repeats may stay."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if wanted is None else np.unpackbits(np.frombuffer(wanted, dtype=np.uint8)).astype(bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts = batch.column(0), batch.column(1).cast(pa.large_string())
            ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            if ends[-1] == ends[0]:
                continue
            data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)
            for size in sizes:
                for start in range(int(ends[0]), int(ends[-1]), WINDOW):
                    keys = grams_of(data[start : min(start + WINDOW + size - 1, int(ends[-1]))], size)
                    place = np.arange(len(keys)) if bits is None else np.flatnonzero(bits[keys >> np.uint64(64 - MAP_BITS)])
                    at = place + start
                    row = np.searchsorted(ends, at, side="right") - 1
                    whole = at + size <= ends[row + 1]
                    pairs = np.unique(np.stack([row[whole], keys[place[whole]].view(np.int64)]), axis=1)
                    if pairs.shape[1]:
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(pairs[0])), pa.array(pairs[1])], [id_column, "key"])

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(id_column, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(emit, f"`{id_column}` {kind}, key long")


def _gram_map(keys: DataFrame) -> bytes:
    """Bit map of the keys' high bits: ``2 ** MAP_BITS`` bits, so its size is fixed."""
    slots = keys.select(F.shiftrightunsigned("key", 64 - MAP_BITS).cast("int").alias("slot")).distinct()
    bits = np.zeros(1 << MAP_BITS, dtype=bool)
    bits[slots.toPandas()["slot"].to_numpy(dtype=np.int64)] = True
    return np.packbits(bits).tobytes()


# --- look-up -----------------------------------------------------------------


def _rarest(keyed: Stored, emitted: Stored) -> DataFrame:
    """``(row, key, n)``: each passage's key that the fewest documents have, if all its keys occur."""
    counts = Stored(emitted.df.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key-counts")
    found = keyed.df.join(_checked(counts), "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = found.groupBy("row").agg(F.min(F.struct("n", "key")).alias("best"))
    return best.select("row", "best.key", "best.n").where("n > 0")


def _meet(keyed: Stored, emitted: Stored) -> DataFrame:
    """``(row, doc_id)`` of documents that have a passage's rarest key.

    Few passages are broadcast.  Otherwise keys above a fair share of the emitted rows, of
    which there are fewer than partitions, are split into shards by document.
    """
    chosen = Stored(_rarest(keyed, emitted), "rarest")
    pair = ["row", "doc_id"]
    if chosen.size_in_bytes() <= BROADCAST_BYTES:
        return emitted.df.join(F.broadcast(chosen.df), "key").select(*pair)
    fair = max(1, emitted.df.count() // int(emitted.spark.conf.get("spark.sql.shuffle.partitions")))
    hot = chosen.df.where(F.col("n") > fair).groupBy("key").agg(F.ceil(F.max("n") / fair).alias("shards"))
    hot = Stored(hot, "hot-keys")
    spread = emitted.df.join(F.broadcast(hot.df), "key").withColumn("shard", F.pmod(F.xxhash64("doc_id"), "shards"))
    shards = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard")
    many = chosen.df.join(F.broadcast(hot.df), "key").select("key", "row", shards)
    rest = [df.join(F.broadcast(hot.df.select("key")), "key", "left_anti") for df in (emitted.df, chosen.df)]
    return spread.join(many, ["key", "shard"]).select(*pair).unionByName(rest[0].join(rest[1], "key").select(*pair))


def _candidates(keyed: DataFrame, emit: Callable[[Stored], DataFrame]) -> DataFrame:
    """``(row, doc_id)`` to compare, from ``keyed(row, key)`` and the documents' own keys."""
    keyed = Stored(keyed.distinct(), "passage-keys")
    wanted = Stored(keyed.df.select("key").distinct(), "wanted-keys")
    emitted = Stored(emit(wanted).join(_checked(wanted), "key", "left_semi").distinct(), "document-keys")
    return _meet(keyed, emitted)


def scan_corpus_text(documents: DataFrame, passages: DataFrame, text: str = "text") -> DataFrame:
    """(passage_id, doc_id) of documents that contain a passage verbatim.

    The inner words of a contained passage are whole words of the document, so both sides
    share the passage's inner word triples; any contained passage shares its bytes.  Null
    and empty passages are found nowhere.
    """
    named = Stored(
        passages.where(F.length("passage") > 0).select(
            F.monotonically_increasing_id().alias("row"), "passage_id", "passage", anchors("passage", True).alias("keys")
        ),
        "passages",
    )
    triples = named.df.where(F.size("keys") > 0).select("row", F.explode("keys").alias("key"))
    by_words = lambda wanted: documents.select("doc_id", F.explode(anchors(text, False)).alias("key"))
    parts = []
    if not triples.isEmpty():
        parts.append(_candidates(triples, by_words))
    holds = F.octet_length("passage")
    longest = F.when(holds >= GRAM_SIZES[0], GRAM_SIZES[0]).when(holds >= GRAM_SIZES[1], GRAM_SIZES[1]).otherwise(holds)
    short = named.df.where(F.size("keys") == 0).withColumn("gram", longest)
    sizes = sorted(row.gram for row in short.select("gram").distinct().collect())
    if sizes:
        grams = [byte_grams(short.where(F.col("gram") == s), "row", "passage", [s]) for s in sizes]
        keyed = grams[0]
        for more in grams[1:]:
            keyed = keyed.unionByName(more)
        by_bytes = lambda wanted: byte_grams(documents, "doc_id", text, sizes, _gram_map(wanted.df))
        parts.append(_candidates(keyed, by_bytes))
    if not parts:
        return documents.join(named.df.select("passage_id").limit(0), F.lit(False)).select("passage_id", "doc_id")
    met = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    pairs = Stored(met, "passage-pairs")
    texts = Stored(named.df.select("row", "passage_id", "passage"), "passage-texts")
    # small lists of pairs travel to the documents, so that texts are not shuffled
    compared = documents.select("doc_id", F.col(text).alias("__text")).join(_checked(pairs), "doc_id")
    return compared.join(_checked(texts), "row").where(F.contains("__text", "passage")).select("passage_id", "doc_id")
