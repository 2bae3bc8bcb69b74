"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are words, word pairs and pairs with one word between, lower-cased and
hashed; a document has a feature or not, however often.  Training reads a bounded
sample of labelled documents (``MAX_ROWS``), one row at a time, with its own rate
per coordinate; the L1 term keeps most weights at zero, so the model is a list of
at most ``2 ** (BITS + 1)`` weights that is broadcast to all scoring tasks.

Defined cases: a null or blank text has only the bias as its score; rows without
a label and labels without a document are not trained on; repeated rows are
scored each; with no labels at all every score is 0.5; an empty table gives no
rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceless.llm.shared import bound_batches, slices, text_of
from traceless.plans.workspace import Stored

#: Labelled documents in the training sample; the sample is drawn by hash.
MAX_ROWS = 16_384
BITS = 22
EPOCHS = 6
ALPHA, BETA, L1, L2 = 8.0, 1.0, 6.0, 0.0
THRESHOLD = 0.7
MEMO_WORDS = 150_000
_WORD = re.compile(r"\w+")
#: Fixed odd multipliers of the feature hash.
_LEFT, _RIGHT, _SKIP, _MIX = (
    np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(32))) * _MIX
    return value ^ (value >> np.uint64(29))


def features(texts: list[str], memo: _Words) -> tuple[np.ndarray, np.ndarray]:
    """``(document, feature)`` number pairs of the texts, with repeats.

    Words use the lower half of the feature numbers, pairs the upper half.
    """
    each = [[memo[w] for w in _WORD.findall(t.lower())] for t in texts]
    counts = np.array([len(w) for w in each], np.int64)
    words = np.fromiter((w for one in each for w in one), np.uint64, int(counts.sum()))
    doc = np.repeat(np.arange(len(texts)), counts)
    shift, upper = np.uint64(64 - BITS), np.int64(1 << BITS)
    docs, found = [doc], [(_mixed(words) >> shift).astype(np.int64)]
    for gap, factor in ((1, _RIGHT), (2, _SKIP)):
        if len(words) > gap:
            inside = doc[:-gap] == doc[gap:]
            pair = _mixed(words[:-gap] * _LEFT + words[gap:] * factor)
            found.append((pair[inside] >> shift).astype(np.int64) + upper)
            docs.append(doc[:-gap][inside])
    return np.concatenate(docs), np.concatenate(found)


def _distinct(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = np.int64(2 << BITS)
    keys = np.unique(doc * width + feature)
    return keys // width, keys % width


class Ftrl:
    """Per-coordinate FTRL-proximal state; the last coordinate is the bias."""

    def __init__(self) -> None:
        size = (2 << BITS) + 1
        self.z, self.n = np.zeros(size, np.float32), np.zeros(size, np.float32)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at].astype(np.float64), self.n[at].astype(np.float64)
        raw = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, raw)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at].astype(np.float64)
        sigma = (np.sqrt(n + error * error) - np.sqrt(n)) / ALPHA
        self.z[at] += (error - sigma * w).astype(np.float32)
        self.n[at] += np.float32(error * error)


@dataclass
class Model:
    """Features with a weight, sorted, and the bias."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, texts: list[str], memo: _Words, table: np.ndarray) -> np.ndarray:
        doc, feature = features(texts, memo)
        hit = table[feature] != 0
        doc, feature = _distinct(doc[hit], feature[hit])
        total = np.bincount(doc, table[feature].astype(np.float64), len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))

    def table(self) -> np.ndarray:
        dense = np.zeros(2 << BITS, np.float32)
        dense[self.feature] = self.weight
        return dense


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, epochs: int = EPOCHS) -> Model:
    """Learn ``labels.toxic`` from the rows that are not held out.

    Beyond ``max_rows`` labelled rows, those with the smallest hashes are taken.
    Their features go to one task, which is bounded by that number.
    """
    rows = labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = F.xxhash64("doc_id")
    sample = Stored(rows.withColumn("draw", draw).orderBy("draw", "doc_id").limit(max_rows), "toxic-sample")
    texts = bound_batches(docs).select("doc_id", text_of("text").alias("text")).join(F.broadcast(sample.df), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for batch in slices(batches, "text"):
            doc, feature = _distinct(*features(batch.column("text").to_pylist(), memo))
            cuts = np.searchsorted(doc, np.arange(1, batch.num_rows))
            lists = pa.array([x.astype(np.int32) for x in np.split(feature, cuts)], pa.list_(pa.int32()))
            columns = [batch.column("draw"), batch.column("doc_id"), batch.column("toxic"), lists]
            yield pa.RecordBatch.from_arrays(columns, ["draw", "doc_id", "toxic", "at"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"draw bigint, doc_id {kind}, toxic int, at array<int>"
    examples = Stored(texts.select("draw", "doc_id", "toxic", "text").mapInArrow(extract, schema), "toxic-examples")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, flat, sizes, labels = np.array([2 << BITS], np.int32), [], [], []
        for batch in batches:
            column = batch.column("at")
            flat.append(column.flatten().to_numpy(zero_copy_only=False).copy())
            sizes.append(np.diff(column.offsets.to_numpy()))
            labels += batch.column("toxic").to_pylist()
        state, order = Ftrl(), np.random.default_rng(0)
        if labels:
            values, stops = np.concatenate(flat), np.cumsum(np.concatenate(sizes))
            flat.clear()
            for _ in range(epochs):
                for k in order.permutation(len(labels)):
                    mine = values[stops[k - 1] if k else 0 : stops[k]]
                    state.learn(np.append(mine, bias), labels[k])
        used = np.flatnonzero(np.abs(state.z) > L1)
        weight = state.weights(used)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(weight)], ["feature", "weight"])

    one = examples.df.coalesce(1).sortWithinPartitions("draw", "doc_id").select("toxic", "at")
    learned = one.mapInArrow(train, "feature bigint, weight double").toPandas()
    feature, weight = learned["feature"].to_numpy(np.int64), learned["weight"].to_numpy(np.float64)
    is_bias = feature == 2 << BITS
    bias = float(weight[is_bias].sum())
    return Model(feature[~is_bias], weight[~is_bias].astype(np.float32), bias)


def _scorer(docs: DataFrame, model: Model):
    shared = bound_batches(docs).sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        memo, table = _Words(), shared.value.table()
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield batch, shared.value.score(texts, memo, table)

    return scores


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text."""
    scores = _scorer(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, value in scores(batches):
            predicted = (value >= threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value), pa.array(predicted)], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", text_of("text").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below ``threshold``, all columns as they are."""
    scores = _scorer(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, value in scores(batches):
            yield batch.filter(pa.array(value < threshold))

    return docs.mapInArrow(run, docs.schema)
