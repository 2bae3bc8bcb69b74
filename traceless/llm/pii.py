"""Personal data by candidate gradient boosting.

Four base formats are always redacted.  Beside them, generators of high recall
propose overlapping spans (numbers with any separators, spelled-out addresses),
each under every kind it could be.  Boosted trees score a proposal by format and
context features, a calibration fold turns scores into probabilities and sets the
threshold of each kind, and the best proposals that overlap nothing are added.

The trees learn from a sample of about ``SAMPLE_DOCS`` documents with digits or
``@`` in them: a proposal that is a base span is a positive, and so are copies of
it in other clothes (no plus, other separators, ``at`` and ``dot`` spelled out);
other proposals and copies with a broken digit are negatives.

Defined cases: a null text is the empty text without spans; repeated rows are
searched each; without any proposal in the sample only base spans are found; an
empty table gives no rows.  Patterns run in time linear in the text: addresses are
searched from their ``@``, digit runs are never given back.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceless.llm.shared import bound_batches, slices, text_of
from traceless.plans.workspace import Stored

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 8192
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
#: Precision that a kind's threshold reaches on the calibration fold, and its least value.
PRECISION, LEAST = 0.99, 0.7
CONTEXT = 32

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])[+(]{0,2}[0-9](?:[ ().\-/]{0,2}[0-9]){6,24}")
_SPELLED = re.compile(
    r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]|(?<= )at(?= )) ?[A-Za-z0-9-]{1,63}"
    r"(?: ?(?:\.|\(dot\)|\[dot\]|(?<= )dot(?= )) ?[A-Za-z0-9-]{2,63}){1,4}"
)
_HINT = re.compile(r"card|visa|pay|iban|tel|phone|call|fax|mobile|mail|host|addr|contact|\bip\b", re.I)

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, each found from its ``@``."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(map(_octet, m[0].split("."))):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def proposals(text: str) -> list[Span]:
    """Spans that may be personal data, under each kind they could be."""
    found = []
    if "@" in text or "(at" in text or "[at" in text or (" at " in text and " dot " in text):
        found += [(m.start(), 0, m.end()) for m in _SPELLED.finditer(text)]
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            kinds = [k for k in (2, 3) if k == 3 or len(_DIGIT.findall(m[0])) >= 12]
            kinds += [1] * (m[0].count(".") >= 3)
            found += [(m.start(), k, m.end()) for k in kinds]
    return found


def describe(left: str, span: str, right: str, kind: int) -> list[int]:
    """Format and context features of a proposal, all small numbers."""
    digits = [c for c in span if c.isdigit()]
    groups = re.findall(r"[0-9]+", span) or [""]
    marks = [c for c in span if not c.isalnum()]
    before, after = left[-1:], right[:1]
    return [
        *[int(kind == k) for k in range(4)],
        len(span),
        len(digits),
        len(span) - len(digits) - len(marks),
        len(marks),
        len(set(marks)),
        len(groups),
        max(map(len, groups)),
        min(map(len, groups)),
        int("+" in span),
        int("(" in span and ")" in span),
        int(len(digits) >= 12 and luhn("".join(digits))),
        int(len(groups) == 4 and all(map(_octet, groups))),
        int("@" in span) + 2 * int(bool(re.search(r"\bat\b", span))),
        int(before.isalnum() or before in "\"'=_"),
        int(after.isalnum() or after in "\"'=_"),
        int(bool(_HINT.search(left))),
        int(before in ".-/+"),
    ]


def _around(text: str, start: int, end: int) -> tuple[str, str, str]:
    return text[max(0, start - CONTEXT) : start], text[start:end], text[end : end + CONTEXT]


def examples(text: str) -> Iterator[tuple[list[int], int]]:
    """Features and weak labels of a text's proposals and of altered copies."""
    base = set(base_spans(text))
    for start, kind, end in proposals(text):
        left, span, right = _around(text, start, end)
        good = (start, kind, end) in base
        yield describe(left, span, right, kind), int(good)
        if good:
            for other, label in _altered(span, kind):
                yield describe(left, other, right, kind), label


def _altered(span: str, kind: int) -> list[tuple[str, int]]:
    last = span[:-1] + str((int(span[-1]) + 1) % 10) if span[-1:].isdigit() else span
    if kind == 0:
        name, _, rest = span.partition("@")
        return [(f"{name} at {rest.replace('.', ' dot ')}", 1), (f"{name}(at){rest}", 1), (f"{name} at {rest.split('.')[0]}", 0)]
    if kind == 1:
        return [("9" + span, 0), (span.rpartition(".")[0], 0)]
    if kind == 2:
        digits = re.sub("[ -]", "", span)
        return [(".".join(digits[k : k + 4] for k in range(0, len(digits), 4)), 1), (last, 0)]
    bare = span.lstrip("+")
    return [(bare, 1), (re.sub(r"[ ()-]+", ".", bare), 1), (re.sub(r"[^0-9]", "", span)[:8], 0), (bare * 2, 0)]


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> list[dict]:
    """Trees of logistic gradient boosting over histograms; nodes in heap order."""
    x = np.clip(x, 0, BINS - 1)
    score, model = np.zeros(len(y)), []
    rows, width = np.arange(len(y)), x.shape[1]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        feature, cut = [], []
        for level in range(depth):
            count = 1 << level
            index = (node[:, None] * width + np.arange(width)) * BINS + x
            sums = [
                np.bincount(index.ravel(), np.repeat(v, width), count * width * BINS).reshape(count, width, BINS).cumsum(axis=2)
                for v in (g, h)
            ]
            gl, hl = sums
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            best = gain.reshape(count, -1).argmax(axis=1)
            feature += (best // BINS).tolist()
            cut += (best % BINS).tolist()
            node = 2 * node + (x[rows, best[node] // BINS] > best[node] % BINS)
        leaves = 1 << depth
        leaf = rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1)
        score += leaf[node]
        model.append({"feature": feature, "cut": cut, "leaf": leaf.tolist()})
    return model


def margin(model: list[dict], x: np.ndarray) -> np.ndarray:
    x = np.clip(x, 0, BINS - 1)
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for tree in model:
        feature, cut = np.array(tree["feature"]), np.array(tree["cut"])
        node, first = np.zeros(len(x), np.int64), 0
        while first < len(feature):
            at = first + node
            node = 2 * node + (x[rows, feature[at]] > cut[at])
            first = 2 * first + 1
        total += np.array(tree["leaf"])[node]
    return total


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of Platt's logistic map, by Newton steps."""
    a = np.array([1.0, 0.0])
    x = np.stack([score, np.ones(len(score))], axis=1)
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        w = p * (1 - p) + 1e-6
        a = a + np.linalg.solve((x * w[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (y - p) - 1e-3 * a)
    return float(a[0]), float(a[1])


def learn(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> dict:
    """Trees from four folds, calibration and thresholds per kind from the fifth."""
    held = fold == 0
    trees = boost(x[~held], y[~held])
    score = margin(trees, x[held])
    slope, shift = calibrate(score, y[held])
    p = 1 / (1 + np.exp(-np.clip(slope * score + shift, -30, 30)))
    limits = []
    for kind in range(len(KINDS)):
        mine = x[held][:, kind] == 1
        order = np.argsort(-p[mine])
        good = np.cumsum(y[held][mine][order]) / np.arange(1, mine.sum() + 1)
        enough = np.flatnonzero(good >= PRECISION)
        limits.append(max(LEAST, float(p[mine][order][enough[-1]])) if len(enough) else 2.0)
    return {"trees": trees, "slope": slope, "shift": shift, "limits": limits}


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict | None:
    """Model from a hash sample of the documents that have digits or ``@``.

    About ``sample_docs`` documents, whatever the table's size, go to one task as
    feature rows; the model that comes back is a few kilobytes.
    """
    texts = bound_batches(docs).select(text_of("text").alias("text")).where(F.col("text").rlike("[0-9@]"))
    texts = texts.withColumn("draw", F.pmod(F.xxhash64("text"), F.lit(1 << 30)))
    total = texts.count()
    chosen = texts.where(F.col("draw") < int(min(1.0, sample_docs / max(1, total)) * (1 << 30))).distinct()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [
                {"x": x, "y": y, "draw": draw}
                for text, draw in zip(batch.column("text").to_pylist(), batch.column("draw").to_pylist())
                for x, y in examples(text)
            ]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("x", pa.list_(pa.int32())), ("y", pa.int32()), ("draw", pa.int64())]))

    found = Stored(chosen.mapInArrow(extract, "x array<int>, y int, draw bigint"), "pii-examples")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        y = np.array([r["y"] for r in rows], np.int64)
        fold = np.array([r["draw"] % 5 for r in rows], np.int64)
        if len({*y[fold > 0]}) < 2 or len({*y[fold == 0]}) < 2:
            return
        model = learn(np.array([r["x"] for r in rows], np.int64), y, fold)
        yield pa.RecordBatch.from_pydict({"model": [json.dumps(model)]})

    one = found.df.coalesce(1).sortWithinPartitions("draw", "x", "y")
    learned = one.mapInArrow(train, "model string").first()
    return json.loads(learned.model) if learned else None


def added_spans(text: str, base: list[Span], model: dict) -> list[Span]:
    """The best proposals that reach their kind's threshold and overlap nothing."""
    offered = proposals(text)
    if not offered:
        return []
    x = np.array([describe(*_around(text, s, e), k) for s, k, e in offered])
    raw = model["slope"] * margin(model["trees"], x) + model["shift"]
    p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
    taken, found = bytearray(len(text)), []  # a byte per character that a span covers
    for start, _, end in base:
        taken[start:end] = b"\1" * (end - start)
    for i in np.argsort(-p, kind="stable"):
        start, kind, end = offered[i]
        if p[i] >= model["limits"][kind] and not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            found.append(offered[i])
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find(docs: DataFrame, model: dict | None) -> DataFrame:
    """``doc_id``, base counts, ``base_sha256`` and all ``spans`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, hashes, spans = [], [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                more = added_spans(text, base, shared.value) if shared.value else []
                counts.append([sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))])
                hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + more))
            columns = [pa.array(c, pa.int64()) for c in zip(*counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns, pa.array(hashes), pa.array(spans)], ["doc_id", *names, "base_sha256", "spans"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{n} bigint" for n in names)
    texts = bound_batches(docs).select("doc_id", text_of("text").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def redact(text: str, spans: str) -> str:
    """The text with every span replaced by its kind in brackets; overlaps fall together."""
    parts, done = [], 0
    for item in filter(None, spans.split(",")):
        kind, start, end = item.split(":")
        if int(start) >= done:
            parts += [text[done : int(start)], f"[{kind.upper()}]"]
        done = max(done, int(end))
    return "".join(parts) + text[done:]
