"""BPE encoding as a bounded-lookahead streaming transducer, decoding as a byte state machine.

A merge changes what lies to its left only through chains of later merges, each
of which takes over the left end of the one before.  ``sufficient_lookahead``
computes the longest such chain of a merge list in bytes.  A token that ends so
many bytes before the end of what has been read can't change any more: it is
emitted, and encoding goes on behind it as if the word began there.  So a word
of any length needs one window of memory.

The vocabulary file belongs to a public tokenizer and is a parameter; the driver
reads it (a few megabytes, whatever the input) and broadcasts it.

Defined cases: a null text is the empty text with no tokens; the strings of the
added tokens are tokens wherever they stand in a text; repeated rows are encoded
each; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceless.llm.shared import bound_batches, slices, text_of

#: Words whose tokens a task remembers, and the longest such word.
MEMO_WORDS, MEMO_CHARS = 150_000, 64
#: Symbols up to which a plain list is faster than a heap.
SHORT = 48
#: Ids decoded at once.
DECODE_IDS = 1 << 16
#: White space of the vocabulary's pattern; ``str.split`` knows these and four more.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_EXTRA_SPACE = "\x1c\x1d\x1e\x1f"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def load(path: str) -> dict:
    """What encoding needs of a tokenizer file: tokens, merges, pattern, added tokens."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    model = data["model"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    split = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    return {
        "vocab": model["vocab"],
        "merges": pairs,
        "suffix": model["end_of_word_suffix"] or "",
        "pattern": split,
        "added": {t["content"]: t["id"] for t in data["added_tokens"]},
    }


def sufficient_lookahead(merges: Iterable[tuple[str, str]], suffix: str = "") -> int:
    """Bytes behind a token that decide whether it is final, for any text.

    What is unknown behind the text read so far first touches its last token; a
    merge ``(s, t)`` then moves the touched end left by ``s``.  The next, later
    merge ``(s', t')`` must have a ``t'`` that grew from ``s`` at its left end.
    The bound is the largest sum of lengths over such chains of rising rank.
    """
    left_part: dict[str, str] = {}
    best: dict[str, int] = {}
    longest = 0
    for left, right in merges:
        chain, token = 0, right
        while token is not None:
            chain = max(chain, best.get(token, 0))
            token = left_part.get(token)
        reach = len(left.removesuffix(suffix) if suffix else left) + chain
        best[left] = max(best.get(left, 0), reach)
        left_part.setdefault(left + right, left)
        longest = max(longest, reach)
    return longest


class Transducer:
    """Text to token ids, word by word, in constant memory."""

    def __init__(self, model: dict) -> None:
        vocab, suffix = model["vocab"], model["suffix"]
        self.ranks: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks.setdefault((vocab[a], vocab[b]), rank)
        self.products = [vocab[a + b] for a, b in model["merges"]]
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.final = [vocab[c + suffix] for c in alphabet]
        self.lengths = {i: len(t.removesuffix(suffix) if suffix else t) for t, i in vocab.items()}
        self.lookahead = sufficient_lookahead(model["merges"], suffix)
        self.window = 4 * (self.lookahead + max(self.lengths.values()))
        self.added = model["added"]
        names = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.added_split = re.compile(f"({'|'.join(names)})") if names else None
        # the pattern's own white space class, spelled out
        self.pieces = regex.compile(model["pattern"].replace(r"[^\s", f"[^{_SPACE}"))
        self.spaces = re.compile(f"[{_SPACE}]+")
        self.memo = _Memo(self.word)
        self.piece_memo = _Memo(self.piece)

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian 32-bit numbers, a run at a time."""
        parts = self.added_split.split(text) if self.added_split else [text]
        for part in parts:
            if part in self.added:
                yield self.added[part].to_bytes(4, "little")
            elif part:
                plain = unicodedata.normalize("NFC", part)
                # lower case letter by letter: no final sigma
                plain = plain.replace("Σ", "σ").lower()
                odd = any(c in plain for c in _EXTRA_SPACE)
                words = self.spaces.split(plain) if odd else plain.split()
                for at in range(0, len(words), DECODE_IDS):
                    yield b"".join([self.memo[w] for w in words[at : at + DECODE_IDS]])

    def word(self, word: str) -> bytes:
        """Ids of a run without white space."""
        return b"".join([self.piece_memo[p] for p in self.pieces.findall(word)])

    def piece(self, piece: str) -> bytes:
        ids = np.fromiter(self.stream(piece.encode("utf-8", "surrogatepass")), "<u4")
        return ids.tobytes()

    def stream(self, data: bytes) -> Iterator[int]:
        """Tokens of one piece; each is given as soon as it is final."""
        start = 0
        while start < len(data):
            stop = min(len(data), start + self.window)
            symbols = [self.inner[b] for b in data[start:stop]]
            if stop == len(data):
                symbols[-1] = self.final[data[-1]]
                yield from self.merged(symbols)
                return
            stable = stop - self.lookahead
            for token in self.merged(symbols):
                if start + self.lengths[token] > stable:
                    break
                yield token
                start += self.lengths[token]

    def merged(self, ids: list[int]) -> list[int]:
        """Merge the pair of lowest rank, the leftmost first, until none is left."""
        if len(ids) > SHORT:
            return self.merged_by_heap(ids)
        get, none = self.ranks.get, len(self.products)
        ranks = [get(pair, none) for pair in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            ids[i] = self.products[low]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def merged_by_heap(self, ids: list[int]) -> list[int]:
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[pair], i, pair) for i, pair in enumerate(zip(ids, ids[1:])) if pair in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = self.products[rank], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (ids[a], ids[b]) in ranks:
                    heapq.heappush(heap, (ranks[ids[a], ids[b]], a, (ids[a], ids[b])))
        return [i for i in ids if i >= 0]


class _Memo(dict):
    """Results for texts seen before; started anew when it is full."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make = make

    def __missing__(self, text: str) -> bytes:
        found = self.make(text)
        if len(text) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[text] = found
        return found


class Decoder:
    """Token ids to text: bytes go through an incremental UTF-8 state machine.

    ``as_library`` gives the library's text for a file without a decoder: token
    strings with a space between.  Otherwise a word end becomes a space and the
    bytes are those that were encoded.
    """

    def __init__(self, model: dict, as_library: bool = True) -> None:
        names = {i: t for t, i in [*model["vocab"].items(), *model["added"].items()]}
        self.table: list[bytes] = [b""] * (max(names) + 1)
        values = {c: b for b, c in enumerate(byte_alphabet())}
        suffix = model["suffix"]
        for i, token in names.items():
            if as_library or token in model["added"]:
                self.table[i] = token.encode()
            else:
                ends = bool(suffix) and token.endswith(suffix)
                core = token[: -len(suffix)] if ends else token
                self.table[i] = bytes(values[c] for c in core) + b" " * ends
        self.gap = b" " if as_library else b""
        self.start()

    def start(self) -> None:
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: list[int]) -> str:
        """Text that these ids complete; at most three bytes wait for the next ones."""
        if not ids:
            return ""
        data = self.gap.join([self.table[i] for i in ids])
        data, self.begun = (self.gap if self.begun else b"") + data, True
        return self.state.decode(data)

    def end(self) -> str:
        return self.state.decode(b"", True)


def _tools(shared, cache: dict = {}) -> tuple[Transducer, Decoder]:  # noqa: B006  one per worker process
    if shared.value["key"] not in cache:
        cache.clear()
        model = shared.value["model"]
        cache[shared.value["key"]] = (Transducer(model), Decoder(model))
    return cache[shared.value["key"]]


def _shared(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast({"key": path, "model": load(path)})


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` of every whole text."""
    shared = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = _tools(shared)
        for batch in slices(batches, "text"):
            rows = [np.frombuffer(b"".join(encoder.encode(t)), "<u4").astype(np.int32) for t in batch.column("text").to_pylist()]
            ids = pa.array(rows, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bound_batches(docs).select("doc_id", text_of("text").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text.

    Ids are decoded as they are made, a run at a time, so a document needs no
    memory beside its text.
    """
    shared = _shared(docs, path)

    def one(text: str, encoder: Transducer, decoder: Decoder) -> tuple[int, str, str]:
        ids_hash, text_hash, count = hashlib.sha256(), hashlib.sha256(), 0
        decoder.start()
        for run in encoder.encode(text):
            ids_hash.update(run)
            ids = np.frombuffer(run, "<u4").tolist()
            count += len(ids)
            text_hash.update(decoder.feed(ids).encode())
        text_hash.update(decoder.end().encode())
        return count, ids_hash.hexdigest(), text_hash.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _tools(shared)
        for batch in slices(batches, "text"):
            rows = [one(t, encoder, decoder) for t in batch.column("text").to_pylist()]
            counts, ids, texts = zip(*rows) if rows else ((), (), ())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return bound_batches(docs).select("doc_id", text_of("text").alias("text")).mapInArrow(run, schema)
