"""Conversation repair: the cheapest edits that make the turns alternate, by a run-length DP.

A row is a symbol: its role's initial (system, user, assistant, other) with its first
fault (blank, duplicate, truncated or none).  Roles so far put the output into one of four
states (nothing, system, user, assistant); a symbol is a 4 x 4 min-plus matrix of the
cheapest edits from state to state, insertions before the row included.  Equal consecutive
symbols are one run, advanced through the binary powers of its matrix, which a worker
computes once and keeps.  An entry holds its cost and the letters of its choices, so that
of equally cheap ways the ASCII-least one wins; this is sound because of two equally long
ways over the same rows none is the beginning of the other.  The letters are then
unrolled over the rows to give the repaired text.

Matrices are associative, so a conversation of any length is cut into segments of
``SEGMENT_ROWS`` rows or ``SEGMENT_BYTES``, each multiplied out by itself; a balanced product
joins a conversation's segments.  Its texts are never together: segments are repaired where
they lie and hashed one after another.  What one row holds of a conversation is the audit,
a letter per row, and the sixteen candidates for it.

Defined cases: rows go by turn (nulls first), equal turns by role and SHA-256 of the text;
a null role or text is one space; a row is a duplicate if an earlier one has its role and
text, whatever the fault of either; a role whose initial is not s, u or a can be changed
or deleted, not kept; rows without a ``conv_id`` are one conversation; conversations
without rows have zeros and empty texts; texts of any length cost one pass; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceless.llm.shared import attach, bound_batches, maybe_broadcast
from traceless.operators.ranking import running_sum
from traceless.plans.workspace import Stored

SEGMENT_ROWS = 2048
SEGMENT_BYTES = 4 << 20
KEEP, RETRUNCATE, REROLE, DELETE, INSERT = 0, 3, 3, 4, 3
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: States in which the repaired conversation may end.
ENDS = (START, ASSISTANT)
#: Faults of a symbol; a row with one beyond ``TRUNCATED`` must go.
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
#: A role that can't be kept; no state has this number.
OTHER = 4
_SPACE = " \t\n\x0b\x0c\r"

#: ``matrix[i][j]``: cost and letters of the cheapest way from state i to j, None without one.
Entry = tuple[int, str] | None
Matrix = tuple[tuple[Entry, ...], ...]


def next_role(state: int) -> int:
    """The state after a row whose role may be chosen."""
    return ASSISTANT if state == USER else USER


def product(left: Matrix, right: Matrix) -> Matrix:
    """Min-plus product; the least letters among equal costs."""
    rows = []
    for row in left:
        best: list[Entry] = [None] * len(STATES)
        for middle, first in enumerate(row):
            if first is None:
                continue
            for to, second in enumerate(right[middle]):
                if second is None or (best[to] is not None and first[0] + second[0] > best[to][0]):
                    continue
                way = (first[0] + second[0], first[1] + second[1])
                if best[to] is None or way < best[to]:
                    best[to] = way
        rows.append(tuple(best))
    return tuple(rows)


def _matrix(edges: list[tuple[int, int, int, str]]) -> Matrix:
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start, to, cost, letter in edges:
        best[start, to] = min(best.get((start, to), (cost, letter)), (cost, letter))
    return tuple(tuple(best.get((i, j)) for j in STATES) for i in STATES)


_STEPS = [(i, i, 0, "") for i in STATES] + [(i, next_role(i), INSERT, "I") for i in STATES]
#: Any number of insertions; two lead from every state to all that can be reached.
INSERTS: Matrix = product(_matrix(_STEPS), _matrix(_STEPS))


@lru_cache(maxsize=None)
def power(role: int, fault: int, exponent: int) -> Matrix:
    """The transition of ``2 ** exponent`` equal rows."""
    if exponent:
        half = power(role, fault, exponent - 1)
        return product(half, half)
    edges = [(i, i, DELETE, "D") for i in STATES]
    if fault <= TRUNCATED:
        extra = RETRUNCATE if fault == TRUNCATED else 0
        edges += [(i, next_role(i), REROLE + extra, "R") for i in STATES]
        if role == SYSTEM:
            edges.append((START, SYSTEM, KEEP + extra, "K"))
        elif role in (USER, ASSISTANT):
            edges += [(i, role, KEEP + extra, "K") for i in STATES if next_role(i) == role]
    return product(INSERTS, _matrix(edges))


def advance(matrix: Matrix, symbols: list[tuple[int, int]]) -> Matrix:
    """The matrix after further rows, run by run."""
    for (role, fault), run in groupby(symbols):
        length = sum(1 for _ in run)
        exponent = 0
        while length:
            if length & 1:
                matrix = product(matrix, power(role, fault, exponent))
            length >>= 1
            exponent += 1
    return matrix


def identity(starts: tuple[int, ...]) -> Matrix:
    """The ways that begin in ``starts`` and have read nothing."""
    return tuple(tuple((0, "") if i == j and i in starts else None for j in STATES) for i in STATES)


def join(matrices: list[Matrix]) -> tuple[Entry, list[tuple[int, str]]]:
    """Cost and letters of a whole conversation, and per segment its first state and letters."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([product(*last[k : k + 2]) if k + 1 < len(last) else last[k] for k in range(0, len(last), 2)])
    ends = product((levels[-1][0][START],), INSERTS)[0]
    whole = min(ends[j] for j in ENDS if ends[j] is not None)
    # the way down: which state each product's halves meet in
    final = [j for j in STATES if levels[-1][0][START][j] is not None]
    last_state = next(j for j in final if any(_added(levels[-1][0][START][j], INSERTS[j][e]) == whole for e in ENDS))
    spans = [(START, last_state)]
    for below in reversed(levels[:-1]):
        parts = []
        for k, (i, j) in enumerate(spans):
            if 2 * k + 1 == len(below):
                parts.append((i, j))
                continue
            left, right = below[2 * k], below[2 * k + 1]
            ways = [(way, m) for m in STATES if (way := _added(left[i][m], right[m][j])) is not None]
            middle = min(ways)[1]
            parts += [(i, middle), (middle, j)]
        spans = parts
    pieces = [(i, matrix[i][j][1]) for matrix, (i, j) in zip(matrices, spans)]
    tail = whole[1][sum(len(p) for _, p in pieces) :]
    pieces[-1] = (pieces[-1][0], pieces[-1][1] + tail)
    return whole, pieces


def _added(first: Entry, second: Entry) -> Entry:
    return None if first is None or second is None else (first[0] + second[0], first[1] + second[1])


def unroll(state: int, letters: str, roles: list[str], texts: list[str], user: str, assistant: str) -> list[str]:
    """The repaired ``role:text`` of a segment."""
    names, lines, row = {USER: user, ASSISTANT: assistant}, [], 0
    for letter in letters:
        if letter == "I":
            state = next_role(state)
            lines.append(f"{names[state]}:")
            continue
        if letter == "R":
            state = next_role(state)
            lines.append(f"{names[state]}:{texts[row]}")
        elif letter == "K":
            state = SYSTEM if roles[row].startswith("s") else next_role(state)
            lines.append(f"{roles[row]}:{texts[row]}")
        row += 1
    return lines


def _symbol(role: Column) -> Column:
    initial = F.substring(role, 1, 1)
    return F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)


def segments(rows: DataFrame, segment_rows: int, segment_bytes: int) -> tuple[Stored, Stored]:
    """Segments ``conv, segment, rows`` with roles, texts and faults, and ``conv, gaps``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    plain = bound_batches(rows).select(
        conversation_key().alias("conv"),
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        text.alias("text"),
        F.sha2(text, 256).alias("sha"),
        F.monotonically_increasing_id().alias("row"),
    )
    share = F.greatest(F.octet_length("text") + 64, F.lit(segment_bytes // segment_rows))
    plain = plain.withColumns({"one": F.lit(1).cast("long"), "share": share.cast("long")})
    order = [F.col("turn").asc_nulls_first(), "role", "sha", "row"]
    ordered = running_sum(plain, ["conv"], order, {"position": "one", "until": "share"})
    slim = Stored(ordered.select("conv", "turn", "position", "role", "sha"), "turn-order")
    same = ["conv", "role", "sha"]
    groups = slim.df.groupBy(*same).agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n"))
    copies = attach(slim, Stored(groups.where("n > 1"), "same-turns"), same, "n").where("position > first")
    copies = Stored(copies.select("conv", "position", F.lit(True).alias("again")), "later-turns")
    gap = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    gaps = Stored(slim.df.groupBy("conv").agg(gap.alias("gaps")), "turn-gaps")
    trimmed = F.rtrim("text", F.lit(_SPACE))
    fault = (
        F.when(trimmed == "", BLANK)
        .when(F.col("again"), DUPLICATE)
        .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), TRUNCATED)
        .otherwise(SOUND)
    )
    marked = ordered.join(maybe_broadcast(copies), ["conv", "position"], "left")
    entry = F.struct("position", "role", "text", _symbol(F.col("role")).alias("symbol"), fault.alias("fault"))
    segment = F.floor((F.col("until") - F.col("share")) / segment_bytes).cast("long").alias("segment")
    grouped = marked.groupBy("conv", segment).agg(F.sort_array(F.collect_list(entry)).alias("rows"))
    return Stored(grouped, "turn-segments"), gaps


def conversation_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


_MATRIX = "costs array<bigint>, letters array<string>"
_COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def _multiplied(found: DataFrame) -> DataFrame:
    """Matrix, fault counts and first and last initials of every segment."""
    narrow = found.select(
        "conv",
        "segment",
        F.col("rows.symbol").alias("symbol"),
        F.col("rows.fault").alias("fault"),
        F.transform("rows", lambda r: F.substring(r["role"], 1, 1)).alias("initial"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                faults, initials = row["fault"], row["initial"]
                # the first segment can begin in one state only
                starts = (START,) if row["segment"] == 0 else tuple(STATES)
                entries = [e for line in advance(identity(starts), list(zip(row["symbol"], faults))) for e in line]
                pairs = zip(initials, initials[1:])
                out.append(
                    {
                        "conv": row["conv"],
                        "segment": row["segment"],
                        "costs": [e and e[0] for e in entries],
                        "letters": [e and e[1] for e in entries],
                        "blank": faults.count(BLANK),
                        "duplicate": faults.count(DUPLICATE),
                        "truncated": faults.count(TRUNCATED),
                        "illegal": sum(not legal(a, b) for a, b in pairs),
                        "first": initials[0],
                        "last": initials[-1],
                    }
                )
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema(
        [("conv", pa.string()), ("segment", pa.int64()), ("costs", pa.list_(pa.int64())), ("letters", pa.list_(pa.string()))]
        + [(c, pa.int64()) for c in _COUNTS]
        + [("first", pa.string()), ("last", pa.string())]
    )
    counts = ", ".join(f"{c} bigint" for c in _COUNTS)
    return narrow.mapInArrow(run, f"conv string, segment bigint, {_MATRIX}, {counts}, first string, last string")


def legal(one: str, other: str) -> bool:
    """Whether two adjacent initials may follow each other."""
    return (one, other) in (("s", "u"), ("u", "a"), ("a", "u"))


def _joined(matrices: DataFrame) -> DataFrame:
    """Per conversation its counts, cost, audit and the pieces of its segments."""
    columns = ["segment", "costs", "letters", *_COUNTS, "first", "last"]
    grouped = matrices.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(STATES)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                parts, found = row["parts"], []
                for part in parts:
                    flat = [None if c is None else (c, x) for c, x in zip(part["costs"], part["letters"])]
                    found.append(tuple(tuple(flat[k : k + n]) for k in range(0, n * n, n)))
                (cost, audit), pieces = join(found)
                between = sum(not legal(a["last"], b["first"]) for a, b in zip(parts, parts[1:]))
                counts = {c: sum(p[c] for p in parts) for c in _COUNTS}
                counts["illegal"] += between
                spread = [{"segment": p["segment"], "state": s, "letters": x} for p, (s, x) in zip(parts, pieces)]
                out.append({"conv": row["conv"], **counts, "cost": cost, "audit": audit, "pieces": spread})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    piece = pa.struct([("segment", pa.int64()), ("state", pa.int32()), ("letters", pa.string())])
    schema = pa.schema(
        [("conv", pa.string())] + [(c, pa.int64()) for c in [*_COUNTS, "cost"]] + [("audit", pa.string()), ("pieces", pa.list_(piece))]
    )
    counts = ", ".join(f"{c} bigint" for c in [*_COUNTS, "cost"])
    kind = f"conv string, {counts}, audit string, pieces array<struct<segment: bigint, state: int, letters: string>>"
    return grouped.mapInArrow(run, kind)


def _repaired(found: DataFrame, verdicts: DataFrame, user: str, assistant: str) -> DataFrame:
    """``conv, segment, parts, lines``: the repaired rows of every segment."""
    pieces = verdicts.select("conv", F.size("pieces").alias("parts"), F.explode("pieces").alias("p"))
    pieces = pieces.select("conv", "parts", "p.segment", "p.state", "p.letters")
    both = found.join(pieces, ["conv", "segment"]).select(
        "conv", "segment", "parts", "state", "letters", F.col("rows.role").alias("role"), F.col("rows.text").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [
                unroll(r["state"], r["letters"], r["role"], r["text"], user, assistant) for r in batch.to_pylist()
            ]
            plain = [batch.column(c) for c in ("conv", "segment", "parts")]
            yield pa.RecordBatch.from_arrays([*plain, pa.array(lines, pa.list_(pa.string()))], ["conv", "segment", "parts", "lines"])

    return both.mapInArrow(run, "conv string, segment bigint, parts int, lines array<string>")


def _hashed(repaired: Stored) -> DataFrame:
    """``conv, repaired_sha256``; longer conversations are read segment by segment."""
    whole = repaired.df.where("parts = 1").select("conv", F.sha2(F.array_join("lines", "\n"), 256).alias("repaired_sha256"))
    rest = repaired.df.where("parts > 1").repartition("conv").sortWithinPartitions("conv", "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, begun = None, None, False
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if digest is None or row["conv"] != conv:
                    if digest is not None:
                        yield _digest_row(conv, digest)
                    conv, digest, begun = row["conv"], hashlib.sha256(), False
                for line in row["lines"]:
                    digest.update(("\n" * begun + line).encode())
                    begun = True
        if digest is not None:
            yield _digest_row(conv, digest)

    return whole.unionByName(rest.select("conv", "lines").mapInArrow(run, "conv string, repaired_sha256 string"))


def _digest_row(conv: str, digest) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": digest.hexdigest()}])


def repair(
    rows: DataFrame,
    conversations: DataFrame | None = None,
    user: str = "user",
    assistant: str = "assistant",
    segment_rows: int = SEGMENT_ROWS,
    segment_bytes: int = SEGMENT_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Verdicts per conversation and the repaired rows.

    Verdicts: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``, for every ``conv_id`` of ``conversations`` (default: of ``rows``).
    Repaired rows: ``conv, segment, lines``, in order of segments.
    """
    found, gaps = segments(rows, segment_rows, segment_bytes)
    verdicts = Stored(_joined(_multiplied(found.df)), "repair-verdicts")
    repaired = Stored(_repaired(found.df, verdicts.df, user, assistant), "repaired")
    shas = Stored(_hashed(repaired), "repaired-hashes")
    ids = (conversations if conversations is not None else rows).select(conversation_key().alias("conv"), "conv_id").distinct()
    known = verdicts.df.drop("pieces").join(gaps.df, "conv").join(shas.df, "conv")
    both = ids.join(known, "conv", "left")
    numbers = ["gaps", *_COUNTS, "cost"]
    result = both.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
    return result, repaired.df.select("conv", "segment", "lines")


def damage(rows: DataFrame) -> DataFrame:
    """Rows with faults drawn by a checksum of conversation and turn, for tests of a repair.

    Of twenty draws one drops the row, one empties its text, one takes its sentence marks,
    one repeats it and one makes it the user's.
    """
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    drawn = rows.select("conv_id", "turn", "role", "text", F.pmod(F.crc32(name), F.lit(20)).alias("draw"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(F.col("draw") == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), F.lit(" ")))
    copies = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return drawn.where("draw <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies)
