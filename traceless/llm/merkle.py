"""Merkle manifest of a table: a tree of SHA-256 midstates.

A parent's digest is the hash of its children's digests as hex text.  Such a digest
has 64 bytes, one block of SHA-256, so a parent keeps the hash's chaining value
*before each child slot* (32 bytes a slot).  To fold a changed child upwards, the
state of its slot is resumed with the replacement and the siblings to its right;
what lies to its left is never hashed again.

Leaves of a group ascend by ``order`` and are cut into blocks of ``arity ** DEPTH``
leaves, each a whole subtree, so one task builds one block's levels.  The blocks'
tops are the nodes of the next round; rounds go with the logarithm of the group's
size to the base of a block (three for 10^9 leaves), and a group with a third of all
rows is as many blocks as its share.  On the way down every block gets its path:
per level the state before its slot and the siblings on both sides.  No tree, group or
list of digests passes through the driver.

Defined cases: a null field is written ``-``; a null group is a group of its own and
comes first; rows without an ``order`` value come first in their group; rows equal in
``order`` are put in order by their leaf, equal rows stay separate leaves; a lone node
at the end of a level is hashed alone; a lone leaf is its own subroot, a lone
subroot the root; the proof of a table of one row is the hash of nothing; texts are
hashed whole by Spark, whatever their length; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceless.llm.shared import bound_batches, maybe_broadcast
from traceless.operators.ranking import group_rank
from traceless.plans.workspace import Stored

#: Levels of a block.
DEPTH = 11
#: A step of a path: the parent's state before the slot and the siblings' digests on both sides.
PATH = "array<struct<before: binary, left: binary, right: binary>>"
_PATH = pa.list_(pa.struct([(name, pa.binary()) for name in ("before", "left", "right")]))
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _cube_root(n: int) -> int:
    root = round(n ** (1 / 3))
    while root**3 > n:
        root -= 1
    while (root + 1) ** 3 <= n:
        root += 1
    return root


def _primes(count: int) -> list[int]:
    found: list[int] = []
    n = 2
    while len(found) < count:
        if all(n % p for p in found):
            found.append(n)
        n += 1
    return found


#: SHA-256 takes its constants from the fractions of roots of the first primes.
_START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
_ROUNDS = [np.uint32(_cube_root(p << 96) & 0xFFFFFFFF) for p in _primes(64)]


def _rotated(x: np.ndarray, *by: int) -> np.ndarray:
    """The words rotated right by each of ``by``, combined by exclusive or."""
    result = (x >> np.uint32(by[0])) | (x << np.uint32(32 - by[0]))
    for n in by[1:]:
        result ^= (x >> np.uint32(n)) | (x << np.uint32(32 - n))
    return result


def advance(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Chaining values (8 words each, one hash a column) after one more block of 16 words each."""
    w = list(words)
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        if t >= 16:
            early, late = w[(t - 15) % 16], w[(t - 2) % 16]
            near = _rotated(early, 7, 18) ^ (early >> np.uint32(3))
            far = _rotated(late, 17, 19) ^ (late >> np.uint32(10))
            w[t % 16] = w[t % 16] + near + w[(t - 7) % 16] + far
        one = h + _rotated(e, 6, 11, 25) + (g ^ (e & (f ^ g))) + (w[t % 16] + _ROUNDS[t])
        two = _rotated(a, 2, 13, 22) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def fresh(n: int) -> np.ndarray:
    """The state of ``n`` hashes that have read nothing."""
    return np.repeat(_START[:, None], n, axis=1)


def words_of(digests: np.ndarray) -> np.ndarray:
    """Digests (64 characters a row) as blocks of 16 words a column."""
    return np.ascontiguousarray(np.ascontiguousarray(digests).view(">u4").T).astype(np.uint32)


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests as hex text, a row each, of hashes that have read so many blocks."""
    tail = np.zeros((16, state.shape[1]), np.uint32)
    tail[0] = 0x80000000
    bits = np.asarray(blocks, np.uint64) * np.uint64(512)
    tail[14], tail[15] = bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    found = np.ascontiguousarray(advance(state, tail).T).astype(">u4").view(np.uint8)
    return _HEX[np.stack([found >> 4, found & 15], axis=2)].reshape(len(found), 64)


class Level:
    """The nodes of a level with their parents: states before each slot, counts of children."""

    def __init__(self, children: np.ndarray, arity: int) -> None:
        self.arity, self.children, self.words = arity, children, words_of(children)
        parents = -(-len(children) // arity)
        self.counts = np.minimum(arity, len(children) - arity * np.arange(parents))
        self.before = np.empty((arity, 8, parents), np.uint32)
        state = fresh(parents)
        for slot in range(arity):
            self.before[slot] = state
            some = int((self.counts > slot).sum())
            state[:, :some] = advance(state[:, :some], self.words[:, slot::arity])
        self.digests = finish(state, self.counts)

    def fold(self, index: np.ndarray, digests: np.ndarray) -> np.ndarray:
        """Parents' digests if the nodes ``index`` had these digests, each change by itself."""
        parent, slot = np.divmod(index, self.arity)
        state = advance(np.ascontiguousarray(self.before[slot, :, parent].T), words_of(digests))
        for step in range(1, self.arity):
            some = slot + step < self.counts[parent]
            state[:, some] = advance(state[:, some], self.words[:, index[some] + step])
        return finish(state, self.counts[parent])

    def add_siblings(self, index: np.ndarray, state: np.ndarray, read: np.ndarray) -> None:
        """Let each hash read the siblings of its node from left to right."""
        parent, slot = np.divmod(index, self.arity)
        for at in range(self.arity):
            some = (slot != at) & (at < self.counts[parent])
            state[:, some] = advance(state[:, some], self.words[:, parent[some] * self.arity + at])
            read[some] += 1

    def step(self, index: int) -> dict:
        """A node's step of its path."""
        parent, slot = divmod(index, self.arity)
        first = parent * self.arity
        return {
            "before": self.before[slot, :, parent].astype(">u4").tobytes(),
            "left": self.children[first:index].tobytes(),
            "right": self.children[index + 1 : first + int(self.counts[parent])].tobytes(),
        }


def subtree(digests: np.ndarray, block: int, arity: int, depth: int) -> tuple[list[Level], np.ndarray]:
    """All levels of a block and the digest of its top.

    The first block of a group is either full or the whole group, so it ends at one node;
    others are ``depth`` levels high even where their last nodes are alone.
    """
    levels = []
    while len(digests) > 1 or (block > 0 and len(levels) < depth):
        levels.append(Level(digests, arity))
        digests = levels[-1].digests
    return levels, digests


def _hex(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), "S64").view(np.uint8).reshape(len(column), 64)


def _strings(digests: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(digests).view("S64").ravel()).cast(pa.string())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.StructArray, np.ndarray]]:
    """Each row without its items, its items in order, and their positions in the block."""
    for batch in batches:
        plain = batch.drop_columns(["items"]).to_pylist()
        items = batch.column("items")
        for k, row in enumerate(plain):
            mine = items[k].values
            slots = mine.field("slot").to_numpy(zero_copy_only=False)
            order = np.argsort(slots)
            yield row, mine.take(pa.array(order)), slots[order]


class _Tree:
    """One tree per ``key`` over stored blocks, built upwards round by round."""

    def __init__(self, nodes: DataFrame, arity: int, depth: int) -> None:
        """``nodes``: ``key, position`` (from 0), ``digest`` and any further columns."""
        self.arity, self.depth, self.span = arity, depth, arity**depth
        self.rounds = [self._gathered(nodes)]
        while True:
            self.tops = Stored(self._raised(self.rounds[-1].df), "merkle-tops")
            if self.tops.df.where("position > 0").isEmpty():
                break
            self.rounds.append(self._gathered(self.tops.df))

    def _gathered(self, nodes: DataFrame) -> Stored:
        slot = F.pmod("position", F.lit(self.span)).cast("int").alias("slot")
        rest = [c for c in nodes.columns if c not in ("key", "position")]
        block = F.floor(F.col("position") / self.span).cast("long").alias("block")
        grouped = nodes.groupBy("key", block).agg(F.collect_list(F.struct(slot, *rest)).alias("items"))
        return Stored(grouped, "merkle-blocks")

    def _raised(self, blocks: DataFrame) -> DataFrame:
        arity, depth = self.arity, self.depth

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row, items, _ in _blocks(batches):
                _, top = subtree(_hex(items.field("digest")), row["block"], arity, depth)
                found = [{"key": row["key"], "position": row["block"], "digest": top[0].tobytes().decode()}]
                yield pa.RecordBatch.from_pylist(found)

        return blocks.select("key", "block", "items").mapInArrow(run, "key string, position bigint, digest string")

    def _lowered(self, blocks: DataFrame, paths: DataFrame, name: str) -> DataFrame:
        """Paths of a round's nodes from those of its blocks; ``name`` is a column of the nodes or empty."""
        arity, depth, span = self.arity, self.depth, self.span
        named = ", name string" if name else ""
        kind = f"key string, block bigint, path {PATH}{named}"
        schema = pa.schema([("key", pa.string()), ("block", pa.int64()), ("path", _PATH)] + [("name", pa.string())] * bool(name))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row, items, slots in _blocks(batches):
                levels, _ = subtree(_hex(items.field("digest")), row["block"], arity, depth)
                names = items.field(name).to_pylist() if name else []
                # a few paths at a time, since each repeats the steps of its block
                for at in range(0, len(slots), 256):
                    found = []
                    for k in range(at, min(at + 256, len(slots))):
                        steps = [level.step(k // arity**high) for high, level in enumerate(levels)]
                        one = {"key": row["key"], "block": row["block"] * span + int(slots[k]), "path": steps + row["path"]}
                        found.append(one | ({"name": names[k]} if name else {}))
                    yield pa.RecordBatch.from_pylist(found, schema)

        return blocks.join(paths, ["key", "block"]).select("key", "block", "path", "items").mapInArrow(run, kind)

    def paths(self, tops: DataFrame, down_to: int, name: str = "") -> Stored:
        """``key, block, path`` of the blocks of round ``down_to`` (-1: of the nodes), from the tops' paths."""
        found = Stored(tops, "merkle-paths")
        for number in range(len(self.rounds) - 1, down_to, -1):
            lowered = self._lowered(self.rounds[number].df, maybe_broadcast(found), name if number == 0 else "")
            found = Stored(lowered, "merkle-paths")
        return found


def leaf(columns: list[Column]) -> Column:
    """Digest of the fields: ``-`` for null, else UTF-8 length, ``:`` and the value."""
    parts = []
    for column in columns:
        value = column.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def manifest(
    docs: DataFrame,
    fields: list[str],
    group: str,
    order: str,
    changed: dict[str, Column] | None = None,
    where: Column | None = None,
    arity: int = 2,
    depth: int = DEPTH,
) -> DataFrame:
    """A proof of every row and the check of a folded, possibly changed, leaf.

    Returns ``order, leaf, subroot, root, proof_sha256, folded_root, verified``.  In the
    rows for which ``where`` holds, the folded leaf has the fields ``changed``.
    """
    if arity < 2 or depth < 1:
        raise ValueError("a tree needs an arity of two and a level to a block")
    own = leaf([F.col(c) for c in fields])
    other = leaf([(changed or {}).get(c, F.col(c)) for c in fields])
    fold = F.when(where, other) if where is not None else F.lit(None).cast("string")
    key = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    leaves = bound_batches(docs).select(
        key.alias("key"), F.col(order).alias("id"), own.alias("digest"), fold.alias("changed"), F.monotonically_increasing_id().alias("row")
    )
    ranked = group_rank(Stored(leaves, "leaves").df, ["key"], ["id", "digest", "row"])
    nodes = ranked.select("key", (F.col("position") - 1).alias("position"), "digest", "id", "changed")
    tree = _Tree(nodes, arity, depth)
    named = tree.tops.df.select(F.lit("").alias("all"), F.col("key").alias("name"), "digest")
    ranked = group_rank(named, ["all"], ["name"])
    crown = _Tree(ranked.select(F.col("all").alias("key"), (F.col("position") - 1).alias("position"), "digest", "name"), arity, depth)
    none = F.array().cast(PATH)
    groups = crown.paths(crown.tops.df.select("key", F.col("position").alias("block"), none.alias("path")), -1, "name")
    tops = groups.df.select(F.col("name").alias("key"), F.lit(0).cast("long").alias("block"), "path")
    paths = tree.paths(tops, 0)
    top = crown.tops.df.first()  # the one root, None for an empty table
    root = F.lit(top.digest if top else None).cast("string").alias("root")
    known = Stored(tree.tops.df.select("key", F.col("digest").alias("subroot"), root), "merkle-roots")
    blocks = tree.rounds[0].df.join(maybe_broadcast(paths), ["key", "block"]).join(maybe_broadcast(known), "key")
    kind = docs.schema[order].dataType
    return _checked(blocks, arity, depth, kind).withColumnRenamed("id", order)


def _checked(blocks: DataFrame, arity: int, depth: int, kind) -> DataFrame:
    """Proofs and folded roots of all leaves, a block at a time."""
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, items, _ in _blocks(batches):
            digests, n = _hex(items.field("digest")), len(items)
            levels, _ = subtree(digests, row["block"], arity, depth)
            folded = _hex(pc.coalesce(items.field("changed"), items.field("digest")))
            index, proof, read = np.arange(n), fresh(n), np.zeros(n, np.int64)
            for level in levels:
                folded = level.fold(index, folded)
                level.add_siblings(index, proof, read)
                index = index // arity
            for step in row["path"]:
                left, right = (np.frombuffer(step[side], np.uint8).reshape(-1, 64) for side in ("left", "right"))
                before = np.frombuffer(step["before"], ">u4").astype(np.uint32)
                state = advance(np.repeat(before[:, None], n, axis=1), words_of(folded))
                for sibling in right:
                    state = advance(state, np.repeat(words_of(sibling[None]), n, axis=1))
                folded = finish(state, np.full(n, len(left) + 1 + len(right)))
                for sibling in np.concatenate([left, right]):
                    proof = advance(proof, np.repeat(words_of(sibling[None]), n, axis=1))
                    read += 1
            roots = _strings(folded)
            same = pc.equal(roots, pa.scalar(row["root"]))
            columns = [items.field("id"), _strings(digests), pa.array([row["subroot"]] * n), pa.array([row["root"]] * n), _strings(finish(proof, read)), roots, same]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return blocks.select("key", "block", "subroot", "root", "path", "items").mapInArrow(run, schema)
