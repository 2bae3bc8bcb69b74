"""Commitments, receipt chains, nonce ledgers and manifests."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from traceless.functions.digests import PREFIX, commitment
from traceless.operators.audit import Audit
from traceless.operators.pathgraph import PathGraph, evaluate_requests
from traceless.operators.ranking import group_rank
from traceless.plans.workspace import Stored, union_stored

FAN = 1024
#: Bytes of a file up to which it is hashed as one value; larger ones are streamed.
WHOLE_BYTES = 64 << 20
BOM = b"\xef\xbb\xbf"


def ordered_digest(rows: DataFrame, by: Sequence[str], order: Sequence[str], digest: str, name: str = "root", flat: bool = False) -> DataFrame:
    """One digest per group over its rows' digests in order; null digests don't count.

    Groups up to ``FAN`` rows are collected and hashed in one shuffle.  Larger ones are folded
    level by level in blocks of ``FAN``, so no task ever holds more than one block of a group.
    ``flat`` hashes the comma-joined digests of a group of any size: SHA-256 of one text has to
    go through it in order, so the sorted digests of a large group stream through a task.
    """
    by = list(by)
    keyed = rows.select(F.struct(*by).alias("of"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(digest).alias("d"))
    places = [f"o{i}" for i in range(len(order))]
    large = Stored(keyed.groupBy("of").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FAN).select("of"), "digest-large")
    several = not large.is_empty()
    small = keyed.join(large.df, "of", "left_anti") if several else keyed
    # Commitments travel as 32 bytes, other texts as they are.
    known = F.col("d").rlike(f"^{PREFIX}[0-9a-f]{{64}}$")
    packed = F.struct(*places, F.when(known, F.unhex(F.substring("d", len(PREFIX) + 1, 64))).alias("raw"), F.when(~known, F.col("d")).alias("text"))
    sorted_rows = small.groupBy("of").agg(F.array_sort(F.collect_list(packed)).alias("o"))
    texts = F.transform("o", lambda x: F.coalesce(x["text"], F.concat(F.lit(PREFIX), F.lower(F.hex(x["raw"])))))
    texts = F.filter(texts, lambda x: x.isNotNull())
    done = sorted_rows.select("of", F.when(F.size(texts) > 0, F.sha2(F.array_join(texts, ","), 256)).alias("d"))
    if several:
        rest = keyed.join(large.df, "of", "left_semi")
        done = done.unionByName(_streamed(rest, places) if flat else _folded(rest, places))
    return Stored(done.select("of.*", F.concat(F.lit(PREFIX), "d").alias(name)), "digest-roots").df


def _streamed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``(of, d)``: the digest of every group's comma-joined digests, in constant memory."""
    of = rows.schema["of"].dataType

    def hashed(batches):
        import hashlib

        state = key = None
        for batch in batches:
            keys, digests = batch.column("key").to_pylist(), batch.column("d").to_pylist()
            groups = batch.column("of")
            for i, (k, d) in enumerate(zip(keys, digests)):
                if state is None or k != key:
                    if state is not None:
                        yield pa.RecordBatch.from_arrays([kept, pa.array([state.hexdigest()])], ["of", "d"])
                    state, key, kept = hashlib.sha256(d.encode()), k, groups.slice(i, 1)
                else:
                    state.update(b"," + d.encode())
        if state is not None:
            yield pa.RecordBatch.from_arrays([kept, pa.array([state.hexdigest()])], ["of", "d"])

    present = rows.where(F.col("d").isNotNull()).select("of", F.to_json("of", {"ignoreNullFields": "false"}).alias("key"), *order, "d")
    dealt = present.repartition("of").sortWithinPartitions("of", *order, "d").select("of", "key", "d")
    schema = StructType([StructField("of", of), StructField("d", StringType())])
    streamed = dealt.mapInArrow(hashed, schema)
    return rows.select("of").distinct().join(streamed, "of", "left")


def _folded(rows: DataFrame, order: list[str]) -> DataFrame:
    """``(of, d)``: digests of groups as trees with ``FAN`` children."""
    level = Stored(group_rank(rows, ["of"], order, "place").select("of", "place", "d"), "digests").df
    finished: list[Stored] = []
    while True:
        block = F.floor((F.col("place") - 1) / FAN)
        folded = (
            level.withColumn("block", block)
            .groupBy("of", "block")
            .agg(F.array_sort(F.collect_list(F.struct("place", "d"))).alias("o"))
            .select("of", (F.col("block") + 1).alias("place"), F.sha2(F.array_join("o.d", ","), 256).alias("d"))
        )
        level = Stored(folded, "digest-blocks").df
        # Only groups with several blocks go on, so a root never depends on other groups.
        open_groups = level.where(F.col("place") > 1).select("of").distinct()
        finished.append(Stored(level.join(open_groups, "of", "left_anti").select("of", "d"), "digest-done"))
        rest = Stored(level.join(open_groups, "of", "left_semi"), "digest-open")
        if rest.is_empty():
            return union_stored(finished)
        level = rest.df


def graph_root(graph: PathGraph) -> DataFrame:
    """Root per request over its nodes, edges and channels."""
    parts = [
        graph.nodes.select("request_id", F.lit("node").alias("part"), F.col("node_id").alias("id"), commitment({c: F.col(c) for c in ("node_id", "subject_id", "state")}).alias("d")),
        graph.edges.select("request_id", F.lit("edge").alias("part"), F.col("edge_id").alias("id"), commitment({c: F.col(c) for c in ("edge_id", "source_id", "target_id", "state", "request_scoped", "subject_id")}).alias("d")),
        graph.channels.select("request_id", F.lit("channel").alias("part"), F.concat_ws("@", "name", "stratum").alias("id"), commitment({c: F.col(c) for c in ("name", "stratum", "mandatory", "decision")}).alias("d")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return ordered_digest(rows, ["request_id"], ["part", "id"], "d", "graph_root")


def verify_roots(declared: DataFrame, recomputed: DataFrame, key: str = "request_id", root: str = "graph_root") -> DataFrame:
    """Tamper report: declared against recomputed roots."""
    actual = recomputed.select(key, F.col(root).alias("actual"))
    return declared.join(actual, key, "left").select(
        key, (~F.col(root).eqNullSafe(F.col("actual"))).alias("tampered")
    )


def _ordered_case(rungs: list[tuple[Column, str]], otherwise: str) -> Column:
    ladder = F.when(rungs[0][0], rungs[0][1])
    for test, reason in rungs[1:]:
        ladder = ladder.when(test, reason)
    return ladder.otherwise(otherwise)


def receipt_hash(columns: Sequence[str]) -> Column:
    return commitment({c: F.col(c) for c in columns})


def verify_chain(receipts: DataFrame, now_epoch: int, max_age: int, schema: str, payload: Sequence[str]) -> DataFrame:
    """First failed check of each receipt: schema, link, replay, future, age, signature.

    The predecessor is found by an equi-join on the chain position, so a chain
    of any length is spread over tasks.
    """
    hashed = receipts.withColumn("receipt_hash", receipt_hash(payload))
    placed = Stored(group_rank(hashed, ["chain_id"], ["seq"], "place"), "receipt-chain").df
    before = placed.select("chain_id", (F.col("place") + 1).alias("place"), F.col("receipt_hash").alias("expected"))
    first_use = placed.groupBy("chain_id", "nonce").agg(F.min("place").alias("first_place"))
    joined = placed.join(before, ["chain_id", "place"], "left").join(first_use, ["chain_id", "nonce"])
    reason = _ordered_case(
        [
            (F.col("schema_version") != schema, "unsupported schema version"),
            (~F.col("previous_receipt_hash").eqNullSafe(F.col("expected")), "invalid chain link"),
            (F.col("place") > F.col("first_place"), "replayed nonce"),
            (F.col("issued_epoch") > now_epoch, "receipt timestamp is in the future"),
            (F.lit(now_epoch) - F.col("issued_epoch") > max_age, "receipt is too old"),
            (~F.col("signature_ok"), "invalid signature"),
        ],
        "valid signature and receipt envelope",
    )
    return joined.select(
        "chain_id", "seq", (reason == "valid signature and receipt envelope").alias("valid"), reason.alias("reason")
    )


def accept_envelopes(
    envelopes: DataFrame, trust: DataFrame, ledger: DataFrame, now_epoch: int, max_age: int, schema: str
) -> tuple[DataFrame, DataFrame]:
    """(decisions with reason, new ledger rows) in batch order ``position``.

    Only an accepted envelope uses up its nonce, so the first otherwise valid
    envelope of a (key, nonce) pair wins and all later ones are replays.
    """
    trusted = trust.select("key_id").distinct().withColumn("is_trusted", F.lit(True))
    spent = ledger.select("key_id", "nonce").distinct().withColumn("is_spent", F.lit(True))
    joined = envelopes.join(trusted, "key_id", "left").join(spent, ["key_id", "nonce"], "left")
    before = [
        (F.col("schema_version") != schema, "unsupported schema version"),
        (F.col("is_trusted").isNull(), "untrusted key id"),
    ]
    after = [
        (F.col("issued_epoch") > now_epoch, "evidence timestamp is in the future"),
        (F.lit(now_epoch) - F.col("issued_epoch") > max_age, "evidence is too old"),
        (~F.col("signature_ok"), "invalid signature"),
    ]
    ok = F.lit(True)
    for test, _ in [*before, *after]:
        ok = ok & ~test
    flagged = joined.withColumn("fine", ok & F.col("is_spent").isNull())
    winners = flagged.where("fine").groupBy("key_id", "nonce").agg(F.min("position").alias("winner"))
    replay = F.col("is_spent").isNotNull() | F.coalesce(F.col("position") > F.col("winner"), F.lit(False))
    good = "valid signature and evidence envelope"
    reason = _ordered_case([*before, (replay, "replayed nonce"), *after], good)
    decided = flagged.join(winners, ["key_id", "nonce"], "left").withColumn("reason", reason).drop(
        "fine", "winner", "is_trusted", "is_spent"
    ).withColumn("accepted", F.col("reason") == good)
    return decided, decided.where("accepted").select("key_id", "nonce")


def audit_signed(
    artifacts: DataFrame, lineage: DataFrame, envelopes: DataFrame, trust: DataFrame, ledger: DataFrame, now_epoch: int, max_age: int, schema: str
) -> Audit:
    """Audit in which only accepted envelopes count as evidence."""
    decided, _ = accept_envelopes(envelopes, trust, ledger, now_epoch, max_age, schema)
    accepted = decided.where("accepted").select("evidence.*").withColumn("valid_signature", F.lit(True))
    return Audit(artifacts, lineage, accepted, now_epoch)


def ledger_append(ledger: DataFrame, batch: DataFrame, payload: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(new rows, duplicates) of a batch against a content-addressed ledger."""
    hashed = batch.withColumn("content_hash", commitment({c: F.col(c) for c in payload}))
    fresh = hashed.join(ledger.select("content_hash"), "content_hash", "left_anti").dropDuplicates(["content_hash"])
    counts = hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"))
    known = ledger.select("content_hash").distinct().withColumn("known", F.lit(True))
    duplicates = (
        counts.join(known, "content_hash", "left")
        .where(F.col("known") | (F.col("copies") > 1))
        .select("content_hash", "copies", F.coalesce("known", F.lit(False)).alias("already_stored"))
    )
    return fresh, duplicates


def ledger_verify(ledger: DataFrame, payload: Sequence[str]) -> DataFrame:
    """Rows whose stored hash differs from their content."""
    return ledger.where(F.col("content_hash") != commitment({c: F.col(c) for c in payload}))


def replay_bundles(graph: PathGraph, declared: DataFrame, costs: DataFrame) -> DataFrame:
    """Recomputed verdict and cost of each bundle against the declared ones."""
    actual = evaluate_requests(graph).select("request_id", F.col("verdict").alias("actual_verdict"))
    joined = declared.join(actual, "request_id", "left").join(costs, "request_id", "left")
    return joined.select(
        "request_id",
        F.col("verdict").eqNullSafe(F.col("actual_verdict")).alias("verdict_ok"),
        F.col("total_cost").eqNullSafe(F.coalesce("actual_cost", F.lit(0))).alias("cost_ok"),
    )


def check_alignment(direct: DataFrame, perturbed: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Positions where two row sets disagree on ``columns`` or one side is missing."""
    a = direct.select(key, F.struct(*columns).alias("a"))
    b = perturbed.select(key, F.struct(*columns).alias("b"))
    return a.join(b, key, "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(
        key, F.col("a").isNull().alias("missing_left"), F.col("b").isNull().alias("missing_right")
    )


def file_digests(files: DataFrame) -> DataFrame:
    """``(name, digest)``: SHA-256 of each file of a ``binaryFile`` scan, in bounded memory.

    A row holds a file whole and at most 2 GB, so files over ``WHOLE_BYTES`` are read as lines of
    bytes, through Spark's text reader and so from any store that Spark reads: a file is one
    split, whose lines stream through a task in order.  Its digest is that of all its bytes, or
    the job fails.  A stretch of 2 GB without a line feed is an error of the reader.
    """
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    whole = files.where(F.col("length") <= WHOLE_BYTES).select(name, F.sha2("content", 256).alias("digest"))
    large = files.where(F.col("length") > WHOLE_BYTES).select("path", "length").collect()
    if not large:
        return whole
    # A session of its own, so that its reader never cuts a file into splits.
    apart = files.sparkSession.newSession()
    settings = {
        "spark.sql.files.maxPartitionBytes": max(r.length for r in large),
        "spark.sql.files.minPartitionNum": 1,
        "spark.sql.execution.arrow.maxRecordsPerBatch": 1000,
        "spark.sql.files.ignoreCorruptFiles": "false",
        "spark.sql.files.ignoreMissingFiles": "false",
    }
    for key, value in settings.items():
        apart.conf.set(key, str(value))
    literal = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r.path) for r in large]
    lines = apart.read.option("lineSep", "\n").text(literal).select(
        "_metadata.file_path", "_metadata.file_name", "_metadata.file_size",
        F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("bytes"),
    )
    digests = Stored(lines.mapInArrow(_line_digests(), "name string, digest string"), "file-digests")
    return whole.unionByName(files.sparkSession.read.schema(digests.schema).parquet(digests.path))


def _line_digests():
    """Digests of files whose lines, each with a line feed, come one file after another."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        def done() -> pa.RecordBatch:
            # The reader drops a byte order mark and the last line feed; the size tells which were there.
            missing = size - seen
            if missing not in (-1, 0, len(BOM) - 1, len(BOM)):
                raise ValueError(f"{name}: {seen} bytes read of {size}")
            state = marked if missing > 0 else plain
            if missing in (0, len(BOM)):
                state.update(b"\n")
            return pa.RecordBatch.from_arrays([pa.array([unquote(name)]), pa.array([state.hexdigest()])], ["name", "digest"])

        path = None
        for batch in batches:
            runs = pc.run_end_encode(batch.column("file_path"))
            start = 0
            for of, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if of != path:
                    if path is not None:
                        yield done()
                    path, name, size = of, batch.column("file_name")[start].as_py(), batch.column("file_size")[start].as_py()
                    plain, marked, seen = hashlib.sha256(), hashlib.sha256(BOM), 0
                # The line feed of the last line so far waits for the next one.
                data = (b"\n" if seen else b"") + b"".join(batch.column("bytes").slice(start, end - start).to_pylist())
                for state in (plain, marked):
                    state.update(memoryview(data)[:-1])
                seen += len(data) - (seen > 0)
                start = end
        if path is not None:
            yield done()

    return hashed


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Declared against actual digests; ``files`` is a ``binaryFile`` scan."""
    actual = file_digests(files).withColumnRenamed("digest", "actual")
    joined = manifest.join(actual, "name", "full_outer")
    outcome = (
        F.when(F.col("actual").isNull(), "missing file")
        .when(F.col("digest").isNull(), "undeclared file")
        .when(F.col("digest") == F.col("actual"), "ok")
        .otherwise("digest mismatch")
    )
    return joined.select("name", outcome.alias("outcome"))


def verify_excerpts(sources: DataFrame, mappings: DataFrame, relations: Sequence[str]) -> DataFrame:
    """Violations of a source lock: ids, https, excerpt digests, mapping ids and relations."""
    copies = sources.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | (F.col("source_id") == ""))
    not_https = sources.where(F.coalesce(F.try_parse_url("url", F.lit("PROTOCOL")), F.lit("")) != "https")
    changed = sources.where(F.sha2("excerpt", 256) != F.col("excerpt_sha256"))
    again = mappings.groupBy("mapping_id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | (F.col("mapping_id") == ""))
    foreign = mappings.where(~F.col("relation").isin(*relations))
    rows = None
    for frame, column, rule in (
        (copies, "source_id", "source ids must be unique"),
        (not_https, "source_id", "source must use https"),
        (changed, "source_id", "excerpt hash mismatch"),
        (again, "mapping_id", "mapping ids must be unique"),
        (foreign, "mapping_id", "relation is not allowed"),
    ):
        part = frame.select(F.col(column).cast("string").alias("entity_id"), F.lit(rule).alias("rule"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def verify_reveal(commitments: DataFrame, answers: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Whether revealed answers match the committed digest of each group."""
    rows = answers.withColumn("d", commitment({c: F.col(c) for c in columns}))
    revealed = ordered_digest(rows, by, order, "d", "revealed")
    return commitments.join(revealed, list(by), "left").select(
        *by, F.col("commitment").eqNullSafe(F.col("revealed")).alias("matches")
    )


def freeze_check(predictions: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases not predicted exactly once, and predictions for unknown cases."""
    counts = predictions.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    known = cases.select("case_id").distinct().withColumn("known", F.lit(True))
    joined = known.join(counts, "case_id", "full_outer")
    outcome = (
        F.when(F.col("known").isNull(), "unknown case")
        .when(F.col("n").isNull(), "missing prediction")
        .when(F.col("n") > 1, "duplicate prediction")
    )
    return joined.select("case_id", outcome.alias("problem")).where(F.col("problem").isNotNull())
