"""Structured Streaming forms of the time-dependent checks.

Every function takes and returns streaming DataFrames; :func:`run_available`
drains a stream into files for bounded runs and tests.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from traceless.operators.audit import Audit
from traceless.operators.stores import ACTIONS, STAGES
from traceless.plans.workspace import checkpoint_root

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, label: str) -> DataFrame:
    """Process everything that is available now and return the written rows."""
    spark = stream.sparkSession
    base = f"{checkpoint_root(spark)}/streams/{label}-{uuid.uuid4().hex}"
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{base}/rows")
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
    )
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def envelope_reason(schema: str, now: Column | None = None, max_age: str | None = None) -> Column:
    """Why an envelope is refused, in checking order; null for one that is fit."""
    now = F.current_timestamp() if now is None else now
    reason = F.when(~(F.col("schema_version") == F.lit(schema)), "schema version").when(~F.col("signature_ok"), "signature")
    reason = reason.when(F.col("issued_at").isNull(), "no time").when(F.col("issued_at") > now, "issued in the future")
    if max_age is not None:
        reason = reason.when(F.col("issued_at") < now - F.expr(f"interval {max_age}"), "too old")
    return reason.when(F.col("schema_version").isNull() | F.col("signature_ok").isNull(), "incomplete")


def stream_accept(
    envelopes: DataFrame, trust: DataFrame, ttl: str, schema: str, now: Column | None = None, max_age: str | None = None
) -> DataFrame:
    """First trusted envelope of each (key, nonce) within the watermark.

    Unfit and future-dated envelopes go before the watermark, which they must not
    move.  ``ttl`` must cover the maximum age: a replay that arrives after its
    state is dropped is older than the watermark and is rejected as late.
    """
    trusted = trust.select("key_id").distinct()
    fit = envelopes.where(envelope_reason(schema, now, max_age).isNull())
    return (
        fit.join(trusted, "key_id", "left_semi")
        .withWatermark("issued_at", ttl)
        .dropDuplicatesWithinWatermark(["key_id", "nonce"])
    )


def stream_refusals(
    envelopes: DataFrame, trust: DataFrame, schema: str, now: Column | None = None, max_age: str | None = None
) -> DataFrame:
    """Envelopes that :func:`stream_accept` leaves out before the replay check, each with its ``reason``."""
    known = trust.select("key_id").distinct().withColumn("is_trusted", F.lit(True))
    reason = F.coalesce(envelope_reason(schema, now, max_age), F.when(F.col("is_trusted").isNull(), "key is not trusted"))
    return envelopes.join(known, "key_id", "left").withColumn("reason", reason).where("reason is not null").drop("is_trusted")


def stream_guard(restores: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Restores whose subject has no tombstone."""
    return restores.join(tombstones.select("subject_id").distinct(), "subject_id", "left_anti")


def stream_recurrence(erasures: DataFrame, sightings: DataFrame, horizon: str, delay: str) -> DataFrame:
    """Sightings of a subject within ``horizon`` after its erasure."""
    gone = erasures.select(F.col("subject_id").alias("erased_id"), "erased_at", "erasure_id").withWatermark("erased_at", delay)
    seen = sightings.select("subject_id", "seen_at", "sighting_id").withWatermark("seen_at", delay)
    within = (
        (F.col("subject_id") == F.col("erased_id"))
        & (F.col("seen_at") > F.col("erased_at"))
        & (F.col("seen_at") <= F.col("erased_at") + F.expr(f"interval {horizon}"))
    )
    return gone.join(seen, within).select("subject_id", "erasure_id", "sighting_id", "erased_at", "seen_at")


def stream_traces(sightings: DataFrame, bucket: str, delay: str) -> DataFrame:
    """Observed nodes per case and probe in tumbling time buckets."""
    return (
        sightings.withWatermark("seen_at", delay)
        .groupBy(F.window("seen_at", bucket).alias("w"), "case_id", "probe_id", "node_id")
        .agg(F.count(F.lit(1)).alias("sightings"))
        .select("case_id", "probe_id", "node_id", F.col("w.start").alias("bucket_start"), "sightings")
    )


# --- state per key -----------------------------------------------------------


class LifecycleProcessor(StatefulProcessor):
    """Line of stages per request; each event is reported with its outcome."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stage = handle.getValueState("stage", "stage int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        known = self.stage.get()
        stage = int(known[0]) if known is not None else 0
        out = []
        for event_id, action in zip(events["event_id"], events["action"], strict=True):
            legal = stage < len(ACTIONS) and action == ACTIONS[stage]
            stage += legal
            out.append((key[0], event_id, STAGES[stage], bool(legal)))
        self.stage.update((stage,))
        yield pd.DataFrame(out, columns=["request_id", "event_id", "stage", "legal"])

    def close(self) -> None:
        pass


def stream_lifecycle(events: DataFrame) -> DataFrame:
    """Stage after every event of every request.

    Within a micro-batch events are applied in (ts, event_id) order.
    """
    narrow = events.select("request_id", "ts", "event_id", "action")
    return narrow.groupBy("request_id").transformWithStateInPandas(
        LifecycleProcessor(), "request_id bigint, event_id bigint, stage string, legal boolean", "Append", "None"
    )


class OrderedLifecycleProcessor(StatefulProcessor):
    """Line of stages per request in event-time order, whatever the order of arrival.

    Events wait in a list until the watermark has passed them; then nothing older can
    come any more, and they are applied by (time, event id).  A finished request is
    forgotten once the watermark is ``keep_ms`` past its last event.
    """

    RESULT = "request_id bigint, event_id bigint, stage string, legal boolean"

    def __init__(self, keep_ms: int | None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "at bigint, event_id bigint, action string")
        self.line = handle.getValueState("line", "stage int, last_ms bigint")
        self.timer = handle.getValueState("timer", "due_ms bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        columns = (events["at"], events["event_id"], events["action"])
        self.pending.appendList([(int(at), int(event), action) for at, event, action in zip(*columns, strict=True)])
        self._arm(_whole_ms(int(events["at"].min())))
        yield self._reported(key, [])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = max(int(timerValues.getCurrentWatermarkInMs()), int(expiredTimerInfo.getExpiryTimeInMs()))
        self.timer.clear()
        waiting = [(int(at), int(event), action) for at, event, action in self.pending.get()]
        ready = sorted((e for e in waiting if _whole_ms(e[0]) <= now), key=lambda e: (e[0], e[1], e[2] or ""))
        later = [e for e in waiting if _whole_ms(e[0]) > now]
        known = self.line.get()
        stage, last = (int(known[0]), int(known[1])) if known is not None else (0, 0)
        out = []
        for at, event_id, action in ready:
            if self._forgotten(stage, last, _whole_ms(at)):
                stage = 0
            legal = stage < len(ACTIONS) and action == ACTIONS[stage]
            stage, last = stage + legal, _whole_ms(at)
            out.append((key[0], event_id, STAGES[stage], bool(legal)))
        if later:
            self.pending.put(later)
        else:
            self.pending.clear()
        if self._forgotten(stage, last, now):
            self.line.clear()
        else:
            self.line.update((stage, last))
            if stage == len(ACTIONS) and self.keep_ms is not None:
                self._arm(last + self.keep_ms)
        if later:
            self._arm(min(_whole_ms(e[0]) for e in later))
        yield self._reported(key, out)

    def _forgotten(self, stage: int, last_ms: int, now_ms: int) -> bool:
        return stage == len(ACTIONS) and self.keep_ms is not None and now_ms >= last_ms + self.keep_ms

    def _arm(self, due_ms: int) -> None:
        """Keep one timer, at the earliest time at which something is to be done."""
        known = self.timer.get()
        if known is not None and int(known[0]) <= due_ms:
            return
        if known is not None:
            self.handle.deleteTimer(int(known[0]))
        self.handle.registerTimer(due_ms)
        self.timer.update((due_ms,))

    def _reported(self, key: Any, rows: list) -> pd.DataFrame:
        kinds = {"request_id": "int64", "event_id": "int64", "stage": "object", "legal": "bool"}
        return pd.DataFrame(rows, columns=list(kinds)).astype(kinds)

    def close(self) -> None:
        pass


def _whole_ms(micros: int) -> int:
    """The first millisecond that is not before the time."""
    return -(-micros // 1000)


def stream_ordered_lifecycle(events: DataFrame, delay: str, keep: str | None = None) -> DataFrame:
    """Stage after every event of every request, in order of ``ts``, once the watermark has passed it.

    ``delay`` is how late an event may come; later ones are dropped.  ``keep`` is an interval
    in days, hours or minutes after which a finished request's state goes; events that come
    for it afterwards begin a new line.
    """
    narrow = events.select("request_id", "ts", F.unix_micros("ts").alias("at"), "event_id", "action").withWatermark("ts", delay)
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000) if keep is not None else None
    return narrow.groupBy("request_id").transformWithStateInPandas(
        OrderedLifecycleProcessor(keep_ms), OrderedLifecycleProcessor.RESULT, "Append", "EventTime"
    )


class ExpiryProcessor(StatefulProcessor):
    """Latest deadline per item; fires one row when event time passes it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.deadline = handle.getValueState("deadline", "deadline_ms bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        latest = max(int(batch["deadline_ms"].max()) for batch in rows)
        known = self.deadline.get()
        if known is None or latest > int(known[0]):
            if known is not None:
                self.handle.deleteTimer(int(known[0]))
            self.deadline.update((latest,))
            self.handle.registerTimer(latest)
        yield pd.DataFrame({"item_id": pd.Series(dtype="str"), "deadline_ms": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        due = int(expiredTimerInfo.getExpiryTimeInMs())
        self.deadline.clear()
        yield pd.DataFrame({"item_id": [key[0]], "deadline_ms": [due]})

    def close(self) -> None:
        pass


def stream_expiry(evidence: DataFrame, delay: str) -> DataFrame:
    """Items whose latest deadline has passed in event time: ``(item_id, issued_at, deadline_ms)`` in."""
    narrow = evidence.select("item_id", "issued_at", "deadline_ms").withWatermark("issued_at", delay)
    return narrow.groupBy("item_id").transformWithStateInPandas(
        ExpiryProcessor(), "item_id string, deadline_ms bigint", "Append", "EventTime"
    )


class rocksdb_state:
    """Use the RocksDB state store while stateful processors run; restores the session value."""

    KEY = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.KEY, None)
        self.spark.conf.set(self.KEY, ROCKSDB)

    def __exit__(self, *_: object) -> None:
        if self.before is None:
            self.spark.conf.unset(self.KEY)
        else:
            self.spark.conf.set(self.KEY, self.before)


# --- incremental re-audit ----------------------------------------------------


def stream_audit(
    changes: DataFrame,
    tables: Callable[[], tuple[DataFrame, DataFrame, DataFrame]],
    now_epoch: int,
    out_path: str,
    progress_path: str,
) -> None:
    """Audit only the subjects of each batch of changes and append their new status.

    Rows carry ``batch_id``; the current status of a subject is its row with
    the largest batch.  A repeated batch rewrites its own folder.
    """

    def audit_batch(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select("subject_id").distinct()
        artifacts, lineage, evidence = tables()
        mine = artifacts.join(touched, "subject_id", "left_semi")
        ids = mine.select("artifact_id")
        edges = lineage.join(ids.withColumnRenamed("artifact_id", "source_id"), "source_id", "left_semi")
        facts = evidence.join(ids, "artifact_id", "left_semi")
        status = Audit(mine, edges, facts, now_epoch).status.withColumn("batch_id", F.lit(batch_id).cast("long"))
        status.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    query = (
        changes.writeStream.foreachBatch(audit_batch)
        .option("checkpointLocation", progress_path)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def current_status(spark: SparkSession, out_path: str, schema: StructType) -> DataFrame:
    """Latest status per subject of :func:`stream_audit` output."""
    rows = spark.read.schema(schema).parquet(f"{out_path}/batch=*")
    rest = F.struct(*[F.col(c) for c in schema.names if c != "subject_id"])
    return rows.groupBy("subject_id").agg(F.max_by(rest, F.col("batch_id")).alias("r")).select("subject_id", "r.*")
