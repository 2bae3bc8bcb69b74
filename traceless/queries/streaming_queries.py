"""Streams over the event log; the SQL twins are the batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from traceless.plans import ledger_tables, lineage_tables  # noqa: F401
from traceless.plans.catalog import SOURCE_TABLES, table
from traceless.plans.lineage_tables import NOW_EPOCH, audit_inputs
from traceless.plans.workspace import checkpoint_root
from traceless.queries.audit_queries import AUDIT_CTES, STATUS
from traceless.queries.ledger_queries import _lifecycle_ctes
from traceless.queries.registry import query
from traceless.streaming import jobs as K


def event_stream(spark, sf, name: str = "events"):
    assert name in SOURCE_TABLES
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _ts():
    return F.col("ts").cast("timestamp")


@query(
    "stream_nonce_filter",
    "select key_id, nonce from (select event_id, event_id % 3 as key_id, event_id % 1000 as nonce, event_id % 7 <> 2 and event_id % 101 <> 5 as ok from events) where ok and key_id < 2 group by all",
)
def stream_nonce_filter(spark, sf):
    stream = event_stream(spark, sf).select(
        (F.col("event_id") % 3).alias("key_id"), (F.col("event_id") % 1000).alias("nonce"), F.lit("v1").alias("schema_version"),
        (F.col("event_id") % 7 != 2).alias("signature_ok"),
        # Some validly signed envelopes bear a date of the next century and must not move the watermark.
        F.when(F.col("event_id") % 101 == 5, _ts() + F.expr("interval 100 years")).otherwise(_ts()).alias("issued_at"),
    )
    trust = table(spark, sf, "nation").select((F.col("n_nationkey") % 2).cast("long").alias("key_id"))
    accepted = K.stream_accept(stream, trust, "3650 days", "v1")
    return K.run_available(accepted.select("key_id", "nonce"), "nonces")


@query(
    "stream_refused_envelopes",
    """select event_id, case when event_id % 7 = 2 then 'signature' when event_id % 101 = 5 then 'issued in the future' else 'key is not trusted' end as reason
       from events where event_id % 7 = 2 or event_id % 101 = 5 or event_id % 3 = 2""",
)
def stream_refused_envelopes(spark, sf):
    stream = event_stream(spark, sf).select(
        "event_id", (F.col("event_id") % 3).alias("key_id"), F.lit("v1").alias("schema_version"), (F.col("event_id") % 7 != 2).alias("signature_ok"),
        F.when(F.col("event_id") % 101 == 5, _ts() + F.expr("interval 100 years")).otherwise(_ts()).alias("issued_at"),
    )
    trust = table(spark, sf, "nation").select((F.col("n_nationkey") % 2).cast("long").alias("key_id"))
    return K.run_available(K.stream_refusals(stream, trust, "v1").select("event_id", "reason"), "refusals")


@query(
    "stream_tombstone_guard",
    "select event_id, 's' || user_id as subject_id from events where 's' || user_id not in (select subject_id from {erasure_requests})",
)
def stream_tombstone_guard(spark, sf):
    restores = event_stream(spark, sf).select("event_id", F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("subject_id"))
    kept = K.stream_guard(restores, table(spark, sf, "erasure_requests"))
    return K.run_available(kept.select("event_id", "subject_id"), "guard")


@query(
    "stream_recurrence_alerts",
    """select e.user_id as subject_id, e.event_id as erasure_id, s.event_id as sighting_id from events e join events s on s.user_id = e.user_id and s.ts > e.ts and s.ts <= e.ts + interval 6 hours
       where e.event_type = 'error' and s.event_type in ('view', 'click', 'purchase')""",
)
def stream_recurrence_alerts(spark, sf):
    events = event_stream(spark, sf)
    gone = events.where("event_type = 'error'").select(F.col("user_id").alias("subject_id"), _ts().alias("erased_at"), F.col("event_id").alias("erasure_id"))
    seen = event_stream(spark, sf).where("event_type in ('view', 'click', 'purchase')").select(
        F.col("user_id").alias("subject_id"), _ts().alias("seen_at"), F.col("event_id").alias("sighting_id")
    )
    alerts = K.stream_recurrence(gone, seen, "6 hours", "1 hour")
    return K.run_available(alerts.select("subject_id", "erasure_id", "sighting_id"), "recurrence")


@query(
    "stream_trace_buckets",
    """select case_id, probe_id, node_id, epoch(bucket)::bigint as bucket_start, n as sightings from (select 'u' || user_id as case_id, event_id % 7 as probe_id, event_type as node_id, time_bucket(interval 1 day, ts, timestamp '1970-01-01') as bucket, count(*) as n from events group by all)
       where bucket + interval 1 day <= (select max(ts) from events) - interval 1 hour""",
)
def stream_trace_buckets(spark, sf):
    sightings = event_stream(spark, sf).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("case_id"), (F.col("event_id") % 7).alias("probe_id"),
        F.col("event_type").alias("node_id"), F.col("ts").cast("timestamp").alias("seen_at"),
    )
    rows = K.run_available(K.stream_traces(sightings, "1 day", "1 hour"), "traces")
    return rows.withColumn("bucket_start", F.unix_timestamp("bucket_start"))


@query(
    "stream_request_lifecycles",
    "select request_id, stage_no, illegal_events from {life}",
    _lifecycle_ctes(),
)
def stream_request_lifecycles(spark, sf):
    k = F.pmod(F.col("event_id") * 7, F.lit(11))
    names = ["create-request", "delete-visible", "simulate-recovery", "run-probes", "apply-exact-cut", "verify-replay", "create-request", "delete-visible"]
    action = F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), k.cast("int")), F.lit("verify-replay"))
    events = event_stream(spark, sf).select(F.col("user_id").alias("request_id"), _ts().alias("ts"), "event_id", action.alias("action"))
    with K.rocksdb_state(spark):
        rows = K.run_available(K.stream_lifecycle(events), "lifecycle")
    return rows.groupBy("request_id").agg(F.count_if("legal").alias("stage_no"), F.count_if(~F.col("legal")).alias("illegal_events"))


_ORDERED = {"passed": "select e.* from {request_events} e where e.ts <= (select max(ts) from events) - interval 1 hour"}
_ORDERED |= {name: sql.replace("{request_events}", "{passed}") for name, sql in _lifecycle_ctes().items()}


@query(
    "stream_ordered_lifecycles",
    "select request_id, stage_no, illegal_events from {life}",
    _ORDERED,
)
def stream_ordered_lifecycles(spark, sf):
    """The same lines by event time, up to the watermark."""
    names = ["create-request", "delete-visible", "simulate-recovery", "run-probes", "apply-exact-cut", "verify-replay", "create-request", "delete-visible"]
    k = F.pmod(F.col("event_id") * 7, F.lit(11))
    action = F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), k.cast("int")), F.lit("verify-replay"))
    events = event_stream(spark, sf).select(F.col("user_id").alias("request_id"), _ts().alias("ts"), "event_id", action.alias("action"))
    with K.rocksdb_state(spark):
        rows = K.run_available(K.stream_ordered_lifecycle(events, "1 hour"), "ordered-lifecycle")
    return rows.groupBy("request_id").agg(F.count_if("legal").alias("stage_no"), F.count_if(~F.col("legal")).alias("illegal_events"))


@query(
    "stream_expired_items",
    """select item_id, deadline_ms from (select 'i' || (event_id % 50) as item_id, max(epoch_us(ts) // 1000 + (event_id % 5) * 3600000) as deadline_ms from events group by 1)
       where deadline_ms <= (select max(epoch_us(ts)) // 1000 from events) - 3600000""",
)
def stream_expired_items(spark, sf):
    k = F.col("event_id")
    evidence = event_stream(spark, sf).select(
        F.concat(F.lit("i"), (k % 50).cast("string")).alias("item_id"), _ts().alias("issued_at"),
        (F.unix_millis(_ts()) + (k % 5) * 3600000).alias("deadline_ms"),
    )
    with K.rocksdb_state(spark):
        return K.run_available(K.stream_expiry(evidence, "1 hour"), "expiry")


@query(
    "stream_reaudit",
    "select subject_id, residuals, invalid, status from {status} where subject_id in (select distinct 's' || user_id from events)",
    {**AUDIT_CTES, "status": STATUS},
)
def stream_reaudit(spark, sf):
    changes = event_stream(spark, sf).select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("subject_id"))
    base = f"{checkpoint_root(spark)}/streams/audit-{uuid.uuid4().hex}"
    K.stream_audit(changes, lambda: audit_inputs(spark, sf), NOW_EPOCH, f"{base}/status", f"{base}/progress")
    schema = "subject_id string, reachable bigint, residuals bigint, invalid bigint, waiting bigint, unreachable_active bigint, status string, batch_id bigint"
    from pyspark.sql.types import StructType

    current = K.current_status(spark, f"{base}/status", StructType.fromDDL(schema))
    return current.select("subject_id", "residuals", "invalid", "status")
