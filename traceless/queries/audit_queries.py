"""Audit of customers' orders and line items against their deletion evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceless.operators import audit as A
from traceless.plans.lineage_tables import NOW_EPOCH, audit_inputs
from traceless.queries.registry import query

# DuckDB texts shared by several oracles.
SAME_SUBJECT_EDGES = """
    select distinct s.subject_id, e.source_id, e.target_id from {lineage} e
    join {artifacts} s on s.artifact_id = e.source_id
    join {artifacts} t on t.artifact_id = e.target_id and t.subject_id = s.subject_id
"""
ROOTS = """
    select a.subject_id, a.artifact_id from {artifacts} a where a.type = 'SOURCE_RECORD'
    union all
    select a.subject_id, a.artifact_id from {artifacts} a
    where a.subject_id not in (select subject_id from {artifacts} where type = 'SOURCE_RECORD')
      and not exists (select 1 from {inner_edges} e where e.target_id = a.artifact_id)
"""
WALKS = """
    select subject_id, artifact_id, [artifact_id] as path from {roots}
    union all
    select w.subject_id, e.target_id, list_append(w.path, e.target_id)
    from {walks} w join {inner_edges} e on e.source_id = w.artifact_id
    where not list_contains(w.path, e.target_id)
"""
BEST = """
    select subject_id, artifact_id, path from (
      select *, row_number() over (partition by artifact_id order by len(path), path) as rn from {walks})
    where rn = 1
"""
CHECKS = f"""
    select a.artifact_id, a.subject_id, a.type, a.state, a.active_sink, x.reason,
      x.reason in ('processing restriction is attested', 'committed artifact is absent',
        'cache invalidation propagated', 'backup has a future expiry schedule',
        'backup encryption key destruction is attested', 'model audit passed against exact retraining',
        'receipt envelope is valid') as valid,
      case when x.reason = 'artifact remains active' then 'ACTIVE'
           when x.reason = 'cache invalidation is still propagating' then 'WAITING_EXPIRY'
           when valid then a.state else 'UNVERIFIED' end as effective_state
    from {{artifacts}} a left join {{evidence_flat}} e on e.artifact_id = a.artifact_id,
    lateral (select case
      when a.state = 'ACTIVE' then 'artifact remains active'
      when e.artifact_id is null then 'missing evidence'
      when e.expires_epoch <= {NOW_EPOCH} and not (a.type = 'BACKUP_COPY' and a.state = 'ERASED' and e.kind = 'CRYPTO_ERASURE') then 'evidence expired'
      when a.state = 'UNVERIFIED' then 'artifact state is unverified'
      when a.state = 'BLOCKED' then case when e.kind = 'SIGNED_STATEMENT' and e.valid_signature and e.md_enforced = 'true' and e.md_control_id <> ''
           then 'processing restriction is attested' else 'blocked artifact requires an enforced signed control' end
      when a.type in ('SOURCE_RECORD', 'BIOMETRIC_TEMPLATE', 'SEARCH_INDEX_ENTRY') then case
           when e.kind <> 'ABSENCE_CHECK' then case a.type when 'SOURCE_RECORD' then 'source record' when 'BIOMETRIC_TEMPLATE' then 'template' else 'index entry' end || ' requires committed absence evidence'
           when a.commitment = '' then 'artifact has no pre-deletion commitment'
           when a.commitment <> e.commitment then 'commitment mismatch'
           when not e.observed_absent then 'absence was not observed'
           else 'committed artifact is absent' end
      when a.type = 'CACHE_ENTRY' then case
           when e.kind <> 'CACHE_INVALIDATION' then 'cache requires invalidation evidence'
           when e.md_propagation_deadline is null or not regexp_full_match(e.md_propagation_deadline, '[0-9]+') then 'cache evidence lacks a propagation deadline'
           when cast(e.md_propagation_deadline as bigint) > {NOW_EPOCH} then 'cache invalidation is still propagating'
           when not e.observed_absent then 'cache absence was not observed'
           else 'cache invalidation propagated' end
      when a.type = 'BACKUP_COPY' and a.state = 'WAITING_EXPIRY' then case
           when e.kind <> 'EXPIRY_SCHEDULE' then 'pending backup requires an expiry schedule'
           when e.expires_epoch is null then 'backup schedule lacks an expiry time'
           else 'backup has a future expiry schedule' end
      when a.type = 'BACKUP_COPY' then case
           when e.kind <> 'CRYPTO_ERASURE' then 'erased backup requires cryptographic-erasure evidence'
           when e.valid_signature and e.md_key_destroyed = 'true' then 'backup encryption key destruction is attested'
           else 'backup key destruction is not attested' end
      when a.type = 'MODEL_INFLUENCE' then case
           when e.kind <> 'MODEL_AUDIT' then 'model influence requires a frozen model audit'
           when coalesce(e.md_protocol_id, '') = '' then 'model audit lacks a frozen protocol id'
           when coalesce(e.md_reference_id, '') = '' then 'model audit lacks an exact-retraining reference'
           when coalesce(e.md_pass, '') <> 'true' then 'model audit did not pass'
           else 'model audit passed against exact retraining' end
      when a.type = 'AUDIT_RECEIPT' then case
           when e.kind <> 'SIGNED_STATEMENT' or not e.valid_signature then 'audit receipt requires a valid signature'
           when e.md_replayed = 'true' then 'audit receipt nonce was replayed'
           when coalesce(e.md_graph_root, '') = '' or coalesce(e.md_expected_graph_root, '') <> e.md_graph_root then 'audit receipt graph root does not match'
           else 'receipt envelope is valid' end
      else 'unsupported artifact type' end as reason) x
"""
GRAPH_CTES = {"inner_edges": SAME_SUBJECT_EDGES, "roots": ROOTS, "walks": WALKS, "best": BEST}
AUDIT_CTES = {**GRAPH_CTES, "checks": CHECKS}
STATUS = """
    select subject_id, count(path) as reachable,
      count(*) filter (path is not null and state = 'ACTIVE') as residuals,
      count(*) filter (path is not null and not valid) as invalid,
      count(*) filter (path is not null and effective_state = 'WAITING_EXPIRY') as waiting,
      count(*) filter (path is null and state = 'ACTIVE') as unreachable_active,
      case when residuals > 0 then 'INCOMPLETE' when reachable = 0 or invalid > 0 or waiting > 0 then 'UNVERIFIED'
           else 'COMPLETE' end as status
    from {checks} c left join (select artifact_id, path from {best}) b using (artifact_id) group by subject_id
"""


@query("subject_roots", "select * from {roots}", {"inner_edges": SAME_SUBJECT_EDGES, "roots": ROOTS})
def subject_roots(spark, sf):
    artifacts, lineage, _ = audit_inputs(spark, sf)
    return A.subject_roots(artifacts, lineage)


@query(
    "shortest_lineage_paths",
    "select subject_id, artifact_id, array_to_string(path, '>') as path from {best}",
    GRAPH_CTES,
)
def shortest_lineage_paths(spark, sf):
    artifacts, lineage, _ = audit_inputs(spark, sf)
    paths = A.shortest_paths(artifacts, lineage)
    return paths.select("subject_id", "artifact_id", F.array_join("path", ">").alias("path"))


@query(
    "evidence_checks",
    "select artifact_id, valid, reason, effective_state from {checks}",
    {"checks": CHECKS},
    materialized=True,
)
def evidence_checks(spark, sf):
    artifacts, _, evidence = audit_inputs(spark, sf)
    checks = A.check_evidence(artifacts, evidence, NOW_EPOCH)
    return checks.select("artifact_id", "valid", "reason", "effective_state")


@query("audit_status", "select * from {status}", {**AUDIT_CTES, "status": STATUS})
def audit_status(spark, sf):
    return A.audit(*audit_inputs(spark, sf), NOW_EPOCH).status


@query(
    "audit_status_counts",
    "select status, count(*) as subjects from {status} group by status",
    {**AUDIT_CTES, "status": STATUS},
)
def audit_status_counts(spark, sf):
    run = A.audit(*audit_inputs(spark, sf), NOW_EPOCH)
    return run.status.groupBy("status").agg(F.count(F.lit(1)).alias("subjects"))


_RESIDUALS = """
    select c.subject_id, c.artifact_id, len(b.path) as path_length, b.path,
      case when active_sink then 'active sink remains reachable' else 'active artifact remains' end as reason
    from {checks} c join {best} b using (artifact_id) where c.state = 'ACTIVE'
"""


@query(
    "residual_paths",
    """select subject_id, artifact_id, path_length, array_to_string(path, '>') as path, reason,
         row_number() over (partition by subject_id order by path_length, r.path, reason) as position
       from {residuals} r""",
    {**AUDIT_CTES, "residuals": _RESIDUALS},
)
def residual_paths(spark, sf):
    run = A.audit(*audit_inputs(spark, sf), NOW_EPOCH)
    return A.residual_paths(run).withColumn("path", F.array_join("path", ">"))


@query(
    "shortest_residual",
    """select subject_id, path_length, array_to_string(path, '>') as path, reason from (
         select *, row_number() over (partition by subject_id order by path_length, path, reason) as rn
         from {residuals}) where rn = 1""",
    {**AUDIT_CTES, "residuals": _RESIDUALS},
)
def shortest_residual(spark, sf):
    run = A.audit(*audit_inputs(spark, sf), NOW_EPOCH)
    return A.shortest_residual(run).withColumn("path", F.array_join("path", ">"))


@query(
    "baseline_receipt_only",
    """select a.subject_id, bool_or(a.type = 'AUDIT_RECEIPT' and coalesce(e.valid_signature, false)) as declared_complete,
         cast(0 as bigint) as detected
       from {artifacts} a left join {evidence_flat} e using (artifact_id) group by a.subject_id""",
)
def baseline_receipt_only(spark, sf):
    artifacts, _, evidence = audit_inputs(spark, sf)
    return A.baseline_audit("receipt-only", artifacts, evidence, NOW_EPOCH)


_CHECKLIST = ("SOURCE_RECORD", "BIOMETRIC_TEMPLATE", "SEARCH_INDEX_ENTRY")


@query(
    "baseline_flat_checklist",
    f"""select subject_id, count(*) filter (type in {_CHECKLIST} and not valid) as detected,
          detected = 0 as declared_complete from {{checks}} group by subject_id""",
    {"checks": CHECKS},
)
def baseline_flat_checklist(spark, sf):
    artifacts, _, evidence = audit_inputs(spark, sf)
    return A.baseline_audit("flat-checklist", artifacts, evidence, NOW_EPOCH, _CHECKLIST)


@query(
    "baseline_untyped_traversal",
    f"""select a.subject_id, count(*) filter (a.state = 'ACTIVE' or coalesce(e.expires_epoch <= {NOW_EPOCH}, false)
          or not coalesce(e.observed_absent or e.valid_signature or coalesce(md_propagation_deadline, md_key_destroyed,
             md_protocol_id, md_reference_id, md_pass, md_enforced, md_control_id, md_replayed, md_graph_root,
             md_expected_graph_root) is not null, false)) as detected,
          detected = 0 as declared_complete
        from {{artifacts}} a left join {{evidence_flat}} e using (artifact_id) group by a.subject_id""",
)
def baseline_untyped_traversal(spark, sf):
    artifacts, _, evidence = audit_inputs(spark, sf)
    return A.baseline_audit("untyped-traversal", artifacts, evidence, NOW_EPOCH)
