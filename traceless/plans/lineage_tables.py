"""Customers, orders and line items as subjects, artifacts, lineage and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceless.plans.catalog import projection, table

NOW_EPOCH = 100

_TYPE = (
    "case {k} % 6 when 0 then 'BIOMETRIC_TEMPLATE' when 1 then 'SEARCH_INDEX_ENTRY'"
    " when 2 then 'CACHE_ENTRY' when 3 then 'BACKUP_COPY' when 4 then 'MODEL_INFLUENCE'"
    " else 'AUDIT_RECEIPT' end"
)


def _type(key: str) -> str:
    return _TYPE.replace("{k}", key)


projection(
    "lines",
    """
    select l_orderkey, l_linenumber, max(l_partkey) as pk, max(l_suppkey) as sk,
           max(l_returnflag) as rf, max(l_quantity) as qty
    from {lineitem} group by l_orderkey, l_linenumber
    """,
    written=True,
)
projection(
    "lineage_base",
    f"""
    select 'c' || cast(c_custkey as string) as artifact_id,
           's' || cast(c_custkey as string) as subject_id,
           'SOURCE_RECORD' as type,
           case when c_custkey % 10 = 0 then 'ACTIVE'
                when c_custkey % 23 = 1 then 'UNVERIFIED' else 'ERASED' end as state,
           c_custkey as k, cast(null as string) as parent_id
    from {{customer}}
    union all
    select 'o' || cast(o_orderkey as string), 's' || cast(o_custkey as string),
           {_type('o_orderkey')},
           case when o_orderstatus = 'O' and o_orderkey % 97 = 0 then 'ACTIVE'
                when o_orderstatus = 'P' and o_orderkey % 6 = 3 and o_orderkey % 31 = 3 then 'WAITING_EXPIRY'
                when o_orderstatus = 'P' and o_orderkey % 41 = 0 then 'BLOCKED'
                else 'ERASED' end,
           o_orderkey, 'c' || cast(o_custkey as string)
    from {{orders}}
    union all
    select 'l' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string),
           's' || cast(o_custkey as string), {_type('pk')},
           case when rf = 'R' and pk % 101 = 0 then 'ACTIVE' else 'ERASED' end,
           pk, 'o' || cast(l_orderkey as string)
    from {{lines}} join {{orders}} on l_orderkey = o_orderkey
    """,
    written=True,
)
projection(
    "artifacts",
    """
    select artifact_id, subject_id, type, state, state = 'ACTIVE' and k % 3 <> 0 as active_sink,
           'service' as purpose, case when k % 401 = 9 then '' else 'm-' || artifact_id end as commitment,
           'e-' || artifact_id as evidence_id, k
    from {lineage_base}
    """,
)
projection(
    "lineage",
    """
    select parent_id as source_id, artifact_id as target_id,
           case type when 'BIOMETRIC_TEMPLATE' then 'DERIVED_INTO' when 'SEARCH_INDEX_ENTRY' then 'INDEXED_AS'
                when 'CACHE_ENTRY' then 'COPIED_TO' when 'BACKUP_COPY' then 'BACKED_UP_AS'
                when 'MODEL_INFLUENCE' then 'USED_TO_TRAIN' else 'DERIVED_INTO' end as edge_type,
           false as cross_subject
    from {lineage_base} where parent_id is not null and k % 127 <> 11
    union all
    select 'c' || substr(subject_id, 2), artifact_id, 'SUPERSEDED_BY', false
    from {lineage_base} where parent_id like 'o%' and k % 13 = 0
    union all
    select artifact_id, 'c' || cast(k - 1 as string), 'COPIED_TO', true
    from {lineage_base} where parent_id is null and k % 17 = 1
    """,
)
projection(
    "evidence_flat",
    """
    select 'e-' || artifact_id as evidence_id, artifact_id,
      case when state = 'BLOCKED' then 'SIGNED_STATEMENT'
           when state = 'WAITING_EXPIRY' then 'EXPIRY_SCHEDULE'
           when k % 109 = 8 then 'SIGNED_STATEMENT'
           when type = 'CACHE_ENTRY' then 'CACHE_INVALIDATION'
           when type = 'BACKUP_COPY' then 'CRYPTO_ERASURE'
           when type = 'MODEL_INFLUENCE' then 'MODEL_AUDIT'
           when type = 'AUDIT_RECEIPT' then 'SIGNED_STATEMENT'
           else 'ABSENCE_CHECK' end as kind,
      k % 113 <> 7 as valid_signature,
      case when k % 307 = 3 then 'damaged' else 'm-' || artifact_id end as commitment,
      k % 131 <> 10 as observed_absent,
      cast(10 as bigint) as issued_epoch,
      cast(case when k % 193 = 2 then 50 when k % 199 = 12 then null else 1000 end as bigint) as expires_epoch,
      case when type = 'CACHE_ENTRY' then case when k % 89 = 4 then '500' when k % 83 = 5 then 'soon' else '50' end end as md_propagation_deadline,
      case when type = 'BACKUP_COPY' then case when k % 73 = 7 then 'false' else 'true' end end as md_key_destroyed,
      case when type = 'MODEL_INFLUENCE' then case when k % 139 = 4 then '' else 'frozen-1' end end as md_protocol_id,
      case when type = 'MODEL_INFLUENCE' and k % 149 <> 4 then 'exact-1' end as md_reference_id,
      case when type = 'MODEL_INFLUENCE' then case when k % 79 = 6 then 'false' else 'true' end end as md_pass,
      case when state = 'BLOCKED' then 'true' end as md_enforced,
      case when state = 'BLOCKED' and k % 5 <> 0 then 'ctl' end as md_control_id,
      case when type = 'AUDIT_RECEIPT' and k % 61 = 5 then 'true' end as md_replayed,
      case when type = 'AUDIT_RECEIPT' then case when k % 67 = 5 then 'other' else 'root' end end as md_graph_root,
      case when type = 'AUDIT_RECEIPT' then 'root' end as md_expected_graph_root
    from {lineage_base} where k % 211 <> 1
    """,
)
projection(
    "remediations",
    """
    select distinct subject_id, subject_id || '/purge-' || lower(type) as action_id,
           cast(1 + length(type) % 7 as bigint) as cost, 'ERASED' as result_state,
           not (type = 'CACHE_ENTRY' and subject_id like '%3') as permitted, type as covers_type
    from {lineage_base} where type <> 'AUDIT_RECEIPT' or subject_id not like '%7'
    union all
    select distinct subject_id, subject_id || '/wipe-copies', cast(6 as bigint), 'ERASED', true, 'COPIES'
    from {lineage_base}
    """,
    written=True,
)
projection(
    "remediation_covers",
    """
    select r.action_id, a.artifact_id from {remediations} r join {lineage_base} a
      on r.subject_id = a.subject_id
     and (r.covers_type = a.type
          or (r.covers_type = 'COPIES' and a.type in ('CACHE_ENTRY', 'BACKUP_COPY', 'SEARCH_INDEX_ENTRY')))
    """,
    written=True,
)

_METADATA_KEYS = (
    "propagation_deadline",
    "key_destroyed",
    "protocol_id",
    "reference_id",
    "pass",
    "enforced",
    "control_id",
    "replayed",
    "graph_root",
    "expected_graph_root",
)


def evidence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence with its metadata columns folded into a map."""
    pairs = [F.lit(key) if i == 0 else F.col(f"md_{key}") for key in _METADATA_KEYS for i in (0, 1)]
    flat = table(spark, sf_dir, "evidence_flat")
    return flat.select(
        "evidence_id",
        "artifact_id",
        "kind",
        "valid_signature",
        "commitment",
        "observed_absent",
        "issued_epoch",
        "expires_epoch",
        F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("metadata"),
    )


def audit_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        table(spark, sf_dir, "artifacts"),
        table(spark, sf_dir, "lineage"),
        evidence_table(spark, sf_dir),
    )
