"""Conversations as receipt chains, orders as envelopes, events as lifecycles and stores."""

from __future__ import annotations

from traceless.plans import lineage_tables  # noqa: F401
from traceless.plans.catalog import projection

projection(
    "receipts_base",
    """
    select conv_id as chain_id, turn as seq, case when conv_id % 41 = 3 and turn = 1 then 'v0' else 'v1' end as schema_version,
      'q' || cast(conv_id as string) as request_id, md5(text) as graph_root,
      cast(case when conv_id % 37 = 5 then 500 else 100 + turn end - case when conv_id % 31 = 6 then 90 else 0 end as bigint) as issued_epoch,
      case when conv_id % 11 = 2 and turn = 2 then 'n-0' else 'n-' || cast(turn as string) end as nonce,
      not (conv_id % 29 = 7 and turn = 0) as signature_ok, conv_id % 23 = 8 and turn = 1 as broken_link
    from {conversations}
    """,
)
projection(
    "envelope_base",
    """
    select o_orderkey as position, 'k' || cast(o_custkey % 5 as string) as key_id, 'n' || cast(o_orderkey % 900 as string) as nonce,
      case when o_orderkey % 61 = 4 then 'v0' else 'v1' end as schema_version,
      cast(case when o_orderkey % 53 = 5 then 500 when o_orderkey % 47 = 6 then 5 else 90 end as bigint) as issued_epoch,
      o_orderkey % 43 <> 7 as signature_ok, 'o' || cast(o_orderkey as string) as artifact_id
    from {orders}
    """,
)
projection(
    "request_events",
    """
    select user_id as request_id, ts, event_id,
      case event_id * 7 % 11 when 0 then 'create-request' when 1 then 'delete-visible' when 2 then 'simulate-recovery' when 3 then 'run-probes'
        when 4 then 'apply-exact-cut' when 5 then 'verify-replay' when 6 then 'create-request' when 7 then 'delete-visible' else 'verify-replay' end as action
    from {events}
    """,
)
projection(
    "store_rows",
    """
    select case type when 'SOURCE_RECORD' then 'source' when 'SEARCH_INDEX_ENTRY' then 'index' when 'CACHE_ENTRY' then 'cache'
        when 'BACKUP_COPY' then 'backup' else 'model' end as store_id,
      subject_id, artifact_id, k as version, 'row-' || artifact_id as payload
    from {lineage_base} where state = 'ACTIVE' or k % 151 = 3
    """,
    written=True,
)
projection("erasure_requests", "select 's' || cast(c_custkey as string) as subject_id from {customer} where c_acctbal < 1500")
