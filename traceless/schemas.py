"""Column layouts and allowed values of the audit tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Names that audit documents use on the wire.
ARTIFACT_TYPES = (
    "SOURCE_RECORD",
    "BIOMETRIC_TEMPLATE",
    "SEARCH_INDEX_ENTRY",
    "CACHE_ENTRY",
    "BACKUP_COPY",
    "MODEL_INFLUENCE",
    "AUDIT_RECEIPT",
)
ARTIFACT_STATES = ("ACTIVE", "ERASED", "BLOCKED", "WAITING_EXPIRY", "UNVERIFIED")
EDGE_TYPES = (
    "COPIED_TO",
    "DERIVED_INTO",
    "INDEXED_AS",
    "BACKED_UP_AS",
    "USED_TO_TRAIN",
    "SUPERSEDED_BY",
)
EVIDENCE_KINDS = (
    "ABSENCE_CHECK",
    "CACHE_INVALIDATION",
    "EXPIRY_SCHEDULE",
    "CRYPTO_ERASURE",
    "MODEL_AUDIT",
    "SIGNED_STATEMENT",
)
PATH_STATES = ("ACTIVE", "CLOSED", "UNKNOWN")
PATH_EDGE_KINDS = ("MATERIAL", "INFLUENCE", "PROCESSING")
CHANNEL_DECISIONS = ("PASS", "FAIL", "UNKNOWN")
POLICY_DECISIONS = ("ERASE_REQUIRED", "BLOCK_ALLOWED", "RETENTION_REQUIRED")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


STRING, LONG, BOOL, DOUBLE = T.StringType(), T.LongType(), T.BooleanType(), T.DoubleType()
STRINGS = T.ArrayType(STRING)

ARTIFACTS = _struct(
    artifact_id=STRING,
    subject_id=STRING,
    type=STRING,
    state=STRING,
    active_sink=BOOL,
    purpose=STRING,
    commitment=STRING,
    evidence_id=STRING,
)
LINEAGE = _struct(source_id=STRING, target_id=STRING, edge_type=STRING, cross_subject=BOOL)
EVIDENCE = _struct(
    evidence_id=STRING,
    artifact_id=STRING,
    kind=STRING,
    valid_signature=BOOL,
    commitment=STRING,
    observed_absent=BOOL,
    issued_epoch=LONG,
    expires_epoch=LONG,
    metadata=T.MapType(STRING, STRING),
)
VIOLATIONS = _struct(entity=STRING, entity_id=STRING, rule=STRING)
