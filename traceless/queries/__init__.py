"""All registered queries; importing the package fills the registry."""

from traceless.queries import (  # noqa: F401
    audit_queries,
    discovery_queries,
    influence_queries,
    ledger_queries,
    outcome_queries,
    request_queries,
    sampling_queries,
    source_queries,
    streaming_queries,
    temporal_queries,
    validation_queries,
)
from traceless.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
