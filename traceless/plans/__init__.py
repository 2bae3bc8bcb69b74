"""Projections of the bundled star-schema tables onto the audit tables."""
