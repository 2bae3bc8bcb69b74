"""Readers and writers for audit documents, ledgers and trial tables."""
