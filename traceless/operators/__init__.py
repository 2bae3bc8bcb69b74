"""Relational operators of the deletion audit."""
