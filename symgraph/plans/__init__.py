"""Queries over the given tables, and what long plans need."""
