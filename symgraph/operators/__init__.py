"""Operators over the tables of a code graph."""
