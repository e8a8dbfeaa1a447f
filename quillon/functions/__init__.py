"""Expressions: trees, parsing, and lowering to columns."""
