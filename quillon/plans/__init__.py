"""Parsing, the query builder and plan trees."""
