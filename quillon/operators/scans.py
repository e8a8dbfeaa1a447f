"""Scans: whole tables, and the ordered and keyed ones that stand for index access.

A filter on the key reaches the parquet reader as a pushed filter; tables that are clustered on the key then skip row groups by their
minima and maxima. Ordered scans are range-partitioned sorts, so no task holds more than its range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREDICATES = {"=": "=", "==": "=", "<": "<", "<=": "<=", ">": ">", ">=": ">=", "<>": "<>", "!=": "<>"}


def predicate(df: DataFrame, column: str, op: str, value: object) -> DataFrame:
    c = F.col(f"`{column}`")
    return df.where({"=": c == value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value, "<>": c != value}[PREDICATES[op]])


def index_scan(df: DataFrame, column: str, op: str, value: object) -> DataFrame:
    """Rows for which the predicate holds, in key order. <> is not a range, so no index serves it."""
    if PREDICATES[op] == "<>":
        raise ValueError("an index scan takes =, <, <=, > or >=")
    return predicate(df, column, op, value).orderBy(F.col(f"`{column}`"))


def sorted_scan(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(F.col(f"`{column}`"))


def sorted_scan_from(df: DataFrame, column: str, start: object) -> DataFrame:
    """Rows with keys of at least `start`, in key order."""
    return index_scan(df, column, ">=", start)


def key_lookup(df: DataFrame, column: str, key: object) -> DataFrame:
    return predicate(df, column, "=", key)


def contains_key(df: DataFrame, column: str, key: object) -> bool:
    return not key_lookup(df, column, key).isEmpty()
