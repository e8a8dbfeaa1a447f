"""Sort, limit and offset. Spark fuses a sort and a limit into one top-k, which no task outgrows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sort(df: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """Keys are (column, descending)."""
    return df.orderBy(*[F.col(f"`{c}`").desc() if down else F.col(f"`{c}`").asc() for c, down in keys])


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """The first n rows after `offset`; a negative n is no limit."""
    if offset > 0:
        df = df.offset(offset)
    return df if n < 0 else df.limit(n)
