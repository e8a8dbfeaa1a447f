"""The aggregates, over columns and kinds.

Sums of bool and int are 64 bits wide, averages and spreads double. VARIANCE and STDDEV are those of a sample, 0 for one row.
FIRST and LAST follow a given order column, since a distributed table has no order of its own; RANDOM takes the row of the largest of
uniform random numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import TypeMismatch
from ..types import NUMERIC

ORDER, CHANCE = "__order", "__chance"


def aggregate(name: str, column: Column | None, kind: str) -> tuple[Column, str]:
    """The aggregate of a column (None: of rows) and its kind. ORDER and CHANCE must be columns of the input where they are used."""
    if name == "COUNT":
        return F.count(F.lit(1) if column is None else column), "long"
    if name in ("SUM", "AVG", "VARIANCE", "STDDEV") and kind not in NUMERIC or name == "RANGE" and kind not in NUMERIC[1:]:
        raise TypeMismatch(f"{name} does not take {kind}")
    if kind == "bytes":
        raise TypeMismatch(f"{name} does not take bytes")
    number = column.cast("int") if kind == "bool" else column
    if name == "SUM":
        return F.sum(number), "float" if kind == "float" else "long"
    if name == "AVG":
        return F.avg(number), "float"
    if name == "VARIANCE":
        return F.coalesce(F.var_samp(number), F.lit(0.0)), "float"
    if name == "STDDEV":
        return F.coalesce(F.stddev_samp(number), F.lit(0.0)), "float"
    if name == "RANGE":
        return F.max(column) - F.min(column), kind
    by = {"MIN": lambda: F.min(column), "MAX": lambda: F.max(column), "FIRST": lambda: F.min_by(column, F.col(ORDER)), "LAST": lambda: F.max_by(column, F.col(ORDER)), "RANDOM": lambda: F.max_by(column, F.col(CHANCE))}
    return by[name](), kind
