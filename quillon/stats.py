"""Column statistics: equi-width histograms and the estimates that follow from them.

One pass finds minima and maxima, a second counts rows for each bucket, and distinct values by a sketch; both are partial aggregates, and
what is shuffled is a row for each column and bucket of a task. Strings are placed by hash, so only equality means anything for them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .types import kind_of


@dataclass(frozen=True)
class Bucket:
    low: float
    high: float
    rows: int
    distinct: int


@dataclass(frozen=True)
class Histogram:
    kind: str
    buckets: tuple[Bucket, ...]

    @property
    def rows(self) -> int:
        return sum(b.rows for b in self.buckets)

    @property
    def distinct(self) -> int:
        return sum(b.distinct for b in self.buckets)

    def selectivity(self, op: str, value: float) -> float:
        """The share of rows for which the predicate holds: buckets count by how much of their width it covers."""
        if not self.rows:
            return 0.0
        if op in ("=", "<>"):
            b = next((b for b in self.buckets if b.low <= value < b.high or value == b.high == self.buckets[-1].high), None)
            equal = b.rows / b.distinct / self.rows if b and b.distinct else 0.0
            return equal if op == "=" else 1.0 - equal
        if self.kind == "string":
            return 1.0
        below = 0.0
        for b in self.buckets:
            part = 1.0 if value >= b.high else 0.0 if value <= b.low else (value - b.low) / (b.high - b.low)
            below += b.rows * part
        less = below / self.rows
        return less if op in ("<", "<=") else 1.0 - less


@dataclass(frozen=True)
class TableStats:
    rows: int
    columns: dict[str, Histogram]

    def filtered(self, column: str, op: str, value: float) -> float:
        """Estimated rows after a filter; columns count as independent."""
        return self.rows * self.columns[column].selectivity(op, value)

    def joined(self, column: str, other: TableStats, other_column: str) -> float:
        """Estimated rows of an equi-join."""
        distinct = max(self.columns[column].distinct, other.columns[other_column].distinct)
        return self.rows * other.rows / max(1, distinct)


def _number(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    return F.hash(c).cast("double") if kind == "string" else c.cast("int").cast("double") if kind == "bool" else c.cast("double")


def analyze(df: DataFrame, buckets: int = 10) -> TableStats:
    """Histograms of every bool, number and string column. The first bucket begins at 0 or below, the last value is in the last bucket."""
    kinds = {f.name: kind_of(f.dataType) for f in df.schema if kind_of(f.dataType) not in ("bytes", "other")}
    ends = df.agg(F.count(F.lit(1)).alias("rows"), *[g(_number(n, k)).alias(f"{g.__name__}_{i}") for i, (n, k) in enumerate(kinds.items()) for g in (F.min, F.max)]).first()
    bounds = {}
    for i, n in enumerate(kinds):
        low = min(0.0, ends[f"min_{i}"] or 0.0)
        high = max(0.0, ends[f"max_{i}"] or 0.0)
        bounds[n] = (low, high if high > low else low + 1.0)
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _number(n, k).alias("v")) for i, (n, k) in enumerate(kinds.items())])).alias("c")).select("c.i", "c.v").where("v IS NOT NULL") if kinds else None
    found: dict[tuple[int, int], tuple[int, int]] = {}
    if cells is not None:
        low = F.element_at(F.array(*[F.lit(a) for a, _ in bounds.values()]), F.col("i") + 1)
        high = F.element_at(F.array(*[F.lit(b) for _, b in bounds.values()]), F.col("i") + 1)
        placed = cells.withColumn("b", F.least(F.floor((F.col("v") - low) / (high - low) * buckets), F.lit(buckets - 1)))
        sums = placed.groupBy("i", "b").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("v", 0.01).alias("d"))
        found = {(r["i"], r["b"]): (r["rows"], min(r["rows"], r["d"])) for r in sums.collect()}
    columns = {}
    for i, (n, k) in enumerate(kinds.items()):
        a, b = bounds[n]
        step = (b - a) / buckets
        columns[n] = Histogram(k, tuple(Bucket(a + j * step, a + (j + 1) * step, *found.get((i, j), (0, 0))) for j in range(buckets)))
    return TableStats(ends["rows"], columns)
