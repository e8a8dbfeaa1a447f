"""Inner equi-joins by a chosen strategy.

All strategies give the same bag of rows: left columns, then right ones, both keys kept. They differ in how Spark is asked to run them.
A nested loop is run as a broadcast join while the right side's size, as Spark estimates it, stays under a bound, and as a sort-merge
join beyond it: no strategy here multiplies the sides or sends one that has no bound. A hash join, whose tables are held in memory and
cannot spill, is run as such while a partition of the right side stays under a bound, and as a sort-merge join beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError

#: strategy: Spark's hint. Nested loops are broadcast under BROADCAST_BYTES; hash tables are built under HASH_BYTES for each partition.
HINTS = {"snlj": "broadcast", "pnlj": "broadcast", "bnlj": "broadcast", "sortmerge": "merge", "shj": "shuffle_hash", "ghj": "shuffle_hash"}
BROADCAST_BYTES, HASH_BYTES = 64 << 20, 128 << 20


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def equi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, strategy: str | None = None) -> DataFrame:
    """Keys are names of columns, which must differ between the sides; numbers of different widths are equal if their values are."""
    if strategy is not None:
        if strategy.lower() not in HINTS:
            raise EngineError(f"unknown join strategy {strategy}")
        hint = HINTS[strategy.lower()]
        parts = int(right.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        most = {"broadcast": BROADCAST_BYTES, "shuffle_hash": HASH_BYTES * parts}.get(hint)
        if most is not None and estimated_bytes(right) > most:
            hint = "merge"
        right = right.hint(hint)
    return left.join(right, F.col(f"`{left_key}`") == F.col(f"`{right_key}`"), "inner")
