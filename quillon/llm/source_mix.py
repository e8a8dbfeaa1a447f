"""Mixing sources to target weights.

Within each source, documents get a key from a hash of their id and text and are sorted by it. Prefix sums of their sizes over that order place
each document on a line as long as its source; the source's budget cuts the line, after going round it once for every whole time that
it fits. The sums are distributed: the leading digits of the key divide a source into ranges, and half of these digits into wide ranges;
totals of wide ranges are summed in order, then those of the ranges in each, and each range adds its own running sum. Only totals of
ranges and sources meet in windows, never the documents of a hot source. One row for each source meets in one task.

Sources in code point order, null last, weigh 1, 2, 3 and so on in turn. All targets together are all sizes; no target exceeds three
times its source's size, and what that leaves goes to the others by weight.

Defined results: null text has size 0 and takes nothing; a null source is a source; an empty table gives an empty mix; a text is
counted whole, however long. Rows with equal id and text have equal keys: what falls to them is shared in a fixed way, the first taking
all before the next. Rows with equal or null ids and different texts have keys of their own. Extra columns are ignored by `mix` and kept
by `mixed_rows`, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, stored, text_of

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
SEED = "mix-1"
#: Rows of a range, about; a range's rows are sorted together in one task.
RANGE_ROWS = 2048


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, SPACE), "")).cast("long")


def _keyed(docs: DataFrame, *extra: Column) -> DataFrame:
    """source is null-safe as _source: it begins with v, or is n."""
    doc_id = F.col("doc_id")
    return docs.select(
        doc_id.cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("v"), F.col("source").cast("string")), F.lit("n")).alias("_source"),
        word_count(text_of()).alias("size"),
        F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(text_of().cast("binary"))).cast("binary")).alias("_key"),
        *extra,
    )


def budgets(totals: DataFrame) -> DataFrame:
    """_source, source_size -> also target, _epochs and _rest. One row for each source, so plain windows over all of them do.

    Sources in order of size over weight reach three times their size first; while they do, the level of the others is what is left
    over the weights that are left. The first source below its limit fixes the level."""
    every = Window.partitionBy()
    named = totals.withColumn("_weight", (F.row_number().over(Window.orderBy(F.col("_source") == "n", "_source")) - 1) % len(WEIGHTS))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("_weight") + 1).cast("double")
    df = named.withColumn("_weight", weight).withColumn("_limit", MOST_EPOCHS * F.col("source_size"))
    by_need = Window.orderBy(F.col("_limit") / F.col("_weight"), "_source")
    before = F.coalesce(F.sum("_limit").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("_level", (F.sum("source_size").over(every) - before).cast("double") / F.sum("_weight").over(by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    df = df.withColumn("_full", F.col("_limit") <= F.col("_weight") * F.col("_level"))
    level = F.first(F.when(~F.col("_full"), F.col("_level")), ignorenulls=True).over(by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    df = df.withColumn("target", F.when(F.col("_full"), F.col("_limit").cast("double")).otherwise(F.col("_weight") * level))
    budget = F.least(F.floor(F.col("target") + 0.5), F.col("_limit"))
    df = df.withColumn("_epochs", F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(F.lit(0)).cast("long"))
    return df.select("_source", "source_size", "target", "_epochs", (budget - F.col("_epochs") * F.col("source_size")).cast("long").alias("_rest"))


def _taken(keyed: DataFrame, extra: list[str]) -> DataFrame:
    totals = stored(keyed.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")), "mix-sources")
    largest = totals.agg(F.max("_rows")).first()[0] or 1
    digits = min(12, max(2, math.ceil(math.log(max(1, largest / RANGE_ROWS), 16))))
    rows = keyed.withColumn("_range", F.substring("_key", 1, digits))
    ranges = rows.groupBy("_source", "_range").agg(F.sum("size").alias("_size")).withColumn("_wide", F.substring("_range", 1, digits // 2))

    def before(total: str, order: str, *within: str) -> Column:
        return F.coalesce(F.sum(total).over(Window.partitionBy("_source", *within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    wide = ranges.groupBy("_source", "_wide").agg(F.sum("_size").alias("_sum")).select("_source", "_wide", before("_sum", "_wide").alias("_ahead"))
    placed = ranges.select("_source", "_wide", "_range", before("_size", "_range", "_wide").alias("_start")).join(wide, ["_source", "_wide"])
    starts = placed.select("_source", "_range", (F.col("_start") + F.col("_ahead")).alias("_start")).join(budgets(totals.drop("_rows")), "_source")
    inside = Window.partitionBy("_source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("_before", F.sum("size").over(inside) - F.col("size")).join(starts, ["_source", "_range"])
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_start") - F.col("_before")))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("_epochs") * F.col("size") + cut).cast("long").alias("taken"), F.col("_epochs").alias("_whole"), cut.cast("long").alias("_cut"), *extra)


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document. Texts are read once; ids, sources, sizes and keys are kept in the
    shared folder for the passes after that."""
    keyed = stored(_keyed(docs), "mix-keys")
    return _taken(keyed, []).select("doc_id", "size", "source_size", "target", "taken")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    lead = F.when(F.regexp_like(text, F.lit(r"^[\x20\x09-\x0D]")), 1).otherwise(0)
    rest = F.get(F.split(text, SPACE, (n + lead + 1).cast("int")), (n + lead).cast("int"))
    return F.when(n <= 0, "").otherwise(F.when(rest.isNull(), text).otherwise(F.rtrim(F.substring(text, F.lit(1), F.length(text) - F.length(rest)), F.lit(" \t\n\x0b\x0c\r"))))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix itself: every row as often as the mix takes it whole, and once more up to its cut where that falls inside it. Columns are
    those of the input. Sizes and shares are worked out on slim rows; the texts are joined back by a row number kept with the input."""
    columns = docs.columns
    names = [f"_in_{i}" for i in range(len(columns))]
    numbered = stored(docs.toDF(*names).withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    back = numbered.select("_row", *[F.col(names[columns.index(c)]).alias(c) for c in ("doc_id", "text", "source")])
    shares = _taken(stored(_keyed(back, F.col("_row")), "mix-keys"), ["_row"]).where("taken > 0").select("_row", "size", "_whole", "_cut")
    text = F.col(names[columns.index("text")])
    copies = F.expr("transform(sequence(1, cast(_whole + if(_cut > 0, 1, 0) as int)), i -> if(i <= _whole, size, _cut))")
    df = numbered.join(shares, "_row").withColumn("_n", F.explode(copies))
    out = [F.when(F.col("_n") < F.col("size"), first_words(text, F.col("_n"))).otherwise(text).alias(c) if c == "text" else F.col(n).alias(c) for n, c in zip(names, columns, strict=True)]
    if "n_chars" in columns:
        out[columns.index("n_chars")] = F.when(F.col("_n") < F.col("size"), F.length(first_words(text, F.col("_n"))).cast("long")).otherwise(F.col(names[columns.index("n_chars")])).alias("n_chars")
    return df.select(*out)


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(sum(size)) OVER ()::BIGINT AS total FROM d GROUP BY source),
w AS (SELECT *, (((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1)::DOUBLE AS weight, {MOST_EPOCHS} * source_size AS lim FROM s),
l AS (SELECT *, (total - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT *, CASE WHEN lim <= weight * lev THEN lim::DOUBLE
                ELSE weight * (SELECT arg_min(lev, lim / weight) FROM l WHERE lim > weight * lev) END AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
c AS (SELECT d.*, source_size, target, epochs, floor(target + 0.5)::BIGINT - epochs * source_size AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS ahead
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken FROM c"""
