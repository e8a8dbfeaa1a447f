"""URL filters by a sort-merge range join.

A rule of host H and path P covers H, all its subdomains, and every path that begins with P. With the host's labels reversed, the
canonical key `reversed host / path` of a rule is a prefix of the keys of the urls that it covers, so a rule is the interval of keys
from its own key up to that key followed by byte 0xFF, which no UTF-8 text contains. Rules that share a host are nested or apart, so one
pass over starts, ends and urls in key order keeps the open rules as a stack: a start puts its rule at its depth, an end lowers the
depth, and a url reads the top. The stack nests paths; hosts nest otherwise: a url takes part once for each domain of its host that has
rules, found by an equality of reversed hosts, and the longest of what its domains say wins.

Starts, ends and urls are ranged by domain and key into parts of about SWEEP_ROWS; equal urls part by row number. A part is swept on its
own: its stack begins with the rules that are open at its border, which are those whose keys are prefixes of the border's key, found by
equality. So a rule is sent once, and once more for each border that it covers. Everything is built-in functions. Texts of pages are not read.

Defined results: a null url, or one without `://`, has empty host and path; where no rule fits, rule is null and the verdict is the
default. The longest rule wins by its length in characters, then by its host's; of rules with the same host and path block wins over allow.
Repeated rows and null page_ids stay as they are; extra columns are ignored; a url is taken whole, however long; an empty table, or no
rules, gives what follows from that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, stored

#: Events of a part that one sweep takes, about.
SWEEP_ROWS = 20_000
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path) of the registered query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def rule_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(domain: Column, path: Column) -> Column:
    """Hosts have no slash, so the first one ends the domain."""
    return F.concat(domain, F.lit("/"), path).cast("binary")


def _steps(df: DataFrame, group: list[str]) -> DataFrame:
    """Adds the depth of the stack after each event. At one key, starts come before urls."""
    order = Window.partitionBy(*group).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_depth", F.sum(F.when(F.col("_kind") == 0, 1).when(F.col("_kind") == 2, -1).otherwise(0)).over(order))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    url = F.col("url")
    slim = stored(pages.select(F.col("page_id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("_row", F.monotonically_increasing_id()), "url-pages")
    labels = F.split(F.col("host"), r"\.")
    named = rules.select("verdict", F.coalesce("host", F.lit("")).alias("_h"), F.coalesce("path", F.lit("")).alias("_p"))
    ours = named.groupBy("_h", "_p").agg(F.max("verdict").alias("verdict")).withColumn("_domain", F.array_join(_reversed(F.col("_h")), "."))
    ours = ours.withColumn("_rule", F.struct((F.length("_h") + F.length("_p")).alias("n"), F.length("_h").alias("nh"), F.concat("_h", "_p").alias("rule"), "verdict"))
    ours = stored(ours.select("_domain", "_rule", _key(F.col("_domain"), F.col("_p")).alias("_at"), F.size(F.split("_h", r"\.")).alias("_labels")), "url-rules")
    deepest = ours.agg(F.max("_labels")).first()[0] or 0
    opened = ours.select("_domain", "_at", F.lit(0).alias("_kind"), "_rule")
    closed = ours.select("_domain", F.expr("_at || X'FF'").alias("_at"), F.lit(2).alias("_kind"), F.lit(None).cast(ours.schema["_rule"].dataType).alias("_rule"))
    edges = opened.unionByName(closed)
    nesting = _steps(edges, ["_domain"]).agg(F.max("_depth")).first()[0] or 0
    plain = slim.select("page_id", "host", "path")
    if not nesting:
        return plain.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    levels = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))), lambda i: F.array_join(F.slice(_reversed(F.col("host")), F.lit(1), i), "."))
    urls = slim.withColumn("_domain", F.explode(levels)).join(ours.select("_domain").distinct(), "_domain", "left_semi")
    urls = urls.select("_domain", _key(F.col("_domain"), F.col("path")).alias("_at"), F.lit(1).alias("_kind"), "_row")
    found = stored(urls.unionByName(edges, allowMissingColumns=True), "url-events")
    parts = -(-found.count() // SWEEP_ROWS)
    ranged = stored(found.repartitionByRange(parts, "_domain", "_at", "_kind", "_row").withColumn("_part", F.spark_partition_id()), "url-parts")
    discard(found)
    # the rules that are open where a part begins: their keys are prefixes of its first key, and started before it
    first = ranged.groupBy("_part").agg(F.min(F.struct("_domain", "_at", "_kind")).alias("b")).select("_part", "b.*")
    longest = F.least(F.length("_at"), F.lit(ours.agg(F.max(F.length("_at"))).first()[0]))
    prefixes = first.select("_part", "_domain", F.col("_at").alias("_first"), F.col("_kind").alias("_first_kind"), F.explode(F.sequence(F.lit(1), longest)).alias("_n"))
    prefixes = prefixes.withColumn("_at", F.expr("substring(_first, 1, _n)")).where("NOT (_at = _first AND _first_kind = 0)")
    seeds = prefixes.join(opened, ["_domain", "_at"]).select("_part", "_domain", "_at", "_kind", "_rule")
    group = ["_part", "_domain"]
    events = _steps(ranged.unionByName(seeds, allowMissingColumns=True), group)
    order = Window.partitionBy(*group).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stack = F.array(*[F.last(F.when((F.col("_kind") == 0) & (F.col("_depth") == d), F.col("_rule")), ignorenulls=True).over(order) for d in range(1, nesting + 1)])
    hits = events.select("_row", "_kind", F.when(F.col("_depth") > 0, F.get(stack, F.col("_depth") - 1)).alias("_top")).where("_kind = 1 AND _top IS NOT NULL")
    best = hits.groupBy("_row").agg(F.max("_top").alias("_best"))
    return slim.join(best, "_row", "left").select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


ORACLE = rf"""
WITH rules(verdict, h, p) AS (VALUES {", ".join(str(r) for r in RULES)}),
u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{_PARTS}', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
             coalesce(regexp_extract(url, '{_PARTS}', 2), '') AS path, row_number() OVER () AS r FROM pages),
m AS (SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
      FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (r)"""
