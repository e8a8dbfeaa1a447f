"""Quality rules: a threshold table compiled into one projection of built-in functions.

A rule compares a measure with a share of another one, in whole numbers: it fails a document if `measure * 100` is above (or below)
`percent * base`. All measures come from the whole text, row by row; there is no shuffle and no user function.

Defined results: null text counts as empty: no words, so it fails the length rule. Rows are independent: repeated rows, null or
repeated doc_ids and extra columns change nothing, and a column of the input that has the name of a measure is not read. An empty table
gives none. A text is measured whole, however long; its task then holds its words, lines and window hashes. Windows of three words are
told apart by 64-bit hashes: of the m windows of one text, two different ones clash with a chance of m*m/2^65.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_of

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = [
    *"the of and to in is it that was for on are with as be by this at from or an a".split(),
    *"de la le et les des du un une est que qui en dans pour par sur au".split(),
    *"der die das und ist den von zu mit sich auf nicht ein eine dem im als".split(),
    *"el los las y del se por con para su no es lo".split(),
]
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Fails a document of at least `from_words` words if 100 * measure is above (`most`) or below (`least`) the percentage of base."""

    name: str
    measure: str
    base: str
    most: int | None = None
    least: int | None = None
    from_words: int = 0

    def fails(self) -> Column:
        over = F.lit(100) * F.col(self.measure)
        bad = over > F.lit(self.most) * F.col(self.base) if self.most is not None else over < F.lit(self.least) * F.col(self.base)
        return bad & (F.col("n_words") >= self.from_words)

    def sql(self) -> str:
        bad = f"100 * {self.measure} > {self.most} * {self.base}" if self.most is not None else f"100 * {self.measure} < {self.least} * {self.base}"
        return f"({bad} AND n_words >= {self.from_words})"


#: `one` is the constant 1: 100 * n_words < 5000 means fewer than 50 words.
BASE = [Rule("too_short", "n_words", "one", least=5000), Rule("repeated_windows", "n_repeat_words", "n_words", most=50)]
METHOD = [
    Rule("symbols", "n_symbols", "word_chars", most=5),
    Rule("long_words", "word_chars", "n_words", most=2500),
    Rule("short_words", "word_chars", "n_words", least=200),
    Rule("few_stop_words", "n_stop_words", "n_words", least=5, from_words=50),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=60),
]
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id (as doc_id) and every measure."""
    df = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("_text"))
    df = df.select(
        "doc_id",
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.array_remove(F.split("_text", SPACE), "").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]"))).alias("_lines"),
    )
    df = df.select(
        "doc_id",
        "n_symbols",
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(_words) < 3 THEN array() ELSE transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) END").alias("_hashes"),
    )
    # the places, in order, of windows whose hash occurs more than once
    df = df.withColumn("_sorted", F.expr("CASE WHEN size(_hashes) > size(array_distinct(_hashes)) THEN sort_array(transform(_hashes, (h, i) -> struct(h, i))) END"))
    df = df.withColumn(
        "_places",
        F.expr("""sort_array(transform(filter(transform(_sorted, (x, k) -> struct(x.i AS i,
            (k > 0 AND x.h = get(_sorted, k - 1).h) OR coalesce(x.h = get(_sorted, k + 1).h, false) AS twice)), x -> x.twice), x -> x.i))"""),
    )
    # a place adds the words that the place before it has not covered: three at most
    repeat = F.expr("coalesce(aggregate(_places, struct(0L AS n, -3 AS last), (a, i) -> struct(a.n + least(3, i - a.last) AS n, i AS last), a -> a.n), 0L)")
    stops = F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long")
    measures = F.struct(*[m for m in MEASURES if m != "n_repeat_words"], repeat.alias("n_repeat_words"), "n_lines", stops.alias("n_stop_words"), F.lit(1).cast("long").alias("one"))
    # a generator of one row: filters on measures stay above it, else they would be rewritten in terms of the text, many times over
    return df.select("doc_id", F.inline(F.array(measures)))


def _any(rules: list[Rule]) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | r.fails()
    return out


def judge(docs: DataFrame, base: list[Rule] = BASE, method: list[Rule] = METHOD) -> DataFrame:
    """doc_id, the measures, base_failed, kept, and the names of the rules that a document fails."""
    failed = F.array_compact(F.array(*[F.when(r.fails(), r.name) for r in [*base, *method]]))
    return measured(docs).select("doc_id", *MEASURES, _any(base).alias("base_failed"), (~_any([*base, *method])).alias("kept"), "n_lines", "n_stop_words", failed.alias("failed_rules"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows that no rule fails, with all their columns. The verdict is computed beside the row, so nothing is joined."""
    names = [f"_in_{i}" for i in range(len(docs.columns))]
    row = docs.toDF(*names)  # positions, so that no column name can clash
    text = names[docs.columns.index("text")]
    packed = row.select(F.struct(*names).alias("_row"), F.col(text).alias("text"))
    verdict = measured(packed, id_column="_row").where(~_any([*BASE, *METHOD]))
    return verdict.select(*[F.col(f"doc_id.{n}").alias(c) for n, c in zip(names, docs.columns, strict=True)])


def _sql_list() -> str:
    return ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))


ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
             len(list_filter(ws, lambda x: lower(x) IN ({_sql_list()})))::BIGINT AS n_stop_words, 1 AS one
      FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {" OR ".join(r.sql() for r in BASE)} AS base_failed,
       NOT ({" OR ".join(r.sql() for r in [*BASE, *METHOD])}) AS kept
FROM m"""
