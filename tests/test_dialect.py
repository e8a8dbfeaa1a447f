"""Parsing, naming and lowering of the dialect on small tables."""

import math

import pytest

from quillon.engine import plan_of, run_select
from quillon.errors import EngineError, ParseError, ResolutionError, TypeMismatch
from quillon.functions.expressions import parse_expr
from quillon.plans import sql
from quillon.plans.lexer import statements
from quillon.plans.query import QueryPlan


@pytest.fixture(scope="module")
def tables(spark):
    frames = {
        "rivers": spark.createDataFrame([(1, "Aare", "Gorge", 3.5), (2, "Drau", "Delta", 2.5), (3, "Enns", "Gorge", -2.5)], "rid int, name string, land string, flow float"),
        "gauges": spark.createDataFrame([(1, 10), (1, 11), (3, 10)], "rid int, gid int"),
        "longs": spark.createDataFrame([(1,), (3,)], "rid long"),
        "flags": spark.createDataFrame([(True, 7), (False, 0), (True, -7)], "b boolean, n int"),
    }
    return lambda name: frames[name.lower()]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_default_names_have_no_white_space(tables):
    df = run_select("SELECT rid + 1, COUNT( * ), UPPER(land) FROM rivers GROUP BY rid, land", tables)
    assert df.columns == ["rid+1", "COUNT(*)", "UPPER(land)"]


def test_stars(tables):
    assert run_select("SELECT * FROM rivers AS s", tables).columns == ["rid", "name", "land", "flow"]
    both = run_select("SELECT sid2, * FROM rivers AS s JOIN gauges AS e ON s.rid = e.rid".replace("sid2, ", ""), tables)
    assert both.columns == ["s.rid", "s.name", "s.land", "s.flow", "e.rid", "e.gid"]
    assert run_select("SELECT e.*, s.name FROM rivers AS s JOIN gauges AS e ON e.rid = s.rid", tables).columns == ["e.rid", "e.gid", "s.name"]
    with pytest.raises(ResolutionError):
        run_select("SELECT x.* FROM rivers", tables)


def test_repeated_output_names(tables):
    found = run_select("SELECT n AS b, *, b FROM flags WHERE n > 0", tables)
    assert found.columns == ["b", "b", "n", "b"] and rows(found) == [(7, True, 7, True)]


def test_where_takes_any_boolean(tables):
    assert rows(run_select("SELECT rid FROM rivers WHERE 3 <= rid OR name = 'Aare' AND flow > 3", tables)) == [(1,), (3,)]
    assert rows(run_select("SELECT rid FROM rivers WHERE rid = 1.0", tables)) == [(1,)]
    with pytest.raises(TypeMismatch):
        run_select("SELECT rid FROM rivers WHERE name = 1", tables)


def test_names_are_case_insensitive_and_ambiguity_is_an_error(tables):
    assert rows(run_select("SELECT S.RID FROM Rivers AS s WHERE RID < 2", tables)) == [(1,)]
    with pytest.raises(ResolutionError, match="ambiguous"):
        run_select("SELECT rid FROM rivers AS a JOIN rivers AS b ON a.rid = b.rid", tables)
    with pytest.raises(ResolutionError, match="unknown"):
        run_select("SELECT nope FROM rivers", tables)


def test_whole_and_float_division(tables):
    df = run_select("SELECT n / 2, n % 2, 7.0 / n, ROUND(n / 2.0) FROM flags WHERE n <> 0", tables)
    assert rows(df) == [(-3, -1, -1.0, -3), (3, 1, 1.0, 4)]
    assert [f.dataType.simpleString() for f in df.schema] == ["int", "int", "double", "bigint"]
    found = run_select("SELECT 1.0 / n AS a, -1.0 / n AS b, 0.0 / n AS c FROM flags WHERE n = 0", tables).first()
    assert found.a == math.inf and found.b == -math.inf and math.isnan(found.c)


def test_division_of_and_by_null(spark):
    odd = [(1.0, None), (-1.0, None), (0.0, None), (math.nan, None), (None, None), (None, 0.0), (None, 2.0)]
    frame = spark.createDataFrame(odd, "x double, y double")
    assert rows(run_select("SELECT x / y AS q FROM odd", lambda _: frame)) == [(None,)] * len(odd)


def test_booleans_count_as_numbers(tables):
    assert rows(run_select("SELECT SUM(b) AS s, SUM(b + n) AS t FROM flags", tables)) == [(2, 2)]
    assert rows(run_select("SELECT n FROM flags WHERE n AND b", tables)) == [(-7,), (7,)]


def test_aggregates(tables):
    df = run_select("SELECT land, COUNT(*) AS n, RANGE(rid) AS r, VARIANCE(rid) AS v, STDDEV(rid) AS d, AVG(flow) AS a FROM rivers GROUP BY land", tables)
    assert rows(df) == [("Delta", 1, 0, 0.0, 0.0, 2.5), ("Gorge", 2, 2, 2.0, math.sqrt(2), 0.5)]
    assert rows(run_select("SELECT SUM(rid) / COUNT(*) + 1 AS x FROM rivers", tables)) == [(3,)]


def test_first_last_and_groups_without_aggregates(tables):
    plan = QueryPlan(tables).start("rivers").group_by("land").project("FIRST(name)", "LAST(name)").ordered_by("rid")
    assert rows(plan.to_df()) == [("Aare", "Enns"), ("Drau", "Drau")]
    plan = QueryPlan(tables).start("rivers").group_by("land").project("land", "name").ordered_by("rid")
    assert rows(plan.to_df()) == [("Delta", "Drau"), ("Gorge", "Aare")]
    assert run_select("SELECT RANDOM(rid) AS x FROM rivers", tables).first().x in (1, 2, 3)


def test_global_aggregate_over_nothing(tables):
    assert rows(run_select("SELECT COUNT(*) AS n FROM rivers WHERE rid > 9", tables)) == [(0,)]
    plan = QueryPlan(tables, empty_aggregate="none").start("rivers").where("rid", ">", 9).project("COUNT(*)")
    assert rows(plan.to_df()) == []


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("SELECT name, COUNT(*) FROM rivers GROUP BY land", EngineError),
        ("SELECT SUM(COUNT(*)) FROM rivers", ParseError),
        ("SELECT COUNT(rid, name) FROM rivers", ParseError),
        ("SELECT SUM(name) FROM rivers", TypeMismatch),
        ("SELECT RANGE(b) FROM flags", TypeMismatch),
        ("SELECT name + 1 FROM rivers", TypeMismatch),
        ("SELECT UPPER(rid) FROM rivers", TypeMismatch),
        ("SELECT ROUND(name) FROM rivers", TypeMismatch),
        ("SELECT REPLACE(name, 'a', 1) FROM rivers", TypeMismatch),
        ("SELECT NOPE(rid) FROM rivers", ParseError),
        ("SELECT rid FROM", ParseError),
        ("SELECT rid FROM rivers WHERE COUNT(*) > 1", EngineError),
        ("WITH a(x, y) AS (SELECT rid FROM rivers) SELECT x FROM a", EngineError),
        ("WITH a AS (SELECT rid FROM rivers), a AS (SELECT rid FROM rivers) SELECT rid FROM a", EngineError),
        ("SELECT s.rid FROM rivers AS s JOIN gauges AS s ON s.rid = s.rid", ResolutionError),
        ("SELECT s.rid FROM rivers AS s JOIN gauges AS e ON rid = gid", ResolutionError),
        ("SELECT s.rid FROM rivers AS s JOIN gauges AS e ON s.rid = s.flow", ResolutionError),
        ("SELECT rid FROM rivers ORDER BY name", ResolutionError),
    ],
)
def test_errors(tables, text, error):
    with pytest.raises(error):
        run_select(text, tables).collect()


@pytest.mark.parametrize("strategy", [None, "snlj", "pnlj", "bnlj", "sortmerge", "shj", "ghj"])
def test_join_strategies_agree(tables, strategy):
    plan = QueryPlan(tables).start("rivers", "s").join("gauges", "e.rid", "s.rid", "e", strategy).join("longs", "s.rid", "l.rid", "l", strategy)
    assert rows(plan.project("s.rid", "e.gid", "l.rid").to_df()) == [(1, 10, 1), (1, 11, 1), (3, 10, 3)]


def test_order_limit_offset(tables):
    assert [r[0] for r in run_select("SELECT rid AS x FROM rivers ORDER BY x DESC LIMIT 1 OFFSET 1", tables).collect()] == [2]
    assert QueryPlan(tables).start("rivers").sort("flow").limit(-1).to_df().first().rid == 3


def test_common_tables(tables):
    text = "WITH a(k) AS (SELECT rid FROM rivers WHERE rid > 1), b AS (SELECT k + 1 AS k2 FROM a) SELECT COUNT(*) AS n, MAX(k2) AS m FROM b"
    assert rows(run_select(text, tables)) == [(2, 4)]


def test_literals_and_strings(tables):
    found = run_select("SELECT 'it''s' AS a, '' AS b, 1E2 AS c, 5000000000 AS d, TRUE AS e, -3 AS f FROM rivers LIMIT 1", tables)
    assert tuple(found.first()) == ("it's", "", 100.0, 5000000000, True, -3)
    assert statements("SELECT ';' FROM a;; SELECT 2 FROM b ;") == ["SELECT ';' FROM a", "SELECT 2 FROM b"]


def test_precedence():
    assert parse_expr("1 + 2 * 3 > 6 AND NOPE OR x") == parse_expr("(((1 + (2 * 3)) > 6) AND NOPE) OR x")


def test_plan_text_round_trips(tables):
    plan = plan_of(sql.parse("SELECT s.name AS n, COUNT(*) AS c FROM rivers AS s JOIN gauges AS e ON s.rid = e.rid WHERE s.rid > 0 GROUP BY s.name ORDER BY n LIMIT 5"), tables)
    assert rows(run_select(plan.to_sql(), tables)) == rows(plan.to_df()) == [("Aare", 2), ("Enns", 1)]
    shape = plan.explain()
    assert shape.startswith("Limit 5") and "Group By" in shape and "Seq Scan on rivers" in shape and "JOIN on s.rid=e.rid" in shape


def test_filters_reach_the_parquet_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id AS k", "id * 2 AS v", "id * 3 AS w").write.parquet(path)
    plan = QueryPlan(lambda _: spark.read.parquet(path)).start("t").where("k", ">=", 90).project("v")
    text = plan.explain(physical=True)
    assert "GreaterThanOrEqual(k,90)" in text and "struct<k:bigint,v:bigint>" in text


def _stats(tables, names):
    from quillon import stats

    found = {n: stats.analyze(tables(n)) for n in names}
    return lambda n: found.get(n.lower())


def test_joins_are_put_in_order_by_statistics(spark):
    """A chain written from its largest table on begins with the small one that a predicate leaves little of."""
    frames = {
        "big": spark.range(5000).selectExpr("id % 1000 AS m", "id AS b"),
        "middle": spark.range(1000).selectExpr("id AS m", "id % 50 AS s", "concat('n', id % 3) AS t"),
        "small": spark.range(50).selectExpr("id AS s", "id * 2 AS v"),
    }
    text = "SELECT * FROM big AS b JOIN middle AS m ON b.m = m.m JOIN small AS s ON m.s = s.s WHERE s.v = 10"
    plan = plan_of(sql.parse(text), frames.__getitem__, _stats(frames.__getitem__, frames))
    plain = run_select(text, frames.__getitem__)
    assert plan.to_df().columns == plain.columns and rows(plan.to_df()) == rows(plain) and plan.to_df().count() == 100
    lines = [x.strip("\t-> ") for x in plan.explain().split("\n")]
    scans = [x.split(" on ")[1].split(" ")[0] for x in lines if x.startswith("Seq Scan")]
    assert scans[:2] == ["small", "middle"] and scans[2] == "big" or scans[0] == "middle" and scans[1] == "small"
    assert "Seq Scan on small (rows=1, cost=50)" in plan.explain() and "JOIN on " in plan.explain()
    by_scan = plan_of(sql.parse("SELECT b.b AS x FROM big AS b JOIN middle AS m ON b.m = m.m LIMIT 3"), frames.__getitem__, _stats(frames.__getitem__, frames))
    assert by_scan.explain().index("big") < by_scan.explain().index("middle")
    alone = plan_of(sql.parse(text), frames.__getitem__)
    assert "rows=" not in alone.explain()


def test_indices_are_picked_by_cost(spark):
    frame = spark.range(2000).selectExpr("cast(id AS int) AS k", "cast(id % 5 AS int) AS g")
    tables, found = (lambda _: frame), _stats(lambda _: frame, ["t"])

    def shape(where):
        plan = plan_of(sql.parse(f"SELECT k FROM t WHERE {where}"), tables, found, lambda _: {"k", "g"})
        assert rows(plan.to_df()) == rows(run_select(f"SELECT k FROM t WHERE {where}", tables))
        return plan.explain()

    assert "Index Scan for k=7 on t (rows=1, cost=12)" in shape("k = 7")
    assert "Index Scan for k<20 on t" in shape("g < 4 AND 20 > k")
    assert "Index Scan for k<-5 on t" in shape("k < -5")
    assert "Seq Scan on t" in shape("k <> 7") and "Seq Scan on t" in shape("k >= 0")


def test_hash_joins_have_a_bound(tables, monkeypatch):
    from quillon.operators import joins

    monkeypatch.setattr(joins, "HASH_BYTES", 0)
    plan = QueryPlan(tables).start("rivers", "s").join("gauges", "e.rid", "s.rid", "e", "ghj").project("s.rid")
    assert "SortMergeJoin" in plan.explain(physical=True) and rows(plan.to_df()) == [(1,), (1,), (3,)]
