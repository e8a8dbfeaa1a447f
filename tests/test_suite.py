"""Every query of the suite against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quillon import suite

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
PAIRS = {k: v for k, v in suite.suite().items() if v[1]}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(PAIRS))
def test_query(spark, duck, name):
    query, text = PAIRS[name]
    df, found = query(spark, DATA), duck.execute(text)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    order = [names.index(c) for c in df.columns]
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=repr) == theirs


def test_quotients_of_odd_rows(spark, tmp_path):
    odd = [None, 0.0, -0.0, 3.0, -3.0, 0.1, -0.1, 5e-324, math.inf, -math.inf, math.nan]
    lines = [(i * 100 + j, 1, x, y) for i, x in enumerate(odd) for j, y in enumerate(odd)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    query, text = PAIRS["expr_div_float"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert sorted(map(repr, map(tuple, query(spark, str(tmp_path)).collect()))) == sorted(map(repr, con.execute(text).fetchall()))
