import __spark_entry__ as entry


def test_every_oracle_has_a_query(spark):
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.entry(spark).columns == ["n_name", "cnt", "qty"]
