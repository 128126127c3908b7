import __spark_entry__ as entry


def test_names_and_sql():
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names)
    assert "p2_found" in names and len(sql) >= 90


def test_flagship(spark, sf):
    assert entry.entry(spark).count() > 0
