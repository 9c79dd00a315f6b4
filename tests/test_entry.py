def test_entry_and_names(spark):
    import __spark_entry__ as e

    queries, oracles = e.queries(), e.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 90
    df = e.entry(spark)
    assert df.columns[0] == "feature" and df.count() >= 0
