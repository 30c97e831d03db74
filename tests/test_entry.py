import __spark_entry__ as entry


def test_names_agree(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["event_id", "Timestamp", "user_id"] and rows.count() == 10
