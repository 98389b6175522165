import __spark_entry__


def test_every_query_can_be_called_and_every_sql_is_text():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    assert all(callable(f) for f in queries.values())
    assert all(isinstance(s, str) for s in sql.values())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
