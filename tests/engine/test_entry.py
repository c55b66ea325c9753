import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(o) > 100
