import __spark_entry__ as entry


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "label", "rank"] and df.count() == 20


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
