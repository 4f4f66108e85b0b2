def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "ord", "start", "end", "at"]
    assert set(e.oracle_sql()) <= set(e.queries())
