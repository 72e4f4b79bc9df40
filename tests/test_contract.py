import __spark_entry__ as entry_mod


def test_oracle_keys_are_queries():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 80


def test_entry_runs_on_smallest_tables(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns[0] == "cluster" and df.columns[-1] == "n_samples"
