"""The driver contract: entry runs, every query has SQL unless listed as rows-only."""
import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["sample_id", "batch_id", "inputs", "target"]
    rows = df.orderBy("sample_id").limit(3).collect()
    assert rows and all(len(r["inputs"]) == 35 and r["inputs"][1:] == r["target"][:-1] for r in rows)


def test_registry_consistent():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert set(E.catalog.QUERIES) - set(s) == set(E.ROWS_ONLY)
    for name, sql in s.items():
        assert "LIMIT" not in sql or name == "take_documents", name
