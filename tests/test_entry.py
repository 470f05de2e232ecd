import __spark_entry__ as entry


def test_registry_is_complete():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 60


def test_flagship(spark):
    rows = entry.entry(spark)
    assert {"agent_type", "model", "estimated_cost_usd"} <= set(rows.columns)
    assert rows.count() > 0
