from __future__ import annotations

import __spark_entry__ as contract


def test_entry_is_the_flagship(spark):
    df = contract.entry(spark)
    assert df.columns == ["item_a", "item_b", "weight"]
    assert df.count() == 10


def test_queries_and_sql_share_keys():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 150
