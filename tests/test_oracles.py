"""Every query with SQL must equal it, on the smallest tables."""

from __future__ import annotations

import pytest

from conftest import FOLDER
from tablewright.catalog import ORACLES, QUERIES
from tools.check import table


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(spark, duck, key):
    df = QUERIES[key](spark, FOLDER)
    names, mine = table([tuple(r) for r in df.collect()], df.columns)
    cursor = duck.execute(ORACLES[key])
    their_names, theirs = table(cursor.fetchall(), [d[0] for d in cursor.description])
    assert names == their_names
    assert mine == theirs


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
