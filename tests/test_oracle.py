"""Every query that has SQL, against another engine on the same files."""

import pytest

from checks.compare import compare, connect
from checks.oracle import oracle_sql
from checks.queries import queries


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_same_rows(spark, sf, con, name):
    assert compare(queries()[name](spark, sf), con, oracle_sql()[name]) is None


def test_flagship_entry(spark):
    from __spark_entry__ import entry

    rows = entry(spark).collect()
    assert [r["Total_Loans"] for r in rows] == [773, 220, 182, 155, 138]
    assert [r["Default_Count"] for r in rows] == [99, 32, 14, 20, 7]
