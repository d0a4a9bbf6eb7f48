"""Every registered query against its SQL on the smallest tables; those without SQL must return rows."""

import pytest
from check_oracles import compare, connect

from tallywing.plans.catalog import load

CATALOG = load()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(name, spark, con, small):
    verdict, _, rows = compare(CATALOG[name], spark, con, small)
    assert verdict in ("ok", "rows-only"), verdict
    assert rows > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 7
    assert set(entry.oracle_sql()) <= set(entry.queries())
