"""Every query of the subpackage on the smallest tables, against its SQL where it has one."""

import pytest
from check_oracles import compare, connect

from tallywing.llm.queries import ORACLES, QUERIES


class Checked:
    def __init__(self, name):
        self.call, self.sql = QUERIES[name], ORACLES.get(name)

    def __call__(self, spark, folder):
        return self.call(spark, folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small):
    verdict, _, rows = compare(Checked(name), spark, connect(small), small)
    assert rows > 0 and (verdict.startswith("ok") or verdict == "rows-only"), verdict


def test_entry_has_them(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
