"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ours = QUERIES[name](spark, SF).toArrow()
    if name in ORACLES:
        assert difference(ours, duck.execute(ORACLES[name]).to_arrow_table()) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["artist", "minutes"]


def test_checks_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
