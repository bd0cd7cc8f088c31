"""Each registered query beside its oracle SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import difference, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_matches_oracle(spark, con, name):
    frame = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert frame.count() > 0
    else:
        assert difference(frame, con, sql) is None


def test_entry_is_lazy_and_has_rows(spark):
    assert entry.entry(spark).columns == [
        "region", "mes", "pedidos", "receita", "ticket_medio", "pct_cancelado", "pct_app",
    ]


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
