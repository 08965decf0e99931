"""Every registered query against its SQL, on the smallest tables."""

import pytest
from oracle_check import compare, connect

from barscope.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n != "m6_rule_importance"))
def test_query(spark, con, name):
    _, err = compare(spark, con, SF, QUERIES[name].run, QUERIES[name].sql)
    assert err is None, err


def test_entry_contract(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns == ["d", "code", "score", "j", "rank", "total"] and out.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
