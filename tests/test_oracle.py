"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry
from oracle_queries import ORACLE
from tests.compare import connect, difference
from tidemart.plans.registry import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, sf, con):
    assert difference(QUERIES[name](spark, sf), con, ORACLE[name]) is None


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["year", "month", "revenue", "order_count"]
    assert df.count() == 80
