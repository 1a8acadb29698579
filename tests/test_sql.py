import pytest

from fieldloom.plans import catalog

from .sqlcheck import assert_same, connection


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, con, name):
    assert_same(spark, con, catalog.QUERIES[name], catalog.ORACLES[name])


def test_every_sql_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and catalog.FLAGSHIP in catalog.QUERIES
