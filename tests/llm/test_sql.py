import pytest

from fieldloom.llm import registry

from ..sqlcheck import assert_same, connection


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, con, name):
    assert_same(spark, con, registry.QUERIES[name], registry.ORACLES[name])
