"""Every query with an oracle against DuckDB, and the others for their rows, at the smallest scale."""

import pytest

from tidemark.plans import registry

from . import oracle


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_oracle(spark, small, con, name):
    oracle.assert_equal(registry.QUERIES[name](spark, small), con, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_oracle_has_rows(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_oracles_belong_to_queries():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and registry.FLAGSHIP in registry.QUERIES
