"""Every chain query against its SQL."""

import pytest

from ledgerloom.plans.catalog import ORACLE_SQL, QUERIES
from oracle import assert_same, connect


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    assert_same(QUERIES[name](spark, sf), con, ORACLE_SQL[name])
