"""Every query with an expected result, on the smallest tables; the others must give rows."""

import pytest

from __spark_entry__ import oracle_sql, queries
from compare import difference, duck


@pytest.fixture(scope="module")
def connection(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(set(oracle_sql())))
def test_same_rows(spark, sf, connection, name):
    assert difference(queries()[name](spark, sf), connection, oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_gives_rows(spark, sf, name):
    assert queries()[name](spark, sf).count() > 0


def test_every_expected_result_has_a_query():
    assert set(oracle_sql()) <= set(queries())
