"""Every registered query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import pytest
from compare import compare, connect

from kinloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    same, _, why = compare(spark, duck, catalog.queries()[name], catalog.oracle_sql()[name], SF)
    assert same, why


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
