"""Every registered graph query against its SQL on the smallest tables."""

import pytest
from compare import spark_rows, sql_rows

from tieweave.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, data, name):
    assert spark_rows(catalog.QUERIES[name](spark, data)) == sql_rows(catalog.SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_sql_belongs_to_queries():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
