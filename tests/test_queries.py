"""Every registered query against its SQL check."""

import pytest
from compare import check_rows, connect, spark_rows

from lakekeep.plans.catalog import CHECKS, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_a_check():
    assert set(CHECKS) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns, want = check_rows(con, CHECKS[name])
    assert sorted(df.columns) == columns
    assert spark_rows(df) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(CHECKS) <= set(entry.oracle_sql()) <= set(entry.queries())
