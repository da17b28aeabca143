"""Every query with SQL agrees with it; the others give rows."""

import pytest
from oracle_harness import compare, connect

from pricemill.catalog import CATALOG

@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(CATALOG.sql))
def test_agrees_with_sql(spark, con, sf_dir, name):
    assert compare(spark, con, name, CATALOG.queries[name], CATALOG.sql[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(CATALOG.queries) - set(CATALOG.sql)))
def test_gives_rows(spark, sf_dir, name):
    assert CATALOG.queries[name](spark, sf_dir).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
