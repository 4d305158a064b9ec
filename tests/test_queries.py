"""Every registered query of the core, held against its SQL or run to its end."""

from __future__ import annotations

import pytest
from conftest import SF
from oracle import connect, same

from foliant.plans import catalogue


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_sql(spark, con, name):
    same(catalogue.QUERIES[name](spark, SF), con, catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_without_sql(spark, name):
    found = catalogue.QUERIES[name](spark, SF).count()
    assert (found == 0) == (name == "html_table_markdown")  # the pages of the test data hold no table


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
