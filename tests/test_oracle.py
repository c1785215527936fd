"""Every core query against its SQL on the smallest tables."""

import pytest

from brindle.plans import aggregates, core, documents, events, streams, writes  # noqa: F401

from .conftest import rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    columns, rows = rows_of(core.QUERIES[name](spark, sf))
    assert (columns, rows) == rows_of_sql(duck, core.SQL[name])


#: Queries whose point is that nothing is found.
EMPTY = {"where_never", "is_one_of_empty"}


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_queries_that_find_nothing_are_meant_to(sf, duck, name):
    """A green row of no rows says nothing."""
    rows = duck.execute(core.SQL[name]).fetchall()
    assert bool(rows) == (name not in EMPTY)


def test_every_core_query_has_sql():
    assert set(core.QUERIES) == set(core.SQL)


def test_entry_lists_all(spark):
    import __spark_entry__

    assert set(core.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["c_mktsegment", "n_orders", "total", "average"]
