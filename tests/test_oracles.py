"""Every query with SQL gives the rows of its SQL."""

import pytest

from weftnet.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(name, same):
    same(catalog.queries()[name], catalog.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
