"""Every registered query with a SQL twin gives its rows."""

import pytest

from tidemark import registry

from .oracle import connect, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, sf_dir, con, name):
    same(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name], con)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert registry.FLAGSHIP in entry.queries()
