"""Every registered query against its DuckDB text at the smallest scale."""

import pytest

from panelspark.plans import catalog
from tests.compare import compare, duck
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    diff, n, _, _ = compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLES.get(name), SF)
    assert diff == ""
    if name not in catalog.ORACLES:
        assert n > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
