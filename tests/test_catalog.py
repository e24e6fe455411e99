"""Each query against its SQL; those without SQL run and return rows."""

import pytest

from oracle import compare, connect
from sparkloom import catalog, catalog_loads, catalog_more, catalog_text  # noqa: F401  (the others register their queries in the first)


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, sf_dir, name):
    if name in catalog.ORACLES:
        compare(spark, con, sf_dir, catalog.QUERIES[name], catalog.ORACLES[name])
    else:
        assert catalog.QUERIES[name](spark, sf_dir).count() > 0
