"""Every registered query against its SQL at the smallest scale."""

import os

import pytest
from check import compare, oracle_connection

import registry

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
registry.load_all()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, FOLDER).toPandas()
    assert len(got.columns) > 0
    if name in registry.ORACLES:
        assert compare(got, duck.execute(registry.ORACLES[name]).df()) is None
    else:
        assert len(got) > 0
