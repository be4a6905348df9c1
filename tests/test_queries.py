"""Every registered query of the library against its SQL."""

import pytest
from oracle import connection, rows

from loamgraph.plans import load

REGISTRY = load()


@pytest.fixture(scope="module")
def duck(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(REGISTRY.QUERIES))
def test_query(spark, data, duck, name):
    got = REGISTRY.QUERIES[name](spark, data).toPandas()
    if name not in REGISTRY.ORACLES:
        assert len(got.columns)
        return
    want = duck.sql(REGISTRY.ORACLES[name]).to_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
