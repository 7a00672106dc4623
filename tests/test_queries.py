"""Every query over the whole tables at the smallest scale, against its SQL."""

import os

import pytest

from lumitide import queries as core

from .compare import connect, difference

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, con, name):
    df = core.queries()[name](spark, SF)
    sql = core.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    assert difference(df, con, sql) is None
