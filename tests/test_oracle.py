"""Every registered query beside its DuckDB SQL."""

import pytest

from engram.queries import ORACLE, QUERIES

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE:
        assert compare(df, con, ORACLE[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLE) <= set(QUERIES) <= set(__spark_entry__.queries())
