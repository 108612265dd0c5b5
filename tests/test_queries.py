"""Every query runs; those with SQL give the same rows as DuckDB."""

import pytest
from comparing import both, connect

from spanlake.oracle import ORACLES
from spanlake.queries import QUERIES


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, data, con, name):
    got, want = both(QUERIES[name](spark, data), ORACLES[name], con)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.limit(5).collect() is not None


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["entity_type", "n", "docs"]
