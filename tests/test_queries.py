"""Every ledger query gives the rows of its SQL."""

import pytest

from blockloom.plans.registry import ORACLES, QUERIES

from .compare import connect, rows, sql_rows
from .conftest import SF


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert df.count() > 0
        return
    names, want = sql_rows(con, ORACLES[name])
    assert sorted(df.columns) == names
    assert rows(df) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
