"""Every registered query against its SQL, or at least for rows, on the smallest data."""

import __spark_entry__ as entry
import pytest
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("key", list(entry.queries()))
def test_query(spark, duck, key):
    df = entry.queries()[key](spark, FOLDER)
    sql = entry.oracle_sql().get(key)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, duck, sql) is None


def test_entry(spark):
    assert entry.entry(spark).count() == spark.read.parquet(f"{FOLDER}/events.parquet").count()
