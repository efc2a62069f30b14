"""Every registered query against its SQL on the smallest generated tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    if name in entry.oracle_sql():
        ok, message = compare(df, con, entry.oracle_sql()[name])
        assert ok, message
    else:
        assert df.count() > 0
