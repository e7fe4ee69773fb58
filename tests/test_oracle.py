"""Every registered query of this package's catalog against its SQL."""

import pytest

import __spark_entry__ as e
from sparkroster.catalog import REGISTRY
from tests.oracle import connect, differences

SF_DIR = "/root/testdata/sf0.001"
SQL = e.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    df = e.queries()[name](spark, SF_DIR)
    if name in SQL:
        assert differences(df, con, SQL[name]) == []
    else:
        assert df.count() > 0


def test_entry_has_rows_and_stable_columns(spark):
    df = e.entry(spark)
    assert df.columns == [
        "project_id",
        "project_display_name",
        "environment_count",
        "environment_names",
    ]
    assert df.count() > 0


def test_every_query_has_sql():
    assert set(REGISTRY) <= set(SQL)
    assert set(SQL) <= set(e.queries())
