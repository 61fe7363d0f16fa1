"""The driver's entry points."""

import os

import pytest

import __spark_entry__ as entry


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="tables are not here")
def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "unit_id", "source", "rank"] and df.count() == 200
