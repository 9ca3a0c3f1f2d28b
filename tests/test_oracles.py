"""Every query with SQL against DuckDB, every other one for rows, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracles import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    text, _, ok = compare(spark, con, SF, name)
    assert ok, text
    assert "WIDE" not in text, text


def test_oracles_have_queries():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0
    assert df.columns == ["lang", "is_toxic", "n", "mean_log_length", "mean_lysine"]
