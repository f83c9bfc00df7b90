"""Every registered query runs, those without an SQL equivalent too, and gives the columns that it names."""

import pytest

import __spark_entry__ as contract

REST = sorted(n for n, q in contract.queries().items() if n not in contract.oracle_sql() and ".llm." not in q.__module__)


@pytest.mark.parametrize("name", REST)
def test_query_without_sql_runs(spark, sf, name):
    df = contract.queries()[name](spark, sf)
    rows = df.collect()
    assert df.columns and len(set(df.columns)) == len(df.columns)
    assert all(len(r) == len(df.columns) for r in rows)
