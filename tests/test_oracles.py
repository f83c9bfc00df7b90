"""Every query with an SQL equivalent against DuckDB."""

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = "region nation customer supplier part orders lineitem events documents embeddings security_events cloud_audit stix_objects observed_data sightings stix_reports identities risk_incidents doc_labels pack_budgets".split()
ORACLES = contract.oracle_sql()


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (int, bool)):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [normal(v) for v in value]
    return value if value is None else str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, duck, name):
    df = contract.queries()[name](spark, sf)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    want = rows(columns, result.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want)
    assert got == want
    if os.environ.get("WANT_ROWS"):
        assert want, "no rows"
