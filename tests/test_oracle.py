"""Every registered query against its DuckDB SQL on the smallest driver tables."""

import datetime as dt
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from faultbench.plans.queries import QUERIES as OWN
from faultbench.sources.tables import TABLES
from tests.conftest import SF_SMALL

QUERIES = dict(OWN)
SQL = entry.oracle_sql()


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, decimal.Decimal):
        return str(int(v)) if v == v.to_integral_value() else repr(float(v))
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables missing")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, srows) == _rows(ocols, orows)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "coverage_pct" in df.columns
