"""Driver contract: entry smoke, registry/oracle consistency, and every
SQL-backed query against DuckDB at sf0.001."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402

ROWS_ONLY = {"gbt_forecast", "rf_forecast", "ridge_forecast", "gbt_eval", "rf_eval", "ridge_eval",
             }


def _base_sql():
    from hazecast.plans.oracle import SQL
    return SQL


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "AQI" in df.columns and "date" in df.columns


def test_every_query_has_oracle_or_is_rows_only():
    from hazecast.plans.oracle import SQL as sql
    from hazecast.plans.queries import QUERIES as qs
    assert set(qs) <= set(E.queries()) and set(sql) <= set(E.oracle_sql())
    assert set(sql) <= set(qs)
    assert set(qs) - set(sql) == ROWS_ONLY


@pytest.fixture(scope="module")
def duck(sf_small):
    import duckdb
    from oracle_check import TABLES
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_small}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(_base_sql()))
def test_query_matches_oracle(spark, duck, sf_small, name):
    from oracle_check import compare
    sdf = E.queries()[name](spark, sf_small).toPandas()
    ddf = duck.execute(E.oracle_sql()[name]).fetchdf()
    r = compare(sdf, ddf)
    assert r["cols"], r
    assert r["rows"][0] == r["rows"][1], r
    assert r["hash"], r
