"""The driver contract: entry() runs, every query runs on sf0.001, oracle keys
are a subset of the query keys, and oracle SQL runs in DuckDB."""

import datetime as dt
import os
from collections import Counter
from decimal import Decimal

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as E
from tankcast.plans.oracle import SQL

QUERIES = E.QUERIES
SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"device_id", "forecast", "weather_found"} <= set(df.columns)


def test_oracle_keys_subset():
    assert set(E.oracle_sql()) <= set(E.queries())
    # every telemetry query has SQL with the same meaning (the SGD fold too,
    # as a recursive CTE)
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle_small(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{os.path.join(SF, 'events.parquet')}')")
    want = con.execute(SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert len(got) == len(want)
    assert values(got[cols]) == values(want[cols])


def values(df: pd.DataFrame) -> Counter:
    """Rows as printed values: numbers to nine digits, nulls and booleans evened out."""
    def even(v):
        if isinstance(v, (bytes, bytearray)):
            return bytes(v).hex()
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return None
        if isinstance(v, (bool, int, float, Decimal, np.number, np.bool_)):
            return f"{float(v):.9g}"
        return str(pd.Timestamp(v)) if isinstance(v, (dt.datetime, np.datetime64)) else str(v)

    return Counter(tuple(map(even, r)) for r in df.astype(object).values.tolist())
