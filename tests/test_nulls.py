"""Rows without a time or key, and null reset flags, in the ordered scans."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tankcast.operators.asof import asof_left_join
from tankcast.operators.sampling import min_interval_sample
from tankcast.operators.segmented import asof_fill, running_extremes_since_reset

BASE = dt.datetime(2024, 1, 1)
SCHEMA = "site long, id long, ts {}, v double, r boolean"


def data(seed, n=120):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 2, None]), i, rng.choice([None, *[BASE + dt.timedelta(minutes=rng.randrange(600))] * 6]),
             rng.choice([None, float(rng.randrange(50))]), rng.choice([None, False, False, True])) for i in range(n)]


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
@pytest.mark.parametrize("backward", [False, True])
def test_fill_is_alike_at_every_width(spark, kind, backward):
    df = spark.createDataFrame(data(1), SCHEMA.format(kind))
    got = [rows(asof_fill(df, ["site"], ["ts", "id"], {"f": "v"}, segment=s, inclusive=not backward, backward=backward))
           for s in (None, "10 minutes", "1 day")]
    assert len(got[0]) == 120 and got[0] == got[1] == got[2]


def test_extremes_are_alike_at_every_width(spark):
    df = spark.createDataFrame(data(2), SCHEMA.format("timestamp_ntz"))
    got = [rows(running_extremes_since_reset(df, ["site"], ["ts", "id"], "v", "r", segment=s))
           for s in (None, "10 minutes", "1 day")]
    assert len(got[0]) == 120 and got[0] == got[1] == got[2]


def test_asof_keeps_every_left_row(spark):
    left, right = data(3), [(*r[:3], r[3] if r[3] is not None else -1.0) for r in data(4, 40)]
    a = spark.createDataFrame(left, SCHEMA.format("timestamp_ntz"))
    b = spark.createDataFrame(right, "site long, wid long, ts timestamp_ntz, t double")
    got = {r.id: (r.t, r.found) for r in asof_left_join(a, b, ["site"], "ts", ["t"], "id", "wid", "found").collect()}
    for site, i, ts, *_ in left:
        before = [(x[2], x[1], x[3]) for x in right if x[0] == site and x[2] and ts and x[2] <= ts]
        assert got.pop(i) == ((max(before)[2], True) if before else (None, False))
    assert not got


def test_sampler_keeps_rows_without_a_time(spark):
    df = spark.createDataFrame(data(5), SCHEMA.format("timestamp_ntz")).select(F.coalesce("site", F.lit(0)).alias("site"),
                                                                            "id", "ts")
    got = min_interval_sample(df, ["site"], "ts", "id", "10 minutes", "1 hour")
    assert got.filter("ts is null").count() == sum(r[2] is None for r in data(5)) > 0
    assert got.filter("ts is not null").count() < df.filter("ts is not null").count()
