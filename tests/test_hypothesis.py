"""Property tests with generated series: the segmented scans equal a plain
whole-key window for any segment width, and the sampler never keeps two rows
within the interval and skips a row only when one was kept within it."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tankcast.operators.sampling import min_interval_sample
from tankcast.operators.segmented import asof_fill

T0 = dt.datetime(2024, 1, 1)

rows_st = st.lists(
    st.tuples(st.integers(0, 2), st.integers(0, 20_000), st.one_of(st.none(), st.integers(0, 50))),
    min_size=1, max_size=60)
segment_st = st.sampled_from(["1 minute", "7 minutes", "1 hour", "1 day", None])

SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(rows=rows_st, segment=segment_st)
def test_asof_fill_any_segment(spark, rows, segment):
    data = [(i, k, T0 + dt.timedelta(seconds=s), None if v is None else float(v))
            for i, (k, s, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, k int, ts timestamp_ntz, v double")
    got = asof_fill(df, ["k"], ["ts", "id"], {"f": "v"}, segment=segment)
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("f", F.last("v", True).over(w))
    assert sorted(map(tuple, got.select("id", "f").collect())) == \
        sorted(map(tuple, ref.select("id", "f").collect()))


@SETTINGS
@given(secs=st.lists(st.integers(0, 3_000), min_size=1, max_size=80),
       segment=st.sampled_from(["10 seconds", "1 minute", "1 hour"]))
def test_sampler_properties(spark, secs, segment):
    data = [(i, 1, T0 + dt.timedelta(seconds=s / 10)) for i, s in enumerate(secs)]
    df = spark.createDataFrame(data, "id long, dev int, ts timestamp_ntz")
    kept = {r.id for r in min_interval_sample(df, ["dev"], "ts", "id", "5 seconds", segment).collect()}
    order = sorted(data, key=lambda r: (r[2], r[0]))
    last = None
    for i, _, ts in order:
        if last is None or (ts - last).total_seconds() > 5:
            assert i in kept
            last = ts
        else:
            assert i not in kept


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 1), st.integers(0, 20_000), st.integers(0, 50), st.booleans()),
                     min_size=1, max_size=60),
       segment=segment_st)
def test_running_extremes_any_segment(spark, rows, segment):
    from tankcast.operators.segmented import running_extremes_since_reset
    data = [(i, k, T0 + dt.timedelta(seconds=s), float(v), r) for i, (k, s, v, r) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, k int, ts timestamp_ntz, v double, r boolean")
    got = running_extremes_since_reset(df, ["k"], ["ts", "id"], "v", "r", segment=segment)
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    e = df.withColumn("ep", F.sum(F.col("r").cast("int")).over(w))
    w2 = Window.partitionBy("k", "ep").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    ref = e.select("id", F.min("v").over(w2), F.max("v").over(w2), F.col("ep").cast("bigint"))
    assert sorted(map(tuple, got.select("id", "min_since_reset", "max_since_reset", "reset_epoch").collect())) == \
        sorted(map(tuple, ref.collect()))


@SETTINGS
@given(rows=rows_st, segment=segment_st)
def test_next_value_any_segment(spark, rows, segment):
    data = [(i, k, T0 + dt.timedelta(seconds=s), None if v is None else float(v))
            for i, (k, s, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, k int, ts timestamp_ntz, v double")
    got = asof_fill(df, ["k"], ["ts", "id"], {"f": "v"}, segment=segment, inclusive=False, backward=True)
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(1, Window.unboundedFollowing)
    ref = df.withColumn("f", F.first("v", True).over(w))
    assert sorted(map(tuple, got.select("id", "f").collect())) == \
        sorted(map(tuple, ref.select("id", "f").collect()))
