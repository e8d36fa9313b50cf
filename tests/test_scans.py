"""Segmented scans and the sampler against brute force on random series,
including hot keys that span many segments and shuffled input order."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tankcast.operators.sampling import _compose, greedy_reference, min_interval_sample
from tankcast.operators.segmented import asof_fill, running_extremes_since_reset

T0 = dt.datetime(2024, 1, 1)


def series(seed, n=400, keys=3, span_s=5 * 3600):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = 0 if rnd.random() < 0.6 else rnd.randrange(1, keys)   # key 0 is hot
        ts = T0 + dt.timedelta(seconds=rnd.randrange(span_s))
        v = None if rnd.random() < 0.3 else float(rnd.randrange(100))
        rows.append((i, k, ts, v, rnd.random() < 0.05))
    return rows


SCHEMA = "id long, k int, ts timestamp_ntz, v double, r boolean"


def test_asof_fill_equals_whole_key_window(spark):
    df = spark.createDataFrame(series(1), SCHEMA).repartition(5)
    mine = asof_fill(df, ["k"], ["ts", "id"], {"f": "v"}, segment="20 minutes")
    w = Window.partitionBy("k").orderBy("ts", "id")
    ref = df.withColumn("f", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted(map(tuple, mine.select("id", "f").collect())) == \
        sorted(map(tuple, ref.select("id", "f").collect()))


def test_asof_fill_exclusive_and_backward(spark):
    df = spark.createDataFrame(series(2), SCHEMA)
    w = Window.partitionBy("k").orderBy("ts", "id")
    prev = asof_fill(df, ["k"], ["ts", "id"], {"f": "v"}, segment="30 minutes", inclusive=False)
    ref = df.withColumn("f", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    assert sorted(map(tuple, prev.select("id", "f").collect())) == \
        sorted(map(tuple, ref.select("id", "f").collect()))
    nxt = asof_fill(df, ["k"], ["ts", "id"], {"f": "v"}, segment="30 minutes",
                    inclusive=False, backward=True)
    ref2 = df.withColumn("f", F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    assert sorted(map(tuple, nxt.select("id", "f").collect())) == \
        sorted(map(tuple, ref2.select("id", "f").collect()))


def test_running_extremes_equal_whole_key_window(spark):
    rows = [(i, k, ts, v if v is not None else 1.0, r) for i, k, ts, v, r in series(3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    mine = running_extremes_since_reset(df, ["k"], ["ts", "id"], "v", "r", segment="15 minutes")
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    e = df.withColumn("ep", F.sum(F.col("r").cast("int")).over(w))
    w2 = Window.partitionBy("k", "ep").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    ref = e.select("id", F.min("v").over(w2).alias("mn"), F.max("v").over(w2).alias("mx"),
                   F.col("ep").cast("bigint").alias("ep"))
    a = sorted(map(tuple, mine.select("id", "min_since_reset", "max_since_reset", "reset_epoch").collect()))
    b = sorted(map(tuple, ref.collect()))
    assert a == b


def test_min_interval_sample_matches_greedy(spark):
    rnd = random.Random(7)
    rows, i = [], 0
    for dev in range(3):
        t = 0.0
        for _ in range(300 if dev == 0 else 60):
            t += rnd.choice([0.5, 1.0, 2.6, 4.9, 5.0, 5.001, 7.0, 30.0])
            rows.append((i, dev, T0 + dt.timedelta(seconds=round(t, 3))))
            i += 1
    df = spark.createDataFrame(rows, "id long, dev int, ts timestamp_ntz").repartition(4)
    got = min_interval_sample(df, ["dev"], "ts", "id", "5 seconds", segment="1 minute")
    got_ids = sorted(r.id for r in got.collect())
    pdf = pd.DataFrame(rows, columns=["id", "dev", "ts"]).sort_values(["dev", "ts", "id"])
    want = []
    for _, g in pdf.groupby("dev"):
        us = (g["ts"].astype("datetime64[us]").astype("int64")).tolist()
        want += g["id"].iloc[greedy_reference(us, 5_000_000)].tolist()
    assert got_ids == sorted(want)


@pytest.mark.parametrize("fan", [1, 2, 3, 50])
def test_sampler_by_blocks_of_any_size(spark, fan):
    # a segment as long as the interval: whole segments are blocked, entries go through maps
    rnd = random.Random(fan)
    rows, i = [], 0
    for dev in range(3):
        t = 0.0
        for _ in range(200 if dev == 0 else 40):
            t += rnd.choice([0.0, 0.5, 2.5, 4.9, 5.0, 5.001, 12.0, 61.0])
            rows.append((i, dev, T0 + dt.timedelta(seconds=round(t, 3))))
            i += 1
    df = spark.createDataFrame(rows, "id long, dev int, ts timestamp_ntz").repartition(4)
    for segment in ("5 seconds", "15 seconds"):
        got = min_interval_sample(df, ["dev"], "ts", "id", "5 seconds", segment, fan)
        want = []
        for d in range(3):
            mine = [r for r in rows if r[1] == d]
            us = pd.Series([r[2] for r in mine]).astype("datetime64[us]").astype("int64").tolist()
            want += [mine[k][0] for k in greedy_reference(us, 5_000_000)]
        assert sorted(r.id for r in got.collect()) == sorted(want)


def test_composed_maps_equal_a_fold_over_their_parts():
    # 60 segments of 1 to 6 rows: the map of a block gives what its segments give one after another
    rnd, iv, span = random.Random(3), 5, 7
    frames, times = [], []
    for seg in range(60):
        t = sorted(rnd.sample(range(seg * span, (seg + 1) * span), rnd.randint(1, 6)))
        times.append(t)
        heads = [x for x in t if x <= seg * span + iv]

        def exit_of(rows):
            kept = greedy_reference(rows, iv)
            return rows[kept[-1]] if kept else None

        exits = [exit_of(t[p:]) for p in range(len(heads) + 1)]
        frames.append(pd.DataFrame({"dev": 1, "block": 0, "seg": seg, "head_ts": pd.array([*heads, None], dtype="Int64"),
                                    "exit_ts": pd.array(exits, dtype="Int64"), "pos": range(len(exits))}))
    whole = pd.concat(frames, ignore_index=True)
    batches = [whole.iloc[i:i + 5] for i in range(0, len(whole), 5)]
    block = pd.concat(_compose(batches, ["dev", "block", "seg"], ["dev", "block"], iv))
    assert len(block) == len(frames[0])  # as many pieces as the first segment has
    for entry in (None, *range(-span, 0)):
        blocked = 0 if entry is None else int((block["head_ts"].dropna() <= entry + iv).sum())
        flat = [x for t in times for x in t]
        kept = greedy_reference(flat, iv, entry)
        assert block["exit_ts"].iloc[blocked] == flat[kept[-1]]


def test_min_interval_fixture(spark):
    secs = [0, 4, 5, 5.001, 9, 10.5]
    df = spark.createDataFrame([(i, 1, T0 + dt.timedelta(seconds=s)) for i, s in enumerate(secs)],
                               "id long, dev int, ts timestamp_ntz")
    got = sorted(r.id for r in min_interval_sample(df, ["dev"], "ts", "id", "5 seconds").collect())
    assert [secs[i] for i in got] == [0, 5.001, 10.5]


def test_sampler_across_small_arrow_batches(spark):
    # groups and segments cut by Arrow batch boundaries are carried correctly
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rnd = random.Random(11)
        rows, i = [], 0
        for dev in range(2):
            t = 0.0
            for _ in range(150):
                t += rnd.choice([0.4, 1.1, 2.6, 5.0, 5.2, 9.0])
                rows.append((i, dev, T0 + dt.timedelta(seconds=round(t, 3))))
                i += 1
        df = spark.createDataFrame(rows, "id long, dev int, ts timestamp_ntz")
        got = sorted(r.id for r in min_interval_sample(df, ["dev"], "ts", "id", "5 seconds",
                                                       segment="20 seconds").collect())
        pdf = pd.DataFrame(rows, columns=["id", "dev", "ts"]).sort_values(["dev", "ts", "id"])
        want = []
        for _, g in pdf.groupby("dev"):
            us = g["ts"].astype("datetime64[us]").astype("int64").tolist()
            want += g["id"].iloc[greedy_reference(us, 5_000_000)].tolist()
        assert got == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hot_key_is_spread_over_tasks(spark):
    # one key holds 90% of the rows; the segmented scan must not put it in one task
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rnd = random.Random(5)
        rows = [(i, 0 if rnd.random() < 0.9 else rnd.randrange(1, 4),
                 T0 + dt.timedelta(seconds=rnd.randrange(48 * 3600)), float(i)) for i in range(4000)]
        df = spark.createDataFrame(rows, "id long, k int, ts timestamp_ntz, v double")
        out = asof_fill(df, ["k"], ["ts", "id"], {"f": "v"}, segment="1 hour")
        sizes = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
        biggest = max(r["count"] for r in sizes) / 4000
        assert len(sizes) >= 3 and biggest < 0.6, sizes
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_plain_window_option_equals_segmented(spark):
    rows = [(i, k, ts, v if v is not None else 2.0, r) for i, k, ts, v, r in series(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    for inclusive, backward in [(True, False), (False, False), (False, True)]:
        a = asof_fill(df, ["k"], ["ts", "id"], {"f": "v"}, segment=None, inclusive=inclusive, backward=backward)
        b = asof_fill(df, ["k"], ["ts", "id"], {"f": "v"}, segment="30 minutes", inclusive=inclusive,
                      backward=backward)
        assert sorted(map(tuple, a.select("id", "f").collect())) == sorted(map(tuple, b.select("id", "f").collect()))
    cols = ["id", "min_since_reset", "max_since_reset", "reset_epoch"]
    a = running_extremes_since_reset(df, ["k"], ["ts", "id"], "v", "r", segment=None)
    b = running_extremes_since_reset(df, ["k"], ["ts", "id"], "v", "r", segment="30 minutes")
    assert sorted(map(tuple, a.select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect()))


def test_suggest_segment(spark):
    from tankcast.operators.segmented import suggest_segment
    # key 0: one row per second for an hour; key 1: sparse
    rows = [(0, T0 + dt.timedelta(seconds=s)) for s in range(3600)] + \
           [(1, T0 + dt.timedelta(hours=h)) for h in range(5)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz")
    assert suggest_segment(df, ["k"], "ts", target_rows=100) == "1 minute"
    assert suggest_segment(df, ["k"], "ts", target_rows=10**9) == "1 day"
