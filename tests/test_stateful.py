"""Flows with timers or carried state over many micro-batches: order of arrival
within the watermark, silent keys, NaN, late rows, corrections; the topic log."""

import datetime as dt
import os
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tankcast.operators import control as C
from tankcast.operators import sensors as S
from tankcast.operators import training as M
from tankcast.streaming import stateful as SF
from tankcast.streaming import streams as ST
from tankcast.streaming import topic_log as TL
from tankcast.streaming.sources import MESSAGE_SCHEMA, WEATHER_SCHEMA, message_stream, weather_stream

T0 = dt.datetime(2024, 1, 1)
NOW = {"availableNow": True}


def at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


def arrive(spark, folder, batches, schema):
    """One file a batch, in order of arrival."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)


def rows(df, *cols):
    return Counter(str(tuple(r)) for r in df.select(*cols).collect())


def message(i, minutes, topic, payload, site=0):
    return (i, 10 + site, site, at(minutes), f"site/{topic}", payload)


def test_ticks_are_those_of_the_batch_operator(spark, scratch):
    batches = [
        [message(1, 3, "tank/temperature", "40"), message(2, 20, "tank/forecast", "61"), message(9, 7, "other", "1")],
        # older than what was seen, at a tick's instant, not a number, and NaN
        [message(3, 14, "tank/temperature", "44"), message(4, 20, "boiler/threshold/set", "43"),
         message(5, 21, "tank/temperature", "oops"), message(6, 12, "tank/forecast", "NaN", site=1)],
        [message(7, 90, "utility/threshold/set", "70")],  # a long silence
        [message(8, 85, "tank/temperature", "NaN"), message(10, 200, "tank/temperature", "50", site=1)],
        [message(11, 201, "tank/temperature", "1")],
    ]
    arrive(spark, f"{scratch}/log", batches, MESSAGE_SCHEMA)
    SF.tick_control_stream(message_stream(spark, f"{scratch}/log", max_files_per_trigger=1), f"{scratch}/out",
                           tick="1 minute", watermark="10 minutes", trigger=NOW, checkpoint=f"{scratch}/ck",
                           partitions=2).awaitTermination(300)
    log = spark.createDataFrame([m for b in batches for m in b], MESSAGE_SCHEMA)
    # one message far ahead makes the batch grid of a site go on as long as the stream's
    ahead = spark.createDataFrame([message(98, 300, "tank/forecast", None), message(99, 300, "tank/forecast", None, 1)], MESSAGE_SCHEMA)
    want = C.with_cadence(C.control_state(log.unionByName(ahead), "site", tick="1 minute")).filter(F.col("tick") < F.lit(at(191)))
    got = spark.read.parquet(f"{scratch}/out").drop("batch_id")
    assert rows(got, *sorted(got.columns)) == rows(want, *sorted(got.columns))
    assert got.filter("site_id = 0").count() == 188 and got.filter("full_status").count() == 188 // 6 + 179 // 6
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != SF.ROCKSDB  # given back


def test_weather_that_comes_after_the_reading_counts(spark, scratch):
    readings = [
        [message(1, 5, "tank/temperature", "40"), message(2, 30, "tank/temperature", "41")],
        [message(3, 28, "tank/temperature", "42"), message(4, 60, "tank/temperature", "NaN")],
        [message(5, 200, "tank/temperature", "43"), message(6, 150, "tank/temperature", "44", site=1)],
    ]
    weather = [
        [(1, 0, at(10), 1.0, 2.0, 3.0)],
        [(2, 0, at(28), 4.0, None, float("nan")), (3, 0, at(28), 5.0, 5.0, 5.0), (4, 0, at(29), None, 6.0, 6.0)],  # after reading 2
        [(5, 0, at(300), 7.0, 7.0, 7.0)],
    ]
    arrive(spark, f"{scratch}/log", readings, MESSAGE_SCHEMA)
    arrive(spark, f"{scratch}/weather", weather, WEATHER_SCHEMA)
    SF.weather_enrich_stream(
        message_stream(spark, f"{scratch}/log", max_files_per_trigger=1), weather_stream(spark, f"{scratch}/weather"),
        f"{scratch}/out", watermark="40 minutes", buckets=3, trigger=NOW, checkpoint=f"{scratch}/ck",
        partitions=2).awaitTermination(300)
    got = spark.read.parquet(f"{scratch}/out")
    cols = ["msg_id", "tank_temperature", "weather_temperature", "weather_humidity", "weather_wind", "weather_found"]
    from tankcast.operators.forecast import enrich_with_weather, tank_readings
    log = spark.createDataFrame([m for b in readings for m in b], MESSAGE_SCHEMA)
    want = enrich_with_weather(tank_readings(log, "site"), spark.createDataFrame([w for b in weather for w in b], WEATHER_SCHEMA))
    want = want.filter(F.col("ts") <= F.lit(at(160)))
    assert rows(got, *cols) == rows(want, *cols) and got.count() == 5


class Store:
    """A handle with states in memory that counts the calls of the state store."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def called(self, fn=None, *args):
        self.calls += 1
        return fn(*args) if fn else None

    def registerTimer(self, at):
        self.called(self.timers.add, at)

    def deleteTimer(self, at):
        self.called(self.timers.remove, at)

    def state(self, name, *schema):
        held, calls = {} if len(schema) == 2 else [], self.called

        class State:
            exists = lambda _: calls(lambda: bool(held))
            get = lambda _: calls(lambda: held[0] if name == "armed" else iter(list(held)))
            iterator = lambda _: calls(lambda: iter(list(held.items())))
            clear = lambda _: calls(held.clear)
            update = lambda _, v: calls(held.__setitem__, slice(None), [v])
            put = lambda _, v: calls(held.__setitem__, slice(None), v)
            appendList = lambda _, v: calls(held.extend, v)
            updateValue = lambda _, k, v: calls(held.__setitem__, k, v)
            removeKey = lambda _, k: calls(held.pop, k)
        return State()

    getListState = getMapState = getValueState = state


class Watermark:
    def __init__(self, minutes):
        self.ms = int((at(minutes) - dt.datetime(1970, 1, 1)).total_seconds() * 1000)

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_weather_state_takes_a_call_a_block(monkeypatch):
    monkeypatch.setattr(SF, "GIVEN", 1_500)  # several blocks and frames
    rng, n = np.random.default_rng(7), 5_000
    frames = []
    for lo in (0, 400):  # minutes; a later batch reaches back to what the watermark has not passed
        ts = pd.to_datetime(T0) + pd.to_timedelta(rng.integers(max(lo - 99, 0), lo + 500, 2 * n), unit="min")
        weather = np.arange(2 * n) % 2 == 0
        frames.append(pd.DataFrame({
            "weather": weather, "ts": ts, "device_id": np.where(weather, 0, rng.integers(0, 9, 2 * n) + (1 << 60)),
            "id": np.arange(2 * n) + 2 * n * len(frames), "value": np.where(weather, np.nan, rng.random(2 * n)),
            **{c: np.where(weather, rng.random(2 * n), np.nan) for c in SF.WEATHER}}))
    store, processor = Store(), SF.AsOfProcessor()
    processor.init(store)
    out = []
    for frame, passed in zip(frames, (300, 880)):
        assert not list(processor.handleInputRows((3, 1), iter([frame[:n], frame[n:], frame[:0]]), None))
        out += processor.handleExpiredTimer((3, 1), Watermark(passed), None)
    assert store.calls < 50 and len(store.timers) == 3 and max(map(len, out)) <= 1_500
    got = pd.concat(out).sort_values("msg_id").reset_index(drop=True)
    whole = pd.concat(frames)
    versions = whole[whole["weather"]].sort_values(["ts", "id"], kind="stable")
    readings = whole[~whole["weather"] & (whole["ts"] <= at(880))].drop(columns=SF.WEATHER).sort_values("ts", kind="stable")
    want = pd.merge_asof(readings, versions[["ts", *SF.WEATHER]], on="ts").sort_values("id").reset_index(drop=True)
    assert (got["site_id"] == 3).all() and got["device_id"].tolist() == want["device_id"].tolist()
    assert got["msg_id"].tolist() == want["id"].tolist() and (got["ts"] == want["ts"]).all()
    assert got["tank_temperature"].tolist() == want["value"].tolist()
    assert got["weather_found"].tolist() == want[SF.WEATHER[0]].notna().tolist()
    for c in SF.WEATHER:
        assert got[f"weather_{c}"].tolist() == want[c].fillna(0.0).tolist()
    assert len(SF._rows(processor.versions, SF.VERSION)) < n / 2  # the watermark has passed most of them


def test_sliding_state_takes_a_reading_once(spark, scratch):
    arrive(spark, f"{scratch}/log", [[message(1, 3, "tank/temperature", "40")]], MESSAGE_SCHEMA)
    q = ST.sliding_stream(message_stream(spark, f"{scratch}/log"), f"{scratch}/out", trigger=NOW, checkpoint=f"{scratch}/ck")
    q.awaitTermination(300)
    plan = q._jsq.explainInternal(False)
    assert plan.count("StateStoreSave") == 2 and plan.index("Expand") < plan.rindex("StateStoreSave")
    scan = plan.rindex("Scan")
    assert plan[plan.rindex("StateStoreSave"):scan].count("Expand") == 0  # between the scan and the first state


def value(i, minutes, v, reset=False, device=1):
    return (device, at(minutes), i, v, reset)


VALUES = "device_id long, ts timestamp_ntz, msg_id long, value double, is_reset boolean"


def values_stream(spark, scratch, batches):
    arrive(spark, f"{scratch}/log", batches, VALUES)
    return (spark.readStream.schema(VALUES).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/log")
            .withColumn("ts", F.col("ts").cast("timestamp")), spark.createDataFrame([r for b in batches for r in b], VALUES))


def test_extremes_keep_the_batch_rule_for_nan(spark, scratch):
    nan = float("nan")
    stream, whole = values_stream(spark, scratch, [
        [value(1, 0, 5.0), value(2, 1, nan), value(3, 2, 3.0), value(4, 0, None, device=2)],
        [value(5, 3, 9.0), value(6, 4, 2.0, True), value(7, 5, nan, device=2)],
        [value(8, 6, 4.0), value(9, 7, None), value(10, 8, 1.0, None), value(11, 9, 7.0, True, device=2)],
        [value(12, 9, 0.5, True), value(13, 10, 6.0, True), value(14, 11, 8.0, device=None)]])
    ST.extremes_stream(stream, f"{scratch}/out", trigger=NOW, checkpoint=f"{scratch}/ck").awaitTermination(300)
    want = S.min_max_since_reset(whole, ["device_id"], ["ts", "msg_id"], "value", "is_reset")
    cols = ["msg_id", "value", "min_since_reset", "max_since_reset", "reset_epoch"]
    assert rows(spark.read.parquet(f"{scratch}/out"), *cols) == rows(want, *cols)


def test_sample_goes_on_from_the_last_kept(spark, scratch):
    stream, _ = values_stream(spark, scratch, [
        [value(1, 0, 1.0), value(2, 9, 1.0), value(3, 11, 1.0)], [value(4, 20, 1.0), value(5, 21, 1.0), value(6, None, 1.0)],
        [value(7, 5, 1.0), value(8, 22, 1.0), value(9, 40, 1.0), value(10, 3, 1.0, device=2)]])
    ST.sample_stream(stream.drop("is_reset"), f"{scratch}/out", "10 minutes", trigger=NOW,
                     checkpoint=f"{scratch}/ck").awaitTermination(300)
    # 20 and 21 are not more than ten minutes after 11; 5 is late; 22 is due
    assert rows(spark.read.parquet(f"{scratch}/out"), "msg_id") == Counter(f"({i},)" for i in (1, 3, 6, 8, 9, 10))


def test_late_rows_are_counted(spark, scratch):
    stream, whole = values_stream(spark, scratch, [
        [value(1, 0, 1.0), value(2, 100, 1.0)], [value(3, 95, 1.0), value(4, 90, 1.0), value(5, None, 1.0), value(6, 300, 1.0)],
        [value(7, 289, 1.0), value(8, 291, 1.0)]])
    ST.late_rows_stream(stream, f"{scratch}/out", "10 minutes", trigger=NOW, checkpoint=f"{scratch}/ck").awaitTermination(300)
    kept, late = (spark.read.parquet(f"{scratch}/out/{n}") for n in ("kept", "late"))
    assert rows(late, "msg_id") == Counter(["(4,)", "(7,)"]) and kept.count() + late.count() == whole.count()
    assert rows(spark.read.parquet(f"{scratch}/out/counts"), "batch_id", "n_kept", "n_late") == Counter(
        ["(0, 2, 0)", "(1, 3, 1)", "(2, 1, 1)"])


def test_changelog_restates_until_the_watermark(spark, scratch):
    order = np.random.default_rng(5).permutation(120)
    all_rows = [value(int(i), int(i), float(i * 7 % 4), device=1 + int(i) % 3) for i in range(120)] + [value(200, 50, None)]
    batches = [[all_rows[i] for i in sorted(order[lo:lo + 12])] for lo in range(0, 120, 12)] + [[all_rows[-1]]]
    stream, whole = values_stream(spark, scratch, batches)
    ST.change_log_stream(stream.drop("is_reset"), f"{scratch}/out", watermark="3 hours", trigger=NOW,
                         checkpoint=f"{scratch}/ck").awaitTermination(600)
    want = S.change_only(whole.filter("value is not null").drop("is_reset"), ["device_id"], ["ts", "msg_id"], "value")
    log = spark.read.parquet(f"{scratch}/out/changes")
    cols = ["device_id", "msg_id", "value", "previous_value"]
    net = log.groupBy(*cols).agg(F.sum("op").alias("op")).filter("op != 0")
    assert rows(net, *cols) == rows(want, *cols) and net.filter("op != 1").isEmpty()
    assert not log.filter("op = -1").isEmpty() and spark.read.parquet(f"{scratch}/out/late").isEmpty()


def test_changelog_state_is_bounded_by_the_watermark(spark, scratch):
    batches = [[value(100 * b + i, 60 * b + i, float(i)) for i in range(50)] for b in range(4)]
    batches.append([value(999, 10, 5.0)])  # behind the watermark
    stream, whole = values_stream(spark, scratch, batches)
    ST.change_log_stream(stream.drop("is_reset"), f"{scratch}/out", watermark="20 minutes", trigger=NOW,
                         checkpoint=f"{scratch}/ck").awaitTermination(600)
    for k in (0, 1):
        assert spark.read.parquet(f"{scratch}/ck/carried/batch_id={k}").count() <= 21
    assert rows(spark.read.parquet(f"{scratch}/out/late"), "msg_id") == Counter(["(999,)"])
    want = S.change_only(whole.filter("msg_id != 999").drop("is_reset"), ["device_id"], ["ts", "msg_id"], "value")
    assert rows(spark.read.parquet(f"{scratch}/out/changes").filter("op = 1"), "msg_id") == rows(want, "msg_id")


def test_training_hands_on_bounded_state(spark, scratch):
    batches = [[message(10 * b + k, 30 * b + k, "tank/temperature", str(20 + (b * 7 + k) % 30)) for k in range(3)] for b in range(16)]
    arrive(spark, f"{scratch}/log", batches, MESSAGE_SCHEMA)
    weather = spark.createDataFrame([(1, 0, T0, 5.0, 3.0, 7.0)], WEATHER_SCHEMA)
    scale = (50.0, 10.0, 10.0, 10.0)
    ST.training_stream(message_stream(spark, f"{scratch}/log", max_files_per_trigger=1), weather, f"{scratch}/out",
                       scale=scale, trigger=NOW, checkpoint=f"{scratch}/ck").awaitTermination(600)
    for k in (0, 1):
        assert spark.read.parquet(f"{scratch}/ck/panes/batch_id={k}").count() <= 6
        assert spark.read.parquet(f"{scratch}/ck/models/batch_id={k}").count() == 1
    from tankcast.operators.forecast import tank_readings
    log = spark.createDataFrame([m for b in batches for m in b], MESSAGE_SCHEMA)
    pairs = M.training_pairs(tank_readings(log, "site"), weather)
    want = M.train_weights(M.train_statistics(pairs, ["site_id"], scale=scale), ["site_id"], scale=scale)
    got = spark.read.parquet(f"{scratch}/out/models").drop("batch_id")
    assert got.count() >= 8
    assert rows(got, *sorted(got.columns)) == rows(want.join(got.select("version_ts"), "version_ts", "left_semi"), *sorted(got.columns))


# --- the seven-feature model ------------------------------------------------------------

def test_documented_model_matches_mllib(spark):
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.regression import LabeledPoint, LinearRegressionWithSGD
    rng = np.random.default_rng(2)
    x, y = rng.random((20, 7)), rng.random(20)
    pairs = spark.createDataFrame([(0, T0, *map(float, r), float(v)) for r, v in zip(x, y)],
                                  "site_id int, label_pane timestamp_ntz, " + ", ".join(f"{c} double" for c in M.DOCUMENTED)
                                  + ", label double")
    stats = M.train_statistics(pairs, ["site_id"], scale=None, features=M.DOCUMENTED)
    got = M.train_weights(stats, ["site_id"], initial=M.DOCUMENTED_WEIGHTS, scale=None).first()
    points = spark.sparkContext.parallelize([LabeledPoint(v, Vectors.dense(r)) for r, v in zip(x, y)], 1)
    want = LinearRegressionWithSGD.train(points, iterations=50, step=0.1, miniBatchFraction=1.0,
                                         initialWeights=Vectors.dense(M.DOCUMENTED_WEIGHTS), convergenceTol=0.001)
    assert np.allclose([got[n] for n in M.WEIGHTS], want.weights.toArray(), atol=1e-9)


def test_a_fold_in_two_parts_is_the_fold(spark):
    rng = np.random.default_rng(3)
    pairs = spark.createDataFrame([(0, at(30 * k), *map(float, rng.random(4) * 300), float(rng.random() * 100)) for k in range(20)],
                                  "site_id int, label_pane timestamp_ntz, " + ", ".join(f"{c} double" for c in M.FEATURES)
                                  + ", label double")
    scale = (500.0, 500.0, 300.0, 310.0)
    stats = M.train_statistics(pairs, ["site_id"], scale=scale)
    whole = M.train_weights(stats, ["site_id"], scale=scale)
    first = M.train_weights(stats.filter(F.col("batch") < F.lit(at(300))), ["site_id"], scale=scale, with_state=True)
    last = first.orderBy(F.col("version_ts").desc()).limit(1)
    rest = M.train_weights(stats.filter(F.col("batch") >= F.lit(at(300))), ["site_id"], scale=scale, start=last)
    both = first.drop("state").unionByName(rest)
    assert rows(both, *sorted(both.columns)) == rows(whole, *sorted(both.columns))


# --- the topic log -----------------------------------------------------------------------

LOG = "topic string, payload string, ts timestamp_ntz"


def publish(spark, scratch, batch, mode="append", name="log"):
    spark.createDataFrame(batch, LOG).coalesce(2).write.mode("append").parquet(f"{scratch}/in-{name}")
    src = spark.readStream.schema(LOG).parquet(f"{scratch}/in-{name}")
    TL.write_topic_log(src, f"{scratch}/{name}", f"{scratch}/ck-{name}", NOW, mode).awaitTermination(300)


def payloads(spark, scratch, topics=None, name="log"):
    return sorted(r.payload for r in TL.read_topic_log(spark, f"{scratch}/{name}", LOG, topics).collect())


def test_topic_log_epochs_topics_and_snapshots(spark, scratch):
    assert payloads(spark, scratch) == []
    for k in range(TL.COMPACT + 2):
        publish(spark, scratch, [(f"a/{k % 2}", f"{k:02d}", T0), ("b", "x", T0), (None, "none", None)])
    log = TL.Log(f"{scratch}/log")
    assert [n.endswith(TL.SNAPSHOT) for n in log.names()] == [True, False, False]
    assert payloads(spark, scratch, ["a/1"]) == ["01", "03", "05", "07", "09", "11"]
    assert len(payloads(spark, scratch)) == 3 * (TL.COMPACT + 2)
    # a subscription opens its topics' files only
    for e in log.committed()[1]:
        if e.topic == "b":
            os.remove(f"{scratch}/log/{e.file}")
    assert payloads(spark, scratch, ["a/0", "a/1"]) == [f"{k:02d}" for k in range(TL.COMPACT + 2)]


def test_topic_log_stream_goes_on_behind_its_offsets(spark, scratch):
    def consume():
        src = TL.read_topic_log(spark, f"{scratch}/log", LOG, ["a", "c"], stream=True)
        (src.writeStream.foreachBatch(lambda df, i: df.write.mode("append").parquet(f"{scratch}/out"))
         .option("checkpointLocation", f"{scratch}/ck").trigger(**NOW).start().awaitTermination(300))
        return sorted(r.payload for r in spark.read.schema(LOG).parquet(f"{scratch}/out").collect())

    publish(spark, scratch, [("a", "1", T0), ("b", "2", T0)])
    assert consume() == ["1"]
    publish(spark, scratch, [("b", "3", T0)])
    publish(spark, scratch, [("a", "4", T0), ("c", "5", T0)])
    assert consume() == ["1", "4", "5"]


def test_a_failed_task_leaves_nothing_visible(spark, scratch):
    publish(spark, scratch, [("a", "1", T0)])
    spark.createDataFrame([("a", str(k), T0) for k in range(2000)], LOG).coalesce(1).write.parquet(f"{scratch}/in-bad")
    src = spark.readStream.schema(LOG).parquet(f"{scratch}/in-bad")
    # the last rows of the micro-batch fail, when others are written
    failing = src.withColumn("payload", F.when(F.col("payload") == "1999", F.raise_error(F.lit("killed"))).otherwise(F.col("payload")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        q = TL.write_topic_log(failing, f"{scratch}/log", f"{scratch}/ck-bad", NOW)
        with pytest.raises(Exception, match="killed"):
            q.awaitTermination(300)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert payloads(spark, scratch) == ["1"]


def test_a_replayed_epoch_is_committed_once(scratch):
    log = TL.Log(f"{scratch}/log")
    assert log.commit(0, [("a", "data/x", 1)], False) and not log.commit(0, [("a", "data/y", 1)], False)
    assert [e.file for e in log.committed()[1]] == ["data/x"]
    assert log.commit(1, [("a", "data/z", 1)], True)  # replaces
    assert [(e.epoch, e.file) for e in log.committed()[1]] == [(1, "data/z")]


def test_a_reader_sees_old_or_new(scratch, monkeypatch):
    """A snapshot made between listing and reading does not disturb a reader."""
    log = TL.Log(f"{scratch}/log")
    for k in range(4):
        log.commit(k, [("a", f"data/{k}", 1)], False)
    load, done = log.load, []

    def slow(name):
        if not done:
            done.append(name)
            TL.Log(f"{scratch}/log").compact()
        return load(name)

    monkeypatch.setattr(log, "load", slow)
    assert [e.file for e in log.committed()[1]] == [f"data/{k}" for k in range(4)]


def test_complete_mode_replaces(spark, scratch):
    for k in range(2):
        spark.createDataFrame([("a", str(k), T0)], LOG).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
        src = spark.readStream.schema(LOG).parquet(f"{scratch}/in").groupBy("topic").agg(
            F.max("payload").alias("payload"), F.max("ts").alias("ts"))
        TL.write_topic_log(src, f"{scratch}/log", f"{scratch}/ck", NOW, "complete").awaitTermination(300)
        assert payloads(spark, scratch) == [str(k)]
