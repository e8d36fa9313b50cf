"""Streams equal their batch twins; a stopped and restarted stream loses and
duplicates nothing (T1-T6)."""

import datetime as dt
import os
import time

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tankcast.operators import control as C
from tankcast.operators import sensors as S
from tankcast.operators import training as M
from tankcast.plans.forecast import forecast
from tankcast.sources.fixtures import load_messages, load_weather
from tankcast.streaming import streams as ST
from tankcast.streaming.sources import message_stream

SF = "/root/testdata/sf0.001"
SENTINEL_TS = dt.datetime(2030, 1, 1)
AVAILABLE_NOW = {"availableNow": True}


def write_log(spark, folder, parts=6, sentinel=True, only=None):
    """The messages view of sf0.001 split by time into ``parts`` files (in
    time order), plus a far-future reading that moves the watermark past
    every real window."""
    pdf = load_messages(spark, SF).toPandas().sort_values(["ts", "msg_id"])
    chunks = [pdf.iloc[i * len(pdf) // parts:(i + 1) * len(pdf) // parts] for i in range(parts)]
    if sentinel:
        s = pdf.iloc[:1].copy()
        s["msg_id"], s["ts"], s["topic"], s["payload"] = 10**12, SENTINEL_TS, "site/tank/temperature", "1"
        chunks.append(s)
    os.makedirs(folder, exist_ok=True)
    for i, c in enumerate(chunks):
        if only is not None and i not in only:
            continue
        t = pa.Table.from_pandas(c.reset_index(drop=True), preserve_index=False)
        t = t.cast(pa.schema([("msg_id", pa.int64()), ("device_id", pa.int64()), ("site_id", pa.int32()),
                              ("ts", pa.timestamp("us")), ("topic", pa.string()), ("payload", pa.string())]))
        path = os.path.join(folder, f"part-{i:03d}.parquet")
        pq.write_table(t, path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


def rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_forecast_stream_equals_batch(spark, scratch):
    log, out = f"{scratch}/log", f"{scratch}/out"
    write_log(spark, log)
    q = ST.forecast_stream(message_stream(spark, log, max_files_per_trigger=2),
                           load_weather(spark, SF), out, trigger=AVAILABLE_NOW,
                           checkpoint=f"{scratch}/ckpt")
    q.awaitTermination(300)
    got = spark.read.parquet(f"{out}/forecast").filter(F.col("ts") < F.lit(SENTINEL_TS))
    want = forecast(load_messages(spark, SF), load_weather(spark, SF))
    cols = ["device_id", "window_start", "msg_id", "weather_temperature", "forecast"]
    assert rows(got, cols) == rows(want, cols)
    pub = spark.read.parquet(f"{out}/publish")
    assert pub.filter(F.col("topic") != "site/tank/forecast").count() == 0
    # the sentinel's own window never becomes final, so it is not emitted
    assert pub.count() == got.count()


def test_forecast_stream_restart_no_loss_no_duplicates(spark, scratch):
    log, out, ck = f"{scratch}/log", f"{scratch}/out", f"{scratch}/ckpt"
    write_log(spark, log, only={0, 1, 2})
    q = ST.forecast_stream(message_stream(spark, log, max_files_per_trigger=1),
                           load_weather(spark, SF), out, trigger=AVAILABLE_NOW, checkpoint=ck)
    q.awaitTermination(300)
    write_log(spark, log, only={3, 4, 5, 6})
    q = ST.forecast_stream(message_stream(spark, log, max_files_per_trigger=1),
                           load_weather(spark, SF), out, trigger=AVAILABLE_NOW, checkpoint=ck)
    q.awaitTermination(300)
    got = spark.read.parquet(f"{out}/forecast").filter(F.col("ts") < F.lit(SENTINEL_TS))
    want = forecast(load_messages(spark, SF), load_weather(spark, SF))
    cols = ["device_id", "window_start", "msg_id", "forecast"]
    assert rows(got, cols) == rows(want, cols)


def test_control_stream_equals_batch(spark, scratch):
    log, out = f"{scratch}/log", f"{scratch}/out"
    write_log(spark, log, sentinel=False)
    q = ST.control_stream(message_stream(spark, log, max_files_per_trigger=2), out,
                          trigger=AVAILABLE_NOW, checkpoint=f"{scratch}/ckpt")
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    want = C.control_on_messages(load_messages(spark, SF), "site")
    cols = ["site_id", "msg_id", "tank_temperature", "tank_forecast", "boiler_threshold",
            "utility_threshold", "boiler_enabled", "utility_enabled", "utility_pin"]
    assert rows(got, cols) == rows(want, cols)


def test_change_stream_equals_batch(spark, scratch):
    log, out = f"{scratch}/log", f"{scratch}/out"
    write_log(spark, log, sentinel=False)
    vals = (message_stream(spark, log, max_files_per_trigger=2)
            .select("device_id", "ts", "msg_id",
                    F.floor(F.col("payload").try_cast("double") / 50).cast("double").alias("value")))
    q = ST.change_stream(vals, out, trigger=AVAILABLE_NOW, checkpoint=f"{scratch}/ckpt")
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    b = (load_messages(spark, SF)
         .select("device_id", "ts", "msg_id",
                 F.floor(F.col("payload").try_cast("double") / 50).cast("double").alias("value")))
    want = S.change_only(b, ["device_id"], ["ts", "msg_id"], "value")
    assert rows(got, ["device_id", "msg_id", "previous_value"]) == \
        rows(want, ["device_id", "msg_id", "previous_value"])


def test_training_stream_equals_batch(spark, scratch):
    log, out = f"{scratch}/log", f"{scratch}/out"
    write_log(spark, log)
    weather = load_weather(spark, SF)
    scale = (500.0, 500.0, 100.0, 10.0)
    q = ST.training_stream(message_stream(spark, log, max_files_per_trigger=1), weather, out,
                           scale=scale, trigger=AVAILABLE_NOW, checkpoint=f"{scratch}/ckpt")
    q.awaitTermination(600)
    got = spark.read.parquet(f"{out}/models")
    from tankcast.operators.forecast import tank_readings
    pairs = M.training_pairs(tank_readings(load_messages(spark, SF), "site"), weather)
    want = M.train_weights(M.train_statistics(pairs, ["site_id"], scale=scale), ["site_id"], scale=scale)
    a = {(r.site_id, r.version_ts): (r.w_tank, r.w_temp) for r in got.collect()}
    b = {(r.site_id, r.version_ts): (r.w_tank, r.w_temp) for r in want.collect()}
    assert a.keys() == b.keys() and len(a) > 0
    for k in a:
        assert abs(a[k][0] - b[k][0]) < 1e-9 and abs(a[k][1] - b[k][1]) < 1e-9
    assert time is not None


def test_quarantine_stream(spark, scratch):
    log, out = f"{scratch}/log", f"{scratch}/out"
    os.makedirs(log)
    t = pa.table({"msg_id": pa.array([1, 2, 3], pa.int64()), "device_id": pa.array([7, 7, 7], pa.int64()),
                  "site_id": pa.array([0, 0, 0], pa.int32()),
                  "ts": pa.array([dt.datetime(2024, 1, 1)] * 3, pa.timestamp("us")),
                  "topic": ["site/tank/temperature"] * 3, "payload": ["45.5", "abc", ""]})
    pq.write_table(t, f"{log}/a.parquet")
    q = ST.quarantine_stream(message_stream(spark, log), out, trigger=AVAILABLE_NOW,
                             checkpoint=f"{scratch}/ckpt")
    q.awaitTermination(120)
    assert sorted(r.msg_id for r in spark.read.parquet(out).collect()) == [2, 3]


def test_route_fanout(spark, scratch):
    from tankcast.operators.topics import route
    from tankcast.streaming.sinks import write_routes
    routed = route(load_messages(spark, SF), "site")
    write_routes(routed, f"{scratch}/routes")
    back = spark.read.parquet(f"{scratch}/routes")
    assert back.count() == routed.count()
    assert back.filter(F.col("__route") == "tank_forecast").count() == \
        routed.filter(F.col("route") == "tank/forecast").count()


def test_kafka_records_map_to_messages(spark):
    from tankcast.streaming.sources import from_kafka
    rec = spark.createDataFrame(
        [(bytearray(b"7"), bytearray(b"21.5"), "site/tank/temperature", 2, 15, dt.datetime(2024, 1, 1))],
        "key binary, value binary, topic string, partition int, offset long, timestamp timestamp")
    m = from_kafka(rec, F.col("key_text").try_cast("bigint"), F.lit(0)).first()
    assert (m.device_id, m.payload, m.topic) == (7, "21.5", "site/tank/temperature")
    assert m.msg_id == 2 * (1 << 40) + 15


def test_forecast_stream_with_trained_models(spark, scratch):
    log, out = f"{scratch}/log", f"{scratch}/out"
    write_log(spark, log)
    weather = load_weather(spark, SF)
    q = ST.training_stream(message_stream(spark, log, max_files_per_trigger=3), weather,
                           f"{scratch}/train", scale=(500.0, 500.0, 100.0, 10.0),
                           trigger=AVAILABLE_NOW, checkpoint=f"{scratch}/ck1")
    q.awaitTermination(600)
    q = ST.forecast_stream(message_stream(spark, log, max_files_per_trigger=3), weather, out,
                           trigger=AVAILABLE_NOW, checkpoint=f"{scratch}/ck2",
                           models_path=f"{scratch}/train/models")
    q.awaitTermination(600)
    got = spark.read.parquet(f"{out}/forecast")
    assert got.filter(F.col("model_version_ts").isNotNull()).count() > 0
    assert got.filter(F.col("ts") < F.lit(SENTINEL_TS)).count() == \
        forecast(load_messages(spark, SF), weather).count()


def test_forecast_stream_reads_new_models_only(spark, scratch):
    # versions of 12 batches arrive between the micro-batches; the folders read before are then spoilt
    log, out, models = f"{scratch}/log", f"{scratch}/out", f"{scratch}/models"
    weather = load_weather(spark, SF)
    msgs = load_messages(spark, SF)
    sites = [r.site_id for r in msgs.select("site_id").distinct().collect()]
    lo, hi = msgs.agg(F.min("ts"), F.max("ts")).first()
    versions = []

    def train(batches):
        for n in batches:
            new = [(s, lo + (hi - lo) * n / 12 + dt.timedelta(seconds=s % 7), 1.0 + n, 0.1 * n, 0.0, float(s % 3), 0.5, n)
                   for s in sites if (s + n) % 3]
            versions.extend(new)
            ddl = ("site_id int, version_ts timestamp_ntz, w_tank double, w_temp double, w_hum double, "
                   "w_wind double, intercept double, n long")
            spark.createDataFrame(new, ddl).coalesce(1).write.parquet(f"{models}/batch_id={n}")

    def run(parts):
        write_log(spark, log, only=parts)
        ST.forecast_stream(message_stream(spark, log, max_files_per_trigger=1), weather, out, trigger=AVAILABLE_NOW,
                           checkpoint=f"{scratch}/ck", models_path=models).awaitTermination(600)

    def scored():
        return {r.msg_id: r for r in spark.read.parquet(f"{out}/forecast").collect()}

    run({0})  # no models yet
    none = set(scored())
    train(range(0, 7))
    run({1, 2, 3})
    first = set(scored()) - none
    for n in range(0, 6):  # all but the newest that was read
        for name in os.listdir(f"{models}/batch_id={n}"):
            if name.endswith(".parquet"):
                with open(f"{models}/batch_id={n}/{name}", "wb") as f:
                    f.write(b"spoilt")
    train(range(7, 12))
    run({4, 5, 6})
    got = scored()
    assert len(got) == forecast(msgs, weather).count() and none and first
    late = 0
    for i, r in got.items():
        there = [v for v in versions if i not in none and (v[-1] < 7 or i not in first)]
        at = max((v for v in there if v[0] == r.site_id and v[1] <= r.window_end), key=lambda v: v[1], default=None)
        assert r.model_version_ts == (at and at[1])
        if at is None:
            continue
        late += at[-1] >= 7
        assert abs(r.forecast - (at[2] * r.tank_temperature + at[3] * r.weather_temperature + at[5] * r.weather_wind + 0.5)) < 1e-9
    assert late > 0
    # versions that no later window can need are not handed on
    held = [spark.read.parquet(f"{scratch}/ck/versions/batch_id={b}").count() for b in (0, 1)]
    assert min(held) < len(versions) / 2


def test_sliding_stream_equals_batch(spark, scratch):
    from tankcast.operators.forecast import tank_readings
    from tankcast.operators.windows import sliding_first_last
    log, out = f"{scratch}/log", f"{scratch}/out"
    write_log(spark, log)
    q = ST.sliding_stream(message_stream(spark, log, max_files_per_trigger=2), out,
                          trigger=AVAILABLE_NOW, checkpoint=f"{scratch}/ckpt")
    q.awaitTermination(300)
    got = spark.read.parquet(out).filter(F.col("newest_ts") < F.lit(SENTINEL_TS))
    want = sliding_first_last(tank_readings(load_messages(spark, SF), "site"), ["site_id"], "ts",
                              "msg_id", "tank_temperature")
    cols = ["site_id", "window_start", "n", "newest_id", "oldest_id"]
    assert rows(got, cols) == rows(want, cols)


def test_history_stream_final_snapshot_equals_batch(spark, scratch):
    from pyspark.sql import Window
    from tankcast.operators.views import history_window
    log, out = f"{scratch}/log", f"{scratch}/out"
    write_log(spark, log, sentinel=False)
    q = ST.history_stream(message_stream(spark, log, max_files_per_trigger=2), out, 100, "48 hours",
                          trigger=AVAILABLE_NOW, checkpoint=f"{scratch}/ckpt")
    q.awaitTermination(300)
    snaps = spark.read.parquet(out)
    last = snaps.withColumn("mb", F.max("batch_id").over(Window.partitionBy("site_id", "topic"))) \
                .filter(F.col("batch_id") == F.col("mb"))
    v = load_messages(spark, SF).select("site_id", "topic", "ts", "msg_id",
                                        F.col("payload").try_cast("double").alias("value"))
    want = history_window(v.filter(F.col("value").isNotNull()), ["site_id", "topic"], "ts", "msg_id",
                          100, "48 hours")
    cols = ["site_id", "topic", "msg_id", "point_rank"]
    assert rows(last, cols) == rows(want, cols)


def test_latest_stream_equals_batch(spark, scratch):
    from pyspark.sql import Window
    from tankcast.operators.windows import latest_per_key
    log, out = f"{scratch}/log", f"{scratch}/out"
    write_log(spark, log, sentinel=False)
    q = ST.latest_stream(message_stream(spark, log, max_files_per_trigger=2), out,
                         trigger=AVAILABLE_NOW, checkpoint=f"{scratch}/ckpt")
    q.awaitTermination(300)
    ups = spark.read.parquet(out)
    last = ups.withColumn("mb", F.max("batch_id").over(Window.partitionBy("site_id", "topic"))) \
              .filter(F.col("batch_id") == F.col("mb"))
    want = latest_per_key(load_messages(spark, SF), ["site_id", "topic"], "ts", "msg_id", ["payload"])
    cols = ["site_id", "topic", "msg_id", "payload", "n_messages"]
    assert rows(last, cols) == rows(want, cols)


def _values(df):
    return df.select("device_id", "ts", "msg_id", F.col("payload").try_cast("double").alias("value"),
                     (F.col("msg_id") % 100 == 0).alias("is_reset")).filter(F.col("value").isNotNull())


def test_extremes_stream_equals_batch(spark, scratch):
    log, out = f"{scratch}/log", f"{scratch}/out"
    write_log(spark, log, sentinel=False)
    q = ST.extremes_stream(_values(message_stream(spark, log, max_files_per_trigger=2)), out,
                           trigger=AVAILABLE_NOW, checkpoint=f"{scratch}/ckpt")
    q.awaitTermination(300)
    want = S.min_max_since_reset(_values(load_messages(spark, SF)), ["device_id"], ["ts", "msg_id"],
                                 "value", "is_reset")
    cols = ["msg_id", "min_since_reset", "max_since_reset", "reset_epoch"]
    assert rows(spark.read.parquet(out), cols) == rows(want, cols)


def test_sample_stream_equals_batch(spark, scratch):
    from tankcast.operators.sampling import min_interval_sample
    log, out = f"{scratch}/log", f"{scratch}/out"
    write_log(spark, log, sentinel=False)
    src = _values(message_stream(spark, log, max_files_per_trigger=2)).drop("is_reset")
    q = ST.sample_stream(src, out, "2 hours", trigger=AVAILABLE_NOW, checkpoint=f"{scratch}/ckpt")
    q.awaitTermination(300)
    want = min_interval_sample(_values(load_messages(spark, SF)).drop("is_reset"), ["device_id"], "ts",
                               "msg_id", "2 hours", "6 hours")
    assert rows(spark.read.parquet(out), ["msg_id"]) == rows(want, ["msg_id"])


def test_control_and_change_streams_keep_the_batch_rules(spark, scratch):
    """Payloads that only one parser reads, NaN and nulls, in several batches."""
    sent = [("tank/temperature", "45d"), ("boiler/threshold/set", "50"), ("tank/forecast", "NaN"),
            ("utility/threshold/set", "1"), ("tank/temperature", "oops"), ("boiler/threshold/set", "NaN"),
            ("tank/forecast", None), ("tank/forecast", "7"), ("tank/temperature", "NaN"), ("tank/temperature", "NaN")]
    t0 = dt.datetime(2024, 1, 1)
    data = [(i, 1, 1, t0 + dt.timedelta(minutes=i), f"site/{t}", p) for i, (t, p) in enumerate(sent)]
    log = spark.createDataFrame(data, "msg_id long, device_id long, site_id int, ts timestamp_ntz, topic string, payload string")
    for i in range(2):
        log.filter(F.floor(F.col("msg_id") / 5) == i).coalesce(1).write.mode("append").parquet(f"{scratch}/log")
        time.sleep(1.1)  # file times decide the order of batches
    src = message_stream(spark, f"{scratch}/log", max_files_per_trigger=1)
    ST.control_stream(src, f"{scratch}/out", trigger=AVAILABLE_NOW, checkpoint=f"{scratch}/ck").awaitTermination(300)
    cols = ["msg_id", "tank_temperature", "tank_forecast", "boiler_threshold", "boiler_enabled", "utility_enabled"]
    texts = lambda df: sorted(str(tuple(r)) for r in df.select(*cols).collect())
    assert texts(spark.read.parquet(f"{scratch}/out")) == texts(C.control_on_messages(log, "site"))

    value = F.expr("try_cast(payload as double)").alias("value")
    ST.change_stream(src.select("device_id", "ts", "msg_id", value), f"{scratch}/out2", trigger=AVAILABLE_NOW,
                     checkpoint=f"{scratch}/ck2").awaitTermination(300)
    cols = ["msg_id", "value", "previous_value"]
    want = S.change_only(log.select("device_id", "ts", "msg_id", value), ["device_id"], ["ts", "msg_id"], "value")
    assert texts(spark.read.parquet(f"{scratch}/out2")) == texts(want)


def test_weather_added_after_the_start_is_seen(spark, scratch):
    row = "msg_id long, device_id long, site_id int, ts timestamp_ntz, topic string, payload string"
    t0 = dt.datetime(2024, 1, 1)
    weather = lambda: spark.read.parquet(f"{scratch}/weather")

    def add(i, temperature):
        at = t0 + dt.timedelta(hours=i)
        spark.createDataFrame([(i, 1, at, temperature, 0.0, 0.0)],
                              "weather_id long, site_id int, ts timestamp_ntz, temperature double, humidity double, "
                              "wind double").write.mode("append").parquet(f"{scratch}/weather")
        spark.createDataFrame([(i, 1, 1, at + dt.timedelta(minutes=1), "site/tank/temperature", "1")],
                              row).coalesce(1).write.mode("append").parquet(f"{scratch}/log")

    for i in range(3):
        add(i, 10.0 * i + 5)
        ST.forecast_stream(message_stream(spark, f"{scratch}/log"), weather, f"{scratch}/out", trigger=AVAILABLE_NOW,
                           checkpoint=f"{scratch}/ck").awaitTermination(300)
    got = spark.read.parquet(f"{scratch}/out/forecast")
    assert rows(got, ["msg_id", "weather_temperature"]) == [(0, 5.0), (1, 15.0)]


def test_control_and_change_streams_scan_in_spark(spark, scratch):
    """No Python worker holds a key's rows; late rows, null keys and times, and a replayed batch."""
    t0 = dt.datetime(2024, 1, 1)
    at = lambda h: t0 + dt.timedelta(hours=h)
    first = [(1, 1, 1, at(5), "40"), (2, 1, 1, at(9), "70"), (3, None, None, at(1), "50"), (9, 1, 1, None, "30")]
    second = [(4, 1, 1, at(2), "20"), (5, 1, 1, at(3), "20"), (6, None, None, at(0), "50")]  # older than what was seen
    row = "msg_id long, device_id long, site_id int, ts timestamp_ntz, payload string"
    runs = []
    for k, part in enumerate([first, second, second]):
        if k < 2:
            (spark.createDataFrame(part, row).withColumn("topic", F.lit("site/tank/temperature"))
             .coalesce(1).write.mode("append").parquet(f"{scratch}/log"))
        else:  # the last batch is run again as after a failure before its commit
            for c in ("ck", "ck2"):
                for f in (f"{scratch}/{c}/commits/1", f"{scratch}/{c}/commits/.1.crc"):
                    if os.path.exists(f):
                        os.remove(f)
        src = message_stream(spark, f"{scratch}/log")
        value = F.col("payload").cast("double").alias("value")
        for q in (ST.control_stream(src, f"{scratch}/out", trigger=AVAILABLE_NOW, checkpoint=f"{scratch}/ck"),
                  ST.change_stream(src.select("device_id", "ts", "msg_id", value), f"{scratch}/out2",
                                   trigger=AVAILABLE_NOW, checkpoint=f"{scratch}/ck2")):
            q.awaitTermination(300)
            assert "Pandas" not in q._jsq.explainInternal(False)
        runs.append([rows(spark.read.parquet(f"{scratch}/out"), ["msg_id", "tank_temperature", "boiler_enabled"]),
                     rows(spark.read.parquet(f"{scratch}/out2"), ["msg_id", "value", "previous_value"])])
    assert runs[1][0] == [(1, 40.0, True), (2, 70.0, False), (3, 50.0, False), (4, 20.0, True), (5, 20.0, True),
                          (6, 50.0, False), (9, 30.0, True)]
    assert runs[1][1] == [(1, 40.0, 30.0), (2, 70.0, 40.0), (3, 50.0, 0.0), (4, 20.0, 70.0), (9, 30.0, 0.0)]
    assert runs[2] == runs[1]
