"""Operators on hand-made rows (FIXTURES.md §3)."""

import datetime as dt

from pyspark.sql import functions as F

from tankcast.operators import control as C
from tankcast.operators import sensors as S
from tankcast.operators import topics as T
from tankcast.operators import views as V
from tankcast.operators.forecast import enrich_with_weather, predict
from tankcast.operators.windows import last_in_window, latest_per_key, sliding_first_last
from tankcast.plans.forecast import forecast

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)
MSG = "msg_id long, device_id long, site_id int, ts timestamp_ntz, topic string, payload string"
WEATHER = ("weather_id long, site_id int, ts timestamp_ntz, temperature double, "
           "humidity double, wind double")


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_asof_before_any_weather_and_equal_time(spark):
    readings = spark.createDataFrame(
        [(1, 7, 0, at(10), 50.0), (2, 7, 0, at(20), 51.0), (3, 8, 1, at(20), 52.0)],
        "msg_id long, device_id long, site_id int, ts timestamp_ntz, tank_temperature double")
    weather = spark.createDataFrame([(100, 0, at(20), 5.0, 3.0, 7.0), (101, 0, at(25), 9.0, 9.0, 9.0)],
                                    WEATHER)
    got = {r.msg_id: r for r in enrich_with_weather(readings, weather).collect()}
    assert (got[1].weather_temperature, got[1].weather_humidity, got[1].weather_wind) == (0.0, 0.0, 0.0)
    assert got[1].weather_found is False
    assert got[2].weather_temperature == 5.0 and got[2].weather_found  # equal time counts
    assert got[3].weather_found is False  # other site


def test_asof_across_segments(spark):
    # weather one day before the reading: carried over many empty segments
    readings = spark.createDataFrame([(1, 7, 0, at(86400 + 5), 50.0)],
                                     "msg_id long, device_id long, site_id int, ts timestamp_ntz, tank_temperature double")
    weather = spark.createDataFrame([(100, 0, at(3), 5.0, 3.0, 7.0)], WEATHER)
    r = enrich_with_weather(readings, weather, segment="1 hour").first()
    assert r.weather_found and r.weather_temperature == 5.0


def test_last_in_window_tie_larger_id(spark):
    df = spark.createDataFrame([(1, 7, at(1), 10.0), (2, 7, at(1), 20.0), (3, 7, at(6), 30.0)],
                               "msg_id long, device_id long, ts timestamp_ntz, v double")
    got = last_in_window(df, ["device_id"], "ts", "msg_id", "5 seconds").orderBy("window_start").collect()
    assert [r.msg_id for r in got] == [2, 3]
    assert got[0].window_start == at(0) and got[0].window_end == at(5)


def test_golden_forecast_plan(spark):
    msgs = spark.createDataFrame([(1, 7, 0, at(2), "site/tank/temperature", "50")], MSG)
    weather = spark.createDataFrame([(100, 0, at(1), 5.0, 3.0, 7.0)], WEATHER)
    r = forecast(msgs, weather).first()
    assert r.forecast_r2 == 56.7 and r.weather_found


def test_predict_custom_weights(spark):
    df = spark.createDataFrame([(2.0, 1.0, 1.0, 1.0)], "tank_temperature double, weather_temperature double, "
                               "weather_humidity double, weather_wind double")
    assert predict(df, (1.0, 2.0, 3.0, 4.0), 0.5).first().forecast == 2 + 2 + 3 + 4 + 0.5


def test_sliding_first_last_matches_builtin_window(spark):
    rows = [(i, 7, at(i * 700), float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "msg_id long, device_id long, ts timestamp_ntz, v double")
    mine = sliding_first_last(df, ["device_id"], "ts", "msg_id", "v", "3 hours", "30 minutes")
    ref = (df.groupBy("device_id", F.window("ts", "3 hours", "30 minutes").alias("w"))
             .agg(F.count(F.lit(1)).alias("n"),
                  F.max_by("msg_id", F.struct("ts", "msg_id")).alias("newest_id"),
                  F.min_by("msg_id", F.struct("ts", "msg_id")).alias("oldest_id"))
             .select("device_id", F.col("w.start").alias("window_start"), "n", "newest_id", "oldest_id"))
    a = sorted(tuple(r) for r in mine.select("device_id", "window_start", "n", "newest_id", "oldest_id").collect())
    b = sorted(tuple(r) for r in ref.collect())
    assert a == b


def test_topic_subtree(spark):
    df = spark.createDataFrame([("site",), ("site/a/b",), ("site2/a",)], "topic string")
    assert [r.topic for r in T.subtree(df, "site").collect()] == ["site", "site/a/b"]


def test_router_and_guard(spark):
    topics = [f"site/{s}" for s in T.DASHBOARD_ROUTES] + ["site/unknown"]
    df = spark.createDataFrame([(t,) for t in topics], "topic string")
    got = T.route(df, "site").orderBy("route_index").collect()
    assert [r.route_index for r in got] == list(range(1, 9))
    cmd = spark.createDataFrame([(None, "boiler", "41"), ("init", "boiler", "42")],
                                "incoming string, widget string, payload string")
    out = T.command_guard(cmd, "site", "widget", "incoming").collect()
    assert [(r.payload, r.topic) for r in out] == [("41", "site/boiler/threshold/set")]


def test_publish_status_cadence(spark):
    state = spark.createDataFrame(
        [(0, at(i * 3600), i, 50.0, 80.0, 45.0, 60.0) for i in range(13)],
        "site_id int, tick timestamp_ntz, tick_index long, tank_temperature double, "
        "tank_forecast double, boiler_threshold double, utility_threshold double")
    s = C.with_cadence(C.apply_rules(state))
    full = [r.tick_index + 1 for r in s.filter("full_status").orderBy("tick_index").collect()]
    assert full == [6, 12]
    pub = T.publish_status(s, "site")
    assert pub.filter(F.col("topic") == "site/tank/temperature").count() == 13
    assert pub.filter(F.col("topic") == "site/boiler/enabled").count() == 2
    assert {r.payload for r in pub.filter(F.col("topic") == "site/utility/enabled").collect()} == {"true"}


def test_golden_control_rules_and_strictness(spark):
    state = spark.createDataFrame(
        [(0, at(0), 0, 50.0, 80.0, 45.0, 60.0), (0, at(1), 1, 45.0, 60.0, 45.0, 60.0)],
        "site_id int, tick timestamp_ntz, tick_index long, tank_temperature double, "
        "tank_forecast double, boiler_threshold double, utility_threshold double")
    got = C.apply_rules(state).orderBy("tick").collect()
    assert (got[0].boiler_enabled, got[0].utility_enabled) == (False, True)
    assert (got[0].boiler_pin, got[0].utility_pin) == (True, False)
    assert (got[1].boiler_enabled, got[1].utility_enabled) == (False, False)


def test_held_state_initial_and_updates(spark):
    msgs = spark.createDataFrame([
        (1, 7, 0, at(10), "site/tank/temperature", "50"),
        (2, 7, 0, at(3600), "site/boiler/threshold/set", "55"),   # at a tick: counts
        (3, 7, 0, at(7300), "site/tank/forecast", "abc"),          # unparsable: ignored
        (4, 7, 0, at(7300), "site/utility/threshold/set", "40"),
    ], MSG)
    got = C.control_state(msgs, "site", tick="1 hour").orderBy("tick").collect()
    assert [r.tick_index for r in got] == [0, 1, 2]
    assert (got[0].tank_temperature, got[0].tank_forecast, got[0].boiler_threshold,
            got[0].utility_threshold) == (0.0, 0.0, 45.0, 60.0)
    assert got[0].boiler_enabled is True  # 0 < 45 before any message
    assert got[1].boiler_threshold == 55.0 and got[1].tank_temperature == 50.0
    assert got[2].utility_threshold == 60.0  # the 40 arrives after the last tick


def test_tick_grid_large_chunks(spark):
    ev = spark.createDataFrame([(0, at(0)), (0, at(10 * 3600 + 5))], "site_id int, ts timestamp_ntz")
    g = C.tick_grid(ev, ["site_id"], "ts", "1 hour", ticks_per_chunk=3).orderBy("tick").collect()
    assert [r.tick_index for r in g] == list(range(11))
    assert g[-1].tick == at(10 * 3600)


def test_threshold_history(spark):
    msgs = spark.createDataFrame([
        (1, 7, 0, at(0), "site/boiler/threshold/set", "40"),
        (2, 7, 0, at(100000), "site/boiler/threshold/set", "41"),
        (3, 7, 0, at(50), "site/utility/threshold/set", "61"),
    ], MSG)
    got = {r.msg_id: r for r in C.threshold_history(msgs, "site").collect()}
    assert got[1].valid_to == at(100000) and got[2].valid_to is None and got[3].valid_to is None


def test_latest_per_topic(spark):
    msgs = spark.createDataFrame([(1, 7, 0, at(0), "a", "1"), (2, 7, 0, at(5), "a", "2"),
                                  (3, 7, 0, at(5), "b", "3")], MSG)
    got = {r.topic: r.payload for r in latest_per_key(msgs, ["site_id", "topic"], "ts", "msg_id", ["payload"]).collect()}
    assert got == {"a": "2", "b": "3"}


def test_change_only(spark):
    vals = [0, 20, 20, 21, 21, 20]
    df = spark.createDataFrame([(i, 7, at(i * 2000), float(v)) for i, v in enumerate(vals)],
                               "msg_id long, device_id long, ts timestamp_ntz, v double")
    got = S.change_only(df, ["device_id"], ["ts", "msg_id"], "v").orderBy("ts").collect()
    assert [r.v for r in got] == [20.0, 21.0, 20.0]


def test_range_conformance(spark):
    df = spark.createDataFrame([(v,) for v in (-127.0, -55.0, 125.0, 125.1)], "v double")
    assert [r.in_range for r in S.range_conformance(df, "v").collect()] == [False, True, True, False]


def test_min_max_since_reset(spark):
    vals = [(10, False), (30, False), (5, False), (7, True), (8, False)]
    df = spark.createDataFrame([(i, 7, at(i * 1500), float(v), r) for i, (v, r) in enumerate(vals)],
                               "msg_id long, device_id long, ts timestamp_ntz, v double, is_reset boolean")
    got = S.min_max_since_reset(df, ["device_id"], ["ts", "msg_id"], "v", "is_reset").orderBy("ts").collect()
    assert [(r.min_since_reset, r.max_since_reset) for r in got] == [
        (10, 10), (10, 30), (5, 30), (7, 7), (7, 8)]


def test_resource_lookup(spark):
    df = spark.createDataFrame([("/3300/0/5700",), ("/3300/1/9999",), ("/3301/0/5700",)], "resource_path string")
    got = S.resource_lookup(spark, S.split_resource_path(df)).collect()
    names = {r.resource_path: r.resource_name for r in got}
    assert names == {"/3300/0/5700": "Sensor Value", "/3300/1/9999": None, "/3301/0/5700": None}


def test_history_window_cap_and_age(spark):
    newest = at(100000)
    rows = [(i, "s", newest - dt.timedelta(seconds=i * 20)) for i in range(150)]
    rows += [(1000 + i, "s", newest - dt.timedelta(hours=2, seconds=i)) for i in range(5)]
    df = spark.createDataFrame(rows, "msg_id long, series string, ts timestamp_ntz")
    got = V.history_window(df, ["series"], "ts", "msg_id", 100, "1 hour").collect()
    assert len(got) == 100 and max(r.msg_id for r in got) == 99


def test_history_after_clear(spark):
    df = spark.createDataFrame([(1, "s", at(0), False), (2, "s", at(5), True), (3, "s", at(9), False),
                                (4, "t", at(1), False)],
                               "msg_id long, series string, ts timestamp_ntz, is_clear boolean")
    got = sorted(r.msg_id for r in V.history_after_clear(df, ["series"], "ts", "is_clear", "msg_id").collect())
    assert got == [3, 4]


def test_message_log_roundtrip_and_pushdown(spark, scratch):
    from tankcast.sources.messages import read_messages, write_messages
    msgs = spark.createDataFrame([(1, 7, 0, at(0), "site/tank/temperature", "50"),
                                  (2, 7, 0, at(90000), "site/weather", "{}")], MSG)
    write_messages(msgs, f"{scratch}/log")
    got = read_messages(spark, f"{scratch}/log", "site", ["tank/temperature"])
    assert [r.msg_id for r in got.collect()] == [1]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "topic" in plan


def test_train_skips_periods_without_pairs(spark):
    # M4: a period without pairs produces no model version
    from tankcast.operators import training as M
    pairs = spark.createDataFrame(
        [(0, at(0), 1.0, 1.0, 1.0, 1.0, 2.0), (0, at(3600), 1.0, 1.0, 1.0, 1.0, float("nan"))],
        "site_id int, label_pane timestamp_ntz, tank_temperature double, weather_temperature double, "
        "weather_humidity double, weather_wind double, label double")
    versions = M.train_weights(M.train_statistics(pairs, ["site_id"], scale=None), ["site_id"], scale=None)
    assert versions.count() == 1


def test_resource_path_malformed(spark):
    df = spark.createDataFrame([("/3300",), ("junk",), (None,), ("/3300/x/5700",)], "resource_path string")
    got = [tuple(r) for r in S.split_resource_path(df).select("object_id", "instance_id", "resource_id").collect()]
    assert got == [(3300, None, None), (None, None, None), (None, None, None), (3300, None, 5700)]


def test_weather_from_messages(spark):
    from tankcast.sources.messages import weather_from_messages
    msgs = spark.createDataFrame([
        (1, 7, 0, at(0), "site/weather", '{"temperature":5,"humidity":3,"wind":7}'),
        (2, 7, 0, at(5), "site/weather", "oops"),
        (3, 7, 0, at(9), "site/tank/temperature", "50")], MSG)
    got = {r.weather_id: (r.temperature, r.humidity, r.wind) for r in weather_from_messages(msgs, "site").collect()}
    assert got == {1: (5.0, 3.0, 7.0), 2: (0.0, 0.0, 0.0)}


def test_asof_reports_matched_right_time(spark):
    from tankcast.operators.asof import asof_left_join
    left = spark.createDataFrame([(1, 0, at(10)), (2, 0, at(1))], "id long, k int, ts timestamp_ntz")
    right = spark.createDataFrame([(9, 0, at(5), 3.0)], "rid long, k int, ts timestamp_ntz, x double")
    got = {r.id: r for r in asof_left_join(left, right, ["k"], "ts", ["x"], "id", "rid",
                                           right_ts_name="x_ts", found_col="found").collect()}
    assert got[1].x == 3.0 and got[1].x_ts == at(5) and got[1].found
    assert got[2].x is None and got[2].x_ts is None and not got[2].found


def test_checkpoint_dir_fallback_when_unset(tmp_path):
    from tankcast.session import checkpoint_dir

    class Conf:
        def __init__(self):
            self.values = {}

        def get(self, k, default=None):
            return self.values.get(k, default)

        def set(self, k, v):
            raise RuntimeError("read-only at runtime")

    class Ctx:
        def __init__(self):
            self.dir = None

        def getCheckpointDir(self):
            return self.dir

        def setCheckpointDir(self, d):
            self.dir = d

    class Session:
        conf = Conf()
        sparkContext = Ctx()

    s = Session()
    path = checkpoint_dir(s, str(tmp_path))
    assert path.startswith(str(tmp_path)) and s.sparkContext.dir == path
    assert checkpoint_dir(s, str(tmp_path)) == path  # second call reuses it


def test_rules_with_nan_are_off(spark):
    nan = float("nan")
    df = spark.createDataFrame([(50.0, nan, nan, 60.0), (nan, 45.0, 80.0, nan), (40.0, 45.0, 80.0, 60.0)],
                               "tank_temperature double, boiler_threshold double, tank_forecast double, "
                               "utility_threshold double")
    got = [(r.boiler_enabled, r.utility_enabled) for r in C.apply_rules(df).collect()]
    assert got == [(False, False), (False, False), (True, True)]


def test_clear_at_the_same_instant(spark):
    df = spark.createDataFrame([("a", 1, 1, False), ("a", 1, 2, True), ("a", 1, 3, False)],
                               "series string, ts int, msg_id int, is_clear boolean")
    assert [r.msg_id for r in V.history_after_clear(df, ["series"], "ts", "is_clear", "msg_id").collect()] == [3]
