"""Registry of the queries the driver runs: name -> (spark, sf_dir) -> DataFrame.

Every query reads the given ``events`` table (through the message / weather
views) so its work grows with the data.  Parameters that differ from the
reference's (48 h chart history, 1 h tick, 30 min panes) are chosen so the
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tankcast.functions import payload as P
from tankcast.operators import control as C
from tankcast.operators import sampling as W
from tankcast.operators import sensors as S
from tankcast.operators import topics as T
from tankcast.operators import training as M
from tankcast.operators import views as V
from tankcast.operators.forecast import TANK_TEMPERATURE, enrich_with_weather, quarantine, tank_readings
from tankcast.operators.windows import last_in_window, latest_per_key, sliding_first_last
from tankcast.plans import forecast as fplan
from tankcast.session import materialize
from tankcast.sources import fixtures as X
from tankcast.sources.fixtures import DEFAULT_PREFIX as PREFIX
from tankcast.sources.fixtures import load_messages, load_weather

Query = Callable[[SparkSession, str], DataFrame]


def _parsed(spark, sf_dir) -> DataFrame:
    """All messages with the payload parsed; unparsable payloads left out."""
    m = load_messages(spark, sf_dir)
    return m.withColumn("value", P.parse_double("payload")).filter(F.col("value").isNotNull())


def _tank(spark, sf_dir) -> DataFrame:
    """Messages on the tank temperature topic: the only ones a forecast reads."""
    return load_messages(spark, sf_dir, topics=[TANK_TEMPERATURE])


def _gateway(spark, sf_dir) -> DataFrame:
    """Messages on the topics whose values the gateway holds."""
    return load_messages(spark, sf_dir, topics=list(C.HELD_SERIES))


# --- forecast (S1 F1 P2 J1 A1 P4 P5 M1) --------------------------------------

def q_forecast_default(spark, sf_dir):
    return fplan.forecast(_tank(spark, sf_dir), load_weather(spark, sf_dir))


def q_message_source(spark, sf_dir):
    topics = ["tank/temperature", "tank/forecast"]
    return T.exact_topics(load_messages(spark, sf_dir, topics=topics), PREFIX, topics)


def q_weather_enrich(spark, sf_dir):
    r = tank_readings(_tank(spark, sf_dir), PREFIX)
    return enrich_with_weather(r, load_weather(spark, sf_dir))


def q_last_in_window(spark, sf_dir):
    return last_in_window(_parsed(spark, sf_dir), ["site_id", "topic"], "ts", "msg_id",
                          "30 minutes", cols=["ts", "msg_id", "value"])


def q_sliding_first_last(spark, sf_dir):
    r = tank_readings(_tank(spark, sf_dir), PREFIX)
    return sliding_first_last(r, ["site_id"], "ts", "msg_id", "tank_temperature",
                              "3 hours", "30 minutes")


# --- payloads (P1 P2 P3 S5 P8 P10 P11 P13) -----------------------------------

def q_payload_decode(spark, sf_dir):
    m = X.with_payload_bin(load_messages(spark, sf_dir))
    return m.select("msg_id", P.decode_payload("payload_bin").alias("payload_text"))


def q_payload_parse(spark, sf_dir):
    m = X.with_payload_dirty(load_messages(spark, sf_dir))
    return m.select("msg_id", "payload_dirty", P.parse_double("payload_dirty").alias("value"))


def q_payload_quarantine(spark, sf_dir):
    m = X.with_payload_dirty(load_messages(spark, sf_dir))
    return quarantine(m, "payload_dirty").select("msg_id", "topic", "payload_dirty")


def q_weather_json_parse(spark, sf_dir):
    w = X.weather_json_view(load_weather(spark, sf_dir))
    p = P.parse_weather_json("weather_json")
    return w.select("weather_id", "site_id", "ts", "weather_json",
                    p["temperature"].alias("temperature"), p["humidity"].alias("humidity"),
                    p["wind"].alias("wind"))


def q_weather_json_roundtrip(spark, sf_dir):
    w = load_weather(spark, sf_dir)
    doc = P.weather_to_json()
    back = P.parse_weather_json(doc)
    return w.select("weather_id", doc.alias("weather_doc"),
                    (back["temperature"] == F.col("temperature")).alias("temperature_same"),
                    (back["humidity"] == F.col("humidity")).alias("humidity_same"),
                    (back["wind"] == F.col("wind")).alias("wind_same"))


def q_device_hex(spark, sf_dir):
    m = X.with_device_addr(load_messages(spark, sf_dir))
    return m.select("msg_id", "device_id", P.device_hex("device_addr").alias("device_hex"))


def q_round_half_up2(spark, sf_dir):
    v = _parsed(spark, sf_dir).select("msg_id", (F.col("value") / 8).alias("x"))
    return v.withColumn("x_r2", P.round_half_up2("x"))


def q_weather_factor(spark, sf_dir):
    w = load_weather(spark, sf_dir)
    return w.select("weather_id", "site_id", "ts", P.weather_factor().alias("weather_factor"))


# --- topics and publishing (F2 F4 F5 P15 P9 S2 S3 S6) -------------------------

def q_topic_subtree(spark, sf_dir):
    m = X.with_topic_tree(load_messages(spark, sf_dir))
    return T.subtree(m, PREFIX, "topic_tree").select("msg_id", "topic_tree")


def q_topic_route(spark, sf_dir):
    return T.route(load_messages(spark, sf_dir), PREFIX).select(
        "msg_id", "topic", "route_index", "route")


def q_command_guard(spark, sf_dir):
    sets = ["boiler/threshold/set", "utility/threshold/set"]
    m = X.with_topic_cmd(load_messages(spark, sf_dir, topics=sets))
    m = (T.exact_topics(m, PREFIX, sets)
         .withColumn("widget", F.split("topic", "/").getItem(1)))
    return T.command_guard(m.drop("topic"), PREFIX, "widget", "topic_cmd").select(
        "msg_id", "widget", "payload", "topic")


def q_publish_forecast(spark, sf_dir):
    f = fplan.forecast(_tank(spark, sf_dir), load_weather(spark, sf_dir))
    return T.publish(f, PREFIX, "tank/forecast", "forecast", key_cols=["device_id", "site_id"])


def q_resource_path_split(spark, sf_dir):
    m = X.with_resource_path(load_messages(spark, sf_dir))
    return S.split_resource_path(m).select("msg_id", "resource_path", "object_id",
                                           "instance_id", "resource_id")


# --- gateway state and control (A3 W1 J4 C1 C2 P12 W2 C3 S3) -----------------

def q_latest_per_topic(spark, sf_dir):
    return latest_per_key(load_messages(spark, sf_dir), ["site_id", "topic"], "ts", "msg_id",
                          ["payload"])


def q_tick_sample_hold(spark, sf_dir):
    return C.held_state(_gateway(spark, sf_dir), PREFIX, tick="1 hour",
                        series={"tank/temperature": "tank_temperature"})


def q_control_state(spark, sf_dir):
    return C.control_state(_gateway(spark, sf_dir), PREFIX, tick="1 hour")


def q_status_cadence(spark, sf_dir):
    s = C.with_cadence(C.control_state(_gateway(spark, sf_dir), PREFIX, tick="1 hour"))
    return s.select("site_id", "tick", "tick_index", "full_status")


def q_publish_status(spark, sf_dir):
    s = C.with_cadence(C.control_state(_gateway(spark, sf_dir), PREFIX, tick="1 hour"))
    return T.publish_status(s, PREFIX)


def q_threshold_history(spark, sf_dir):
    sets = ["boiler/threshold/set", "utility/threshold/set"]
    return C.threshold_history(load_messages(spark, sf_dir, topics=sets), PREFIX)


# --- dashboard views and sensor logic (W3 W5 P14 F6 F7 J5 A4) ---------------

def q_history_window(spark, sf_dir):
    v = _parsed(spark, sf_dir).select("site_id", "topic", "ts", "msg_id", "value")
    return V.history_window(v, ["site_id", "topic"], "ts", "msg_id", 100, "48 hours")


def q_history_after_clear(spark, sf_dir):
    m = X.with_reset_flags(load_messages(spark, sf_dir)).select(
        "site_id", "topic", "ts", "msg_id", "payload", "is_clear")
    return V.history_after_clear(m, ["site_id", "topic"], "ts", "is_clear", "msg_id")


def q_change_only(spark, sf_dir):
    v = X.with_held_value(_parsed(spark, sf_dir)).select("device_id", "ts", "msg_id", "held_value")
    return S.change_only(v, ["device_id"], ["ts", "msg_id"], "held_value")


def q_range_conformance(spark, sf_dir):
    r = tank_readings(_tank(spark, sf_dir), PREFIX)
    return S.range_conformance(r, "tank_temperature").select(
        "msg_id", "device_id", "tank_temperature", "in_range")


def q_resource_lookup(spark, sf_dir):
    m = S.split_resource_path(X.with_resource_path(load_messages(spark, sf_dir)))
    return S.resource_lookup(spark, m.select("msg_id", "resource_path", "object_id",
                                             "instance_id", "resource_id"))


def q_min_max_since_reset(spark, sf_dir):
    v = X.with_reset_flags(_parsed(spark, sf_dir)).select(
        "device_id", "ts", "msg_id", "value", "is_reset")
    return S.min_max_since_reset(v, ["device_id"], ["ts", "msg_id"], "value", "is_reset")


def q_min_interval_sample(spark, sf_dir):
    """W4 with a 2 h interval: the test series are sparse, 5 s would keep all."""
    v = _parsed(spark, sf_dir).select("device_id", "ts", "msg_id", "value")
    return W.min_interval_sample(v, ["device_id"], "ts", "msg_id", "2 hours", "6 hours")


# --- the same operators at the reference's own parameters --------------------

def q_history_window_1h(spark, sf_dir):
    """W3 as the dashboard chart keeps it: 100 points, none older than 1 h."""
    v = _parsed(spark, sf_dir).select("site_id", "topic", "ts", "msg_id", "value")
    return V.history_window(v, ["site_id", "topic"], "ts", "msg_id", 100, "1 hour")


def q_min_interval_sample_5s(spark, sf_dir):
    """W4 with the sensor's 5 s interval."""
    v = _parsed(spark, sf_dir).select("device_id", "ts", "msg_id", "value")
    return W.min_interval_sample(v, ["device_id"], "ts", "msg_id", "5 seconds", "1 hour")


def q_control_state_1m(spark, sf_dir):
    """J4 + C1/C2 on a one-minute tick (173k ticks for 4 sites x 30 days)."""
    return C.control_state(_gateway(spark, sf_dir), PREFIX, tick="1 minute")


# --- training (J2 J3 P5 P6 P7 F3 M2 M3 M4) -----------------------------------

# The test tables reach 490 in every feature; these divisors keep SGD stable.
TEST_SCALE = (500.0, 500.0, 100.0, 10.0)
DOCUMENTED_SCALE = (*TEST_SCALE, 500.0, 100.0, 10.0)


def _pairs(spark, sf_dir, documented=False):
    r = tank_readings(_tank(spark, sf_dir), PREFIX)
    return M.training_pairs(r, load_weather(spark, sf_dir), documented=documented)


def q_training_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


def q_training_pairs_documented(spark, sf_dir):
    return _pairs(spark, sf_dir, documented=True)


def q_label_filter(spark, sf_dir):
    return M.label_filter(_pairs(spark, sf_dir))


def q_feature_vector(spark, sf_dir):
    from tankcast.operators.forecast import feature_vector
    f = feature_vector(fplan.forecast(_tank(spark, sf_dir), load_weather(spark, sf_dir)))
    return f.select("device_id", "window_start",
                    *[F.col("features")[i].alias(f"feature_{i}") for i in range(4)])


def q_train_statistics(spark, sf_dir):
    return M.train_statistics(_pairs(spark, sf_dir), ["site_id"], scale=TEST_SCALE)


def q_train_weights(spark, sf_dir):
    stats = M.train_statistics(_pairs(spark, sf_dir), ["site_id"], scale=TEST_SCALE)
    return M.train_weights(stats, ["site_id"], scale=TEST_SCALE)


def q_train_weights_global(spark, sf_dir):
    """M2 with one global model: a period's mini-batch holds every site's
    pair.  Sums of several pairs may differ in the last bit between engines,
    so weights are reported to 6 places."""
    stats = M.train_statistics(_pairs(spark, sf_dir), [], scale=TEST_SCALE)
    models = M.train_weights(stats, [], scale=TEST_SCALE)
    return models.select("model_key", "version_ts", "n",
                         *[F.round(c, 6).alias(c) for c in ("w_tank", "w_temp", "w_hum", "w_wind")])


def q_train_first_batch(spark, sf_dir):
    """M2 on one mini-batch: of every (site, period), 50 SGD steps from the
    default weights, weights rounded to 4 places."""
    stats = M.train_statistics(_pairs(spark, sf_dir), ["site_id"], scale=TEST_SCALE)
    alone = stats.withColumn("period", F.col("batch"))
    models = M.train_weights(alone, ["site_id", "period"], scale=TEST_SCALE)
    return models.select("site_id", "version_ts",
                         *[F.round(c, 4).alias(c) for c in ("w_tank", "w_temp", "w_hum", "w_wind")])


def _documented_models(spark, sf_dir):
    stats = M.train_statistics(_pairs(spark, sf_dir, documented=True), ["site_id"], scale=DOCUMENTED_SCALE,
                               features=M.DOCUMENTED)
    return M.train_weights(stats, ["site_id"], initial=M.DOCUMENTED_WEIGHTS, scale=DOCUMENTED_SCALE)


def q_train_weights_documented(spark, sf_dir):
    """The documented model of seven features."""
    return _documented_models(spark, sf_dir)


def q_forecast_documented(spark, sf_dir):
    """Scored with the newest version and the weather at the forecast's time."""
    msgs, weather = _tank(spark, sf_dir), load_weather(spark, sf_dir)
    models = materialize(_documented_models(spark, sf_dir))
    readings = tank_readings(msgs, PREFIX)
    rows = fplan.forecast(msgs, weather).drop("forecast", "forecast_r2", "weather_found")
    rows = M.with_weather_at_horizon(rows, weather, rows_cover=readings)
    cover = readings.select("site_id", F.window("ts", "5 seconds").end.alias("window_end"))
    return M.forecast_with_models(rows, models, ["site_id"], initial=M.DOCUMENTED_WEIGHTS, rows_cover=cover,
                                  features=M.DOCUMENTED)


def q_forecast_trained(spark, sf_dir):
    msgs, weather = _tank(spark, sf_dir), load_weather(spark, sf_dir)
    stats = M.train_statistics(_pairs(spark, sf_dir), ["site_id"], scale=TEST_SCALE)
    # the model table is small (one row per site and period) but expensive;
    # write it once to the shared checkpoint folder, as a deployment would
    models = materialize(M.train_weights(stats, ["site_id"], scale=TEST_SCALE))
    rows = fplan.forecast(msgs, weather).drop("forecast", "forecast_r2")
    cover = tank_readings(msgs, PREFIX).select(
        "site_id", F.window("ts", "5 seconds").end.alias("window_end"))
    return M.forecast_with_models(rows, models, ["site_id"], rows_cover=cover)


QUERIES: dict[str, Query] = {
    "forecast_default": q_forecast_default,
    "message_source": q_message_source,
    "weather_enrich": q_weather_enrich,
    "last_in_window": q_last_in_window,
    "sliding_first_last": q_sliding_first_last,
    "payload_decode": q_payload_decode,
    "payload_parse": q_payload_parse,
    "payload_quarantine": q_payload_quarantine,
    "weather_json_parse": q_weather_json_parse,
    "weather_json_roundtrip": q_weather_json_roundtrip,
    "device_hex": q_device_hex,
    "round_half_up2": q_round_half_up2,
    "weather_factor": q_weather_factor,
    "topic_subtree": q_topic_subtree,
    "topic_route": q_topic_route,
    "command_guard": q_command_guard,
    "publish_forecast": q_publish_forecast,
    "resource_path_split": q_resource_path_split,
    "latest_per_topic": q_latest_per_topic,
    "tick_sample_hold": q_tick_sample_hold,
    "control_state": q_control_state,
    "status_cadence": q_status_cadence,
    "publish_status": q_publish_status,
    "threshold_history": q_threshold_history,
    "history_window": q_history_window,
    "history_after_clear": q_history_after_clear,
    "change_only": q_change_only,
    "range_conformance": q_range_conformance,
    "resource_lookup": q_resource_lookup,
    "min_max_since_reset": q_min_max_since_reset,
    "min_interval_sample": q_min_interval_sample,
    "history_window_1h": q_history_window_1h,
    "min_interval_sample_5s": q_min_interval_sample_5s,
    "control_state_1m": q_control_state_1m,
    "training_pairs": q_training_pairs,
    "training_pairs_documented": q_training_pairs_documented,
    "label_filter": q_label_filter,
    "feature_vector": q_feature_vector,
    "train_statistics": q_train_statistics,
    "train_weights": q_train_weights,
    "train_first_batch": q_train_first_batch,
    "train_weights_global": q_train_weights_global,
    "forecast_trained": q_forecast_trained,
    "train_weights_documented": q_train_weights_documented,
    "forecast_documented": q_forecast_documented,
}
