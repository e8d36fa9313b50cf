"""Message and weather views derived from the driver's ``events`` table.

The reference receives topic messages from a broker; here the message log is a
table.  These views turn the generic ``events`` table into that log so every
query reads the given data and grows with it.  The same definitions exist as
SQL in ``tankcast.plans.oracle`` for the DuckDB check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tankcast.sources.catalogue import RESOURCE_IDS

# Which event type plays which topic (suffix under the prefix).
EVENT_TOPICS = {
    "view": "tank/temperature",
    "click": "tank/forecast",
    "purchase": "boiler/threshold/set",
    "signup": "utility/threshold/set",
    "error": "weather",
}

DEFAULT_PREFIX = "site"
N_SITES = 4


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _topic_of(event_type: Column, prefix: str) -> Column:
    expr = None
    for et, suffix in EVENT_TOPICS.items():
        expr = (F.when(event_type == et, F.lit(f"{prefix}/{suffix}")) if expr is None
                else expr.when(event_type == et, F.lit(f"{prefix}/{suffix}")))
    return expr


def messages_view(events: DataFrame, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """messages(msg_id, device_id, site_id, ts, topic, payload)."""
    return events.select(
        F.col("event_id").alias("msg_id"),
        F.col("user_id").alias("device_id"),
        (F.col("user_id") % N_SITES).cast("int").alias("site_id"),
        F.col("ts"),
        _topic_of(F.col("event_type"), prefix).alias("topic"),
        F.col("value").cast("string").alias("payload"),
    )


def weather_view(events: DataFrame) -> DataFrame:
    """weather(weather_id, site_id, ts, temperature, humidity, wind)."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return (events.filter(F.col("event_type") == "error")
            .select(F.col("event_id").alias("weather_id"),
                    (F.col("user_id") % N_SITES).cast("int").alias("site_id"),
                    F.col("ts"),
                    F.col("value").alias("temperature"),
                    k.cast("double").alias("humidity"),
                    (k % 10).cast("double").alias("wind")))


# --- extra derived columns (FIXTURES §2) -------------------------------------

def with_payload_dirty(messages: DataFrame) -> DataFrame:
    return messages.withColumn(
        "payload_dirty",
        F.when(F.col("msg_id") % 7 == 0, F.concat(F.lit("x"), F.col("payload")))
        .otherwise(F.col("payload")))


def with_payload_bin(messages: DataFrame) -> DataFrame:
    return messages.withColumn("payload_bin", F.col("payload").cast("binary"))


def with_topic_cmd(messages: DataFrame) -> DataFrame:
    return messages.withColumn(
        "topic_cmd", F.when(F.col("msg_id") % 3 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("topic")))


def with_topic_tree(messages: DataFrame, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    return messages.withColumn(
        "topic_tree",
        F.when(F.col("msg_id") % 11 == 0, F.lit(prefix + "2/x"))
        .when(F.col("msg_id") % 11 == 1, F.lit(prefix))
        .otherwise(F.col("topic")))


def with_device_addr(messages: DataFrame) -> DataFrame:
    return messages.withColumn(
        "device_addr", F.unhex(F.lpad(F.hex(F.col("device_id")), 16, "0")))


def with_resource_path(messages: DataFrame) -> DataFrame:
    ids = F.array(*[F.lit(i) for i in list(RESOURCE_IDS) + [9999]])
    rid = F.element_at(ids, (F.col("msg_id") % 10 + 1).cast("int"))
    return messages.withColumn(
        "resource_path",
        F.concat(F.lit("/3300/"), (F.col("device_id") % 3).cast("string"),
                 F.lit("/"), rid.cast("string")))


def with_held_value(events_like: DataFrame, value_col: str = "value") -> DataFrame:
    return events_like.withColumn("held_value", F.floor(F.col(value_col) / 50).cast("double"))


def with_reset_flags(df: DataFrame, id_col: str = "msg_id") -> DataFrame:
    return (df.withColumn("is_reset", F.col(id_col) % 100 == 0)
              .withColumn("is_clear", F.col(id_col) % 500 == 0))


def weather_json_view(weather: DataFrame) -> DataFrame:
    """weather rows with a JSON document payload, some broken (P3/S5 input)."""
    t = F.col("temperature").cast("string")
    h = F.col("humidity").cast("string")
    w = F.col("wind").cast("string")
    full = F.concat(F.lit('{"temperature":'), t, F.lit(',"humidity":'), h,
                    F.lit(',"wind":'), w, F.lit("}"))
    return weather.withColumn(
        "weather_json",
        F.when(F.col("weather_id") % 10 == 0, F.lit("oops"))
        .when(F.col("weather_id") % 10 == 1, F.concat(F.lit('{"temperature":'), t, F.lit("}")))
        .otherwise(full))


def on_topics(events: DataFrame, topics: Sequence[str] | None) -> DataFrame:
    """Events that play one of ``topics`` (suffixes): a plain filter on
    ``event_type``, which the scan takes over, unlike one on the mapped topic."""
    if topics is None:
        return events
    return events.filter(F.col("event_type").isin([e for e, t in EVENT_TOPICS.items() if t in topics]))


def load_messages(spark: SparkSession, sf_dir: str, prefix: str = DEFAULT_PREFIX,
                  topics: Sequence[str] | None = None) -> DataFrame:
    return messages_view(on_topics(load_table(spark, sf_dir, "events"), topics), prefix)


def load_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weather_view(load_table(spark, sf_dir, "events"))
