"""Readings, enrichment and linear forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankcast.functions.payload import (DEFAULT_WEIGHTS, WEATHER_DEFAULT, is_quarantined,
                                        linear_forecast, parse_double, round_half_up2)
from tankcast.operators.asof import asof_left_join
from tankcast.operators.segmented import DEFAULT_SEGMENT

TANK_TEMPERATURE = "tank/temperature"
FEATURES = ("tank_temperature", "weather_temperature", "weather_humidity", "weather_wind")


def parse_messages(messages: DataFrame, value_name: str = "value") -> DataFrame:
    """Messages with the payload parsed to double (null when unparsable)."""
    return messages.withColumn(value_name, parse_double("payload"))


def quarantine(messages: DataFrame, payload: str = "payload") -> DataFrame:
    """P2 quarantine output: messages whose non-null payload is not a number."""
    return messages.filter(is_quarantined(payload, parse_double(payload)))


def tank_readings(messages: DataFrame, prefix: str) -> DataFrame:
    """F1 + P2: parsed tank temperature messages; unparsable ones are left out
    (see ``quarantine``)."""
    return (messages.filter(F.col("topic") == f"{prefix}/{TANK_TEMPERATURE}")
            .select("msg_id", "device_id", "site_id", "ts",
                    parse_double("payload").alias("tank_temperature"))
            .filter(F.col("tank_temperature").isNotNull()))


def enrich_with_weather(readings: DataFrame, weather: DataFrame,
                        segment: str = DEFAULT_SEGMENT,
                        readings_cover: DataFrame | None = None) -> DataFrame:
    """J1 + P4: weather current at each reading's time, per site; a miss gives
    (0, 0, 0) and ``weather_found`` = false."""
    w = weather.select("site_id", "ts", "weather_id",
                       F.col("temperature").alias("weather_temperature"),
                       F.col("humidity").alias("weather_humidity"),
                       F.col("wind").alias("weather_wind"))
    cols = ["weather_temperature", "weather_humidity", "weather_wind"]
    return asof_left_join(readings, w, on=["site_id"], ts="ts", right_cols=cols,
                          left_id="msg_id", right_id="weather_id",
                          found_col="weather_found",
                          defaults=dict(zip(cols, WEATHER_DEFAULT)), segment=segment,
                          left_cover=readings_cover)


def predict(df: DataFrame, weights=DEFAULT_WEIGHTS, intercept=0.0,
            out: str = "forecast") -> DataFrame:
    """M1: forecast = dot(weights, features) + intercept, plus its P10 rounding."""
    f = linear_forecast(*FEATURES, weights=weights, intercept=intercept)
    return df.withColumn(out, f).withColumn(out + "_r2", round_half_up2(F.col(out)))


def feature_vector(df: DataFrame) -> DataFrame:
    """P5: the features in model order, as an array column."""
    return df.withColumn("features", F.array(*[F.col(c) for c in FEATURES]))
