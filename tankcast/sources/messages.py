"""Batch readers for message logs and weather tables.

A message log is any table with the message schema (parquet by default);
its ``topic``/``ts`` filters are pushed into the scan.  Store logs
partitioned by date so time filters prune whole folders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tankcast.functions.payload import parse_weather_json
from tankcast.streaming.sources import MESSAGE_SCHEMA, WEATHER_SCHEMA


def read_messages(spark: SparkSession, path: str, prefix: str | None = None,
                  topics: Sequence[str] | None = None, fmt: str = "parquet",
                  start=None, end=None) -> DataFrame:
    """S1 + F1: messages of the given exact topics (suffixes under ``prefix``)
    within an optional [start, end) time range."""
    df = spark.read.format(fmt).schema(MESSAGE_SCHEMA).load(path)
    if topics:
        names = [f"{prefix}/{t}" if prefix else t for t in topics]
        df = df.filter(F.col("topic").isin(names))
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start))
    if end is not None:
        df = df.filter(F.col("ts") < F.lit(end))
    return df


def read_weather(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The weather table (site_id, ts, temperature, humidity, wind)."""
    return spark.read.format(fmt).schema(WEATHER_SCHEMA).load(path)


def write_messages(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append messages to a log partitioned by event date."""
    (df.withColumn("date", F.to_date("ts")).write.mode(mode)
       .partitionBy("date").parquet(path))


def weather_from_messages(messages: DataFrame, prefix: str, topic: str = "weather") -> DataFrame:
    """S4 + P3: weather documents published as messages -> weather rows.  A
    missing or broken document gives 0 for the missing fields, as the
    reference's default weather object did."""
    w = parse_weather_json("payload")
    return (messages.filter(F.col("topic") == f"{prefix}/{topic}")
            .select(F.col("msg_id").alias("weather_id"), "site_id", "ts", w.alias("w"))
            .select("weather_id", "site_id", "ts", "w.temperature", "w.humidity", "w.wind"))
