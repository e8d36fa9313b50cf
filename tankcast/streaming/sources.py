"""Streaming message sources.

A message log is a directory of parquet (or JSON) files with the message
schema; a broker topic read through Spark's Kafka source has the columns
``topic, value, timestamp`` and is mapped onto the same schema.  Event time is
cast to TIMESTAMP for watermarks (TIMESTAMP_NTZ cannot carry one); run with
``spark.sql.session.timeZone=UTC`` so the cast is the identity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tankcast.functions.payload import decode_payload

MESSAGE_SCHEMA = ("msg_id bigint, device_id bigint, site_id int, ts timestamp_ntz, "
                  "topic string, payload string")
WEATHER_SCHEMA = ("weather_id bigint, site_id int, ts timestamp_ntz, temperature double, "
                  "humidity double, wind double")


def message_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                   max_files_per_trigger: int | None = None,
                   topics: list[str] | None = None) -> DataFrame:
    """Streaming DataFrame over a message log; replayable, so a restarted
    query resumes from its checkpoint without loss."""
    r = spark.readStream.format(fmt).schema(MESSAGE_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    df = r.load(path).withColumn("ts", F.col("ts").cast("timestamp"))
    if topics:
        df = df.filter(F.col("topic").isin(topics))
    return df


def weather_stream(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S4 as a stream: weather rows appended to a folder."""
    return (spark.readStream.format(fmt).schema(WEATHER_SCHEMA).load(path)
            .withColumn("ts", F.col("ts").cast("timestamp")))


def from_kafka(df: DataFrame, device: Column, site: Column) -> DataFrame:
    """Map Kafka records (key, value, topic, partition, offset, timestamp) to
    messages: ``device`` (bigint) and ``site`` (int) are the caller's expressions
    over the record and its decoded ``key_text``; payload bytes decoded as UTF-8,
    the record time as event time, (partition, offset) folded into a unique
    message id.  A record without a device keeps a null ``device_id``."""
    df = df.withColumn("key_text", decode_payload("key"))
    return df.select(
        (F.col("partition").cast("bigint") * F.lit(1 << 40) + F.col("offset")).alias("msg_id"),
        device.cast("bigint").alias("device_id"),
        site.cast("int").alias("site_id"),
        F.col("timestamp").alias("ts"),
        F.col("topic"),
        decode_payload("value").alias("payload"))


def to_ntz(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df
