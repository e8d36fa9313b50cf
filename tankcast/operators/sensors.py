"""Sensor-side data logic: emit on change, range check, resource lookup,
min/max since reset, minimum-interval sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tankcast.operators.segmented import (DEFAULT_SEGMENT, asof_fill,
                                          running_extremes_since_reset)
from tankcast.sources.catalogue import (OBJECT_ID, SENSOR_MAX_RANGE, SENSOR_MIN_RANGE,
                                        resource_catalogue)

INITIAL_HELD = 0.0  # the sensor's held value before the first reading


def change_only(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                initial: float = INITIAL_HELD, segment: str = DEFAULT_SEGMENT) -> DataFrame:
    """keep a reading only when it differs from the held (previous) value;
    the held value starts at ``initial``.  The previous value comes from a
    segmented scan, so a hot device is split by time."""
    prev = asof_fill(df, keys, order, {"__prev": value}, segment=segment, inclusive=False)
    held = F.coalesce(F.col("__prev"), F.lit(initial))
    return (prev.filter(F.col(value) != held)
                .withColumn("previous_value", held).drop("__prev"))


def range_conformance(df: DataFrame, value: str, min_range: float = SENSOR_MIN_RANGE,
                      max_range: float = SENSOR_MAX_RANGE, out: str = "in_range") -> DataFrame:
    """is the value inside the sensor's declared range (bounds included)?"""
    return df.withColumn(out, F.col(value).between(F.lit(min_range), F.lit(max_range)))


def split_resource_path(df: DataFrame, path: str = "resource_path") -> DataFrame:
    """S6: '/object/instance/resource' -> three integer columns."""
    parts = F.split(F.col(path), "/")
    # try_element_at: a short or malformed path gives nulls, never an error
    return (df.withColumn("object_id", F.try_element_at(parts, F.lit(2)).try_cast("int"))
              .withColumn("instance_id", F.try_element_at(parts, F.lit(3)).try_cast("int"))
              .withColumn("resource_id", F.try_element_at(parts, F.lit(4)).try_cast("int")))


def resource_lookup(spark: SparkSession, df: DataFrame, object_id: int = OBJECT_ID) -> DataFrame:
    """Describe each addressed resource from the catalogue, null when the
    id is unknown.  The catalogue has nine rows, so it is broadcast."""
    cat = resource_catalogue(spark).select(
        "resource_id", F.col("name").alias("resource_name"),
        F.col("type").alias("resource_type"), "operations", "mandatory")
    known = F.col("object_id") == F.lit(object_id)
    d = df.withColumn("__rid", F.when(known, F.col("resource_id")))
    return (d.join(F.broadcast(cat.withColumnRenamed("resource_id", "__rid")), "__rid", "left")
             .drop("__rid"))


def min_max_since_reset(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                        value: str, reset: str, segment: str = DEFAULT_SEGMENT) -> DataFrame:
    """A4: running min/max measured value since the last reset row."""
    return running_extremes_since_reset(df, keys, order, value, reset, segment=segment)
