"""Sensor resource catalogue and sensor dimension (generic sensor object 3300).

These are dimension tables of a fixed, tiny size (nine resources, one row per
device type); joins against them may always broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The nine resources of object 3300 as the reference declares
# them (id, name, operations, type, mandatory, units), in catalogue order.
RESOURCES = [
    (5700, "Sensor Value", "R", "Float", True, "Defined by Units resource"),
    (5701, "Sensor Units", "R", "String", False, None),
    (5601, "Min Measured Value", "R", "Float", False, "Defined by Units resource"),
    (5602, "Max Measured Value", "R", "Float", False, "Defined by Units resource"),
    (5603, "Min Range Value", "R", "Float", False, "Defined by Units resource"),
    (5604, "Max Range Value", "R", "Float", False, "Defined by Units resource"),
    (5750, "Application Type", "RW", "String", False, None),
    (5751, "Sensor Type", "R", "String", False, None),
    (5605, "Reset Min and Max Measured Values", "E", "Opaque", False, None),
]
RESOURCE_IDS = [r[0] for r in RESOURCES]
OBJECT_ID = 3300

# Defaults of a sensor instance.
SENSOR_UNIT = "Cel"
SENSOR_MIN_RANGE = -55.0
SENSOR_MAX_RANGE = 125.0
SENSOR_APP_TYPE = "Solar tank temperature"
SENSOR_TYPE = "Digital Thermometer"

RESOURCE_SCHEMA = T.StructType([
    T.StructField("resource_id", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("operations", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("mandatory", T.BooleanType(), False),
    T.StructField("units", T.StringType(), True),
])


def resource_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RESOURCES, RESOURCE_SCHEMA)


def sensor_dimension(spark: SparkSession) -> DataFrame:
    """One row describing the default temperature sensor."""
    schema = ("unit string, min_range double, max_range double, "
              "app_type string, sensor_type string")
    return spark.createDataFrame(
        [(SENSOR_UNIT, SENSOR_MIN_RANGE, SENSOR_MAX_RANGE, SENSOR_APP_TYPE, SENSOR_TYPE)], schema)
