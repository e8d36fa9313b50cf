"""Scalar column functions on hand-made rows (FIXTURES.md §3)."""

import math

from pyspark.sql import functions as F

from tankcast.functions import payload as P


def one(spark, expr, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_golden_weather_factor_and_forecast(spark):
    df = spark.createDataFrame([(50.0, 5.0, 3.0, 7.0)], "t double, a double, h double, w double")
    r = df.select(P.weather_factor("a", "h", "w").alias("f"),
                  P.round_half_up2(P.linear_forecast("t", "a", "h", "w")).alias("fc")).first()
    assert r.f == 6.7
    assert r.fc == 56.7


def test_payload_parse_and_quarantine(spark):
    rows = [("45.5",), ("abc",), ("",), ("NaN",), ("1e3",), (None,)]
    df = spark.createDataFrame(rows, "payload string").withColumn("v", P.parse_double("payload"))
    got = df.withColumn("q", P.is_quarantined("payload", "v")).collect()
    assert got[0].v == 45.5 and not got[0].q
    assert got[1].v is None and got[1].q
    assert got[2].v is None and got[2].q
    assert math.isnan(got[3].v) and not got[3].q
    assert got[4].v == 1000.0
    assert got[5].v is None and not got[5].q  # absent payload is not quarantined


def test_weather_json_defaults(spark):
    docs = ['{"temperature":5,"humidity":3,"wind":7}', '{"temperature":5}', "oops", "", None]
    df = spark.createDataFrame([(d,) for d in docs], "j string")
    got = [tuple(r) for r in df.select(P.parse_weather_json("j").alias("w"))
           .select("w.temperature", "w.humidity", "w.wind").collect()]
    assert got == [(5.0, 3.0, 7.0), (5.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0),
                   (0.0, 0.0, 0.0)]


def test_weather_json_roundtrip(spark):
    df = spark.createDataFrame([(5.5, 3.0, 7.25)], "temperature double, humidity double, wind double")
    doc = df.select(P.weather_to_json().alias("d")).first().d
    assert doc == '{"temperature":5.5,"humidity":3.0,"wind":7.25}'
    back = df.select(P.parse_weather_json(P.weather_to_json()).alias("w")).first().w
    assert tuple(back) == (5.5, 3.0, 7.25)


def test_round_half_up2(spark):
    got = one(spark, P.round_half_up2("x"), "x double", [(-0.005,), (1.005,), (0.0,), (2.675,)])
    assert got[0] == 0.0 and got[1] == 1.0 and got[2] == 0.0
    # Spark's round() would give -0.01 and 1.01: the dashboard rule differs
    assert spark.range(1).select(F.round(F.lit(-0.005), 2)).first()[0] == -0.01


def test_device_hex(spark):
    addr = bytes([0x28, 0x0A, 0xFF, 0x00, 0x01, 0x02, 0x03, 0x04])
    got = one(spark, P.device_hex("a"), "a binary", [(bytearray(addr),)])
    assert got == ["280aff0001020304"]


def test_decode_and_text(spark):
    df = spark.createDataFrame([(bytearray("21.5".encode()), True, 45.0)], "b binary, e boolean, t double")
    r = df.select(P.decode_payload("b").alias("s"), P.to_text("e").alias("e"),
                  P.to_text("t").alias("t")).first()
    assert (r.s, r.e, r.t) == ("21.5", "true", "45.0")


def test_time_label(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 13, 5, 9),)], "ts timestamp_ntz")
    assert df.select(P.time_label("ts")).first()[0] == "13:05:09"


def test_malformed_bytes_and_non_finite_rounding(spark):
    from tankcast.functions import payload as P
    row = spark.createDataFrame([(bytearray(b"4\xff5"),)], "b binary").select(P.decode_payload("b").alias("t")).first()
    assert row.t == "4\ufffd5"
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1e300,), (-0.005,), (None,)], "x double")
    got = [r.y for r in df.select(P.round_half_up2("x").alias("y")).collect()]
    assert got[0] != got[0] and got[1:] == [float("inf"), 1e300, 0.0, None]
