"""Column functions: payload decoding and parsing, topics, rounding, labels.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEATHER_SCHEMA = "temperature double, humidity double, wind double"
# The weather used when none is known (0, 0, 0).
WEATHER_DEFAULT = (0.0, 0.0, 0.0)
# Forecast weights (tank, temperature, humidity, wind), intercept 0.
DEFAULT_WEIGHTS = (1.0, 1.0, 0.1, 0.2)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode_payload(c: Column | str) -> Column:
    """Payload bytes -> UTF-8 text; malformed bytes become U+FFFD."""
    return F.make_valid_utf8(_c(c).cast("string"))


def parse_double(c: Column | str) -> Column:
    """Text -> double; null when the text is not a number (never throws)."""
    return _c(c).try_cast("double")


def is_quarantined(payload: Column | str, parsed: Column | str) -> Column:
    """A payload that was present but did not parse."""
    return _c(payload).isNotNull() & _c(parsed).isNull()


def parse_weather_json(c: Column | str) -> Column:
    """JSON text -> struct(temperature, humidity, wind); any missing or
    broken part becomes 0 (the reference's default object)."""
    s = F.from_json(_c(c), WEATHER_SCHEMA)
    return F.struct(*[F.coalesce(s[f], F.lit(d)).alias(f)
                      for f, d in zip(("temperature", "humidity", "wind"), WEATHER_DEFAULT)])


def weather_to_json(temperature: Column | str = "temperature",
                    humidity: Column | str = "humidity",
                    wind: Column | str = "wind") -> Column:
    """The weather document {"temperature":..,"humidity":..,"wind":..}."""
    return F.to_json(F.struct(_c(temperature).alias("temperature"),
                              _c(humidity).alias("humidity"), _c(wind).alias("wind")))


def to_text(c: Column | str) -> Column:
    """Double / boolean -> payload text."""
    return _c(c).cast("string")


def topic(prefix: str, suffix: str) -> Column:
    """Topic name prefix + '/' + suffix."""
    return F.lit(f"{prefix}/{suffix}")


def round_half_up2(c: Column | str) -> Column:
    """P10: round to 2 places, halves toward +infinity (JS Math.round).  NaN,
    infinities and values too large for decimals (2^53 / 100) pass unchanged."""
    x = _c(c)
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0 ** 53 / 100), x).otherwise(F.floor(x * 100 + 0.5) / 100)


def weather_factor(temperature: Column | str = "temperature",
                   humidity: Column | str = "humidity",
                   wind: Column | str = "wind") -> Column:
    """round2(1*T + 0.1*H + 0.2*W)."""
    _, wt, wh, ww = DEFAULT_WEIGHTS
    return round_half_up2(_c(temperature) * wt + _c(humidity) * wh + _c(wind) * ww)


def active_low(enabled: Column | str) -> Column:
    """Output pin level is the negation of 'enabled'."""
    return ~_c(enabled)


def device_hex(addr: Column | str) -> Column:
    """Byte address -> lower-case hex, two digits per byte."""
    return F.lower(F.hex(_c(addr)))


def time_label(ts: Column | str) -> Column:
    """Chart axis label HH:mm:ss."""
    return F.date_format(_c(ts), "HH:mm:ss")


def linear_model(features, weights, intercept: float | Column = 0.0) -> Column:
    """M1 for any number of features: dot(weights, features) + intercept,
    evaluated left to right."""
    out = None
    for c, w in zip(features, weights, strict=True):
        term = _c(c) * (w if isinstance(w, Column) else F.lit(w))
        out = term if out is None else out + term
    if isinstance(intercept, Column) or intercept != 0.0:
        out = out + (intercept if isinstance(intercept, Column) else F.lit(intercept))
    return out


def linear_forecast(tank: Column | str, temp: Column | str, hum: Column | str,
                    wind: Column | str, weights=DEFAULT_WEIGHTS,
                    intercept: float | Column = 0.0) -> Column:
    """M1 of the four features."""
    return linear_model((tank, temp, hum, wind), weights, intercept)
