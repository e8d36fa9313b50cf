"""The forecast plan: newest tank reading per device and 5 s window, enriched
with the weather current at that reading, scored by the linear model."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tankcast.functions.payload import DEFAULT_WEIGHTS
from tankcast.operators.forecast import enrich_with_weather, predict, tank_readings
from tankcast.operators.segmented import DEFAULT_SEGMENT
from tankcast.operators.windows import last_in_window
from tankcast.sources.fixtures import DEFAULT_PREFIX


def newest_readings(messages: DataFrame, prefix: str = DEFAULT_PREFIX,
                    width: str = "5 seconds") -> DataFrame:
    """A1 over parsed tank readings, keyed by device (the forecast's first
    step, also usable on its own)."""
    r = tank_readings(messages, prefix)
    return last_in_window(r, ["device_id"], "ts", "msg_id", width,
                          cols=["site_id", "ts", "msg_id", "tank_temperature"])


def forecast(messages: DataFrame, weather: DataFrame, prefix: str = DEFAULT_PREFIX,
             width: str = "5 seconds", weights=DEFAULT_WEIGHTS, intercept: float = 0.0,
             segment: str = DEFAULT_SEGMENT) -> DataFrame:
    """Newest reading per device and window (A1), enriched with the weather
    current at that reading (J1), scored (M1).

    Enrichment is one-to-one and keeps (ts, id), so choosing the newest reading
    first gives the same rows as the reference's enrich-then-window order, and
    the as-of join sees one row per window instead of every reading (about 5x
    fewer at 1 Hz).  The raw readings cover every window's segment, so the
    join's segment summary reads that scan rather than recomputing the window
    aggregate."""
    readings = tank_readings(messages, prefix)
    newest = last_in_window(readings, ["device_id"], "ts", "msg_id", width,
                            cols=["site_id", "ts", "msg_id", "tank_temperature"])
    enriched = enrich_with_weather(newest, weather, segment=segment, readings_cover=readings)
    return predict(enriched, weights, intercept)
