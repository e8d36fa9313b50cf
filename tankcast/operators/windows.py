"""Event-time window aggregates: newest row per window, sliding first/last,
latest value per key.

All are hash aggregates with a partial (map-side) step, so a hot key is
combined before the shuffle.  "Newest" is decided by (ts, id), never by
arrival order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ord(ts: str, id_col: str):
    return F.struct(F.col(ts), F.col(id_col))


def last_in_window(df: DataFrame, keys: Sequence[str], ts: str, id_col: str,
                   width: str = "5 seconds", cols: Sequence[str] | None = None) -> DataFrame:
    """A1: per key and tumbling window, the newest row (ties: larger id).

    Output: keys, window_start, window_end, then the row's columns.
    """
    keys = list(keys)
    cols = [c for c in (cols or df.columns) if c not in keys]
    row = F.struct(*[F.col(c) for c in cols])
    agg = (df.groupBy(*keys, F.window(F.col(ts), width).alias("w"))
             .agg(F.max_by(row, _ord(ts, id_col)).alias("__last")))
    return agg.select(*keys, F.col("w.start").alias("window_start"),
                      F.col("w.end").alias("window_end"),
                      *[F.col(f"__last.{c}").alias(c) for c in cols])


def sliding_first_last(df: DataFrame, keys: Sequence[str], ts: str, id_col: str,
                       value: str, length: str = "3 hours", slide: str = "30 minutes",
                       panes_per_window: int | None = None) -> DataFrame:
    """A2: per key and sliding window, the newest and the oldest row.

    Rows are first reduced to one summary per (key, pane) -- a pane is one
    slide long -- and only those summaries are copied into the
    ``length/slide`` windows containing them, so the raw data is never
    expanded.  Output: keys, window_start, window_end, n, newest/oldest
    ts, id and value.
    """
    keys = list(keys)
    k = panes_per_window or _ratio(length, slide)
    ordk = _ord(ts, id_col)
    row = F.struct(F.col(ts).alias("ts"), F.col(id_col).alias("id"), F.col(value).alias("v"))
    panes = (df.groupBy(*keys, F.window(F.col(ts), slide).start.alias("pane"))
               .agg(F.count(F.lit(1)).alias("n"),
                    F.max_by(row, ordk).alias("newest"),
                    F.min_by(row, ordk).alias("oldest")))
    expanded = panes.select(
        *keys, "n", "newest", "oldest",
        F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("__i"), "pane")
    expanded = expanded.withColumn(
        "window_start", F.col("pane") - F.make_dt_interval(
            secs=F.col("__i") * F.lit(_seconds(slide))))
    agg = expanded.groupBy(*keys, "window_start").agg(
        F.sum("n").alias("n"),
        F.max_by("newest", F.struct(F.col("newest.ts"), F.col("newest.id"))).alias("nw"),
        F.min_by("oldest", F.struct(F.col("oldest.ts"), F.col("oldest.id"))).alias("od"))
    return agg.select(
        *keys, "window_start",
        (F.col("window_start") + F.make_dt_interval(secs=F.lit(_seconds(length)))).alias("window_end"),
        F.col("n").cast("bigint").alias("n"),
        F.col("nw.ts").alias("newest_ts"), F.col("nw.id").alias("newest_id"),
        F.col("nw.v").alias("newest_value"),
        F.col("od.ts").alias("oldest_ts"), F.col("od.id").alias("oldest_id"),
        F.col("od.v").alias("oldest_value"))


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str, id_col: str,
                   cols: Sequence[str]) -> DataFrame:
    """A3: the newest value(s) per key (e.g. per site and topic)."""
    keys = list(keys)
    row = F.struct(F.col(ts), F.col(id_col), *[F.col(c) for c in cols])
    agg = df.groupBy(*keys).agg(F.max_by(row, _ord(ts, id_col)).alias("__l"),
                                F.count(F.lit(1)).alias("n_messages"))
    return agg.select(*keys, *[F.col(f"__l.{c}").alias(c) for c in [ts, id_col, *cols]],
                      "n_messages")


_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def _seconds(duration: str) -> int:
    n, unit = duration.strip().split()
    unit = unit.lower().rstrip("s")
    return int(n) * _UNITS[unit]


def _ratio(length: str, slide: str) -> int:
    a, b = _seconds(length), _seconds(slide)
    if a % b:
        raise ValueError("window length must be a multiple of the slide")
    return a // b
