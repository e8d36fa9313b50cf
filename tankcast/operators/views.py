"""Dashboard data views: bounded chart history and clear events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tankcast.functions.payload import time_label
from tankcast.operators.segmented import DEFAULT_SEGMENT, asof_fill
from tankcast.operators.windows import _seconds


def history_window(df: DataFrame, series: Sequence[str], ts: str, id_col: str,
                   max_points: int = 100, max_age: str = "1 hour") -> DataFrame:
    """Per series, the newest ``max_points`` points no older than
    ``max_age`` before the series' newest point; points without a time are left
    out, a null key is a series of its own.

    Ranking comes first, so Spark's per-partition group limit sends at most k
    rows per series and map task; the newest time is then read off the points
    that remain, in the same partitions, and the age filter cuts only the tail
    of the ranking.
    """
    series = list(series)
    w = Window.partitionBy(*series).orderBy(F.col(ts).desc(), F.col(id_col).desc())
    age = F.expr(f"make_dt_interval(0, 0, 0, {_seconds(max_age)})")
    newest = F.first(ts).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (df.filter(F.col(ts).isNotNull())
              .withColumn("point_rank", F.row_number().over(w).cast("bigint"))
              .filter(F.col("point_rank") <= max_points)
              .withColumn("__max_ts", newest)
              .filter(F.col(ts) >= F.col("__max_ts") - age).drop("__max_ts")
              .withColumn("time_label", time_label(ts)))


def history_after_clear(df: DataFrame, series: Sequence[str], ts: str, clear: str,
                        id_col: str, segment: str = DEFAULT_SEGMENT) -> DataFrame:
    """A clear event empties the series, so only points after the last clear
    in order of (time, id) remain (all points when a series was never cleared).

    "Is there a clear at or after this row" is a backward segmented scan, so a
    hot series is spread over its time segments."""
    flag = F.when(F.col(clear), F.lit(True))
    seen = asof_fill(df, series, [ts, id_col], {"__cleared": flag}, segment=segment, backward=True)
    return seen.filter(F.col("__cleared").isNull()).drop("__cleared")
