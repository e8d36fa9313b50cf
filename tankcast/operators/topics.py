"""Topic filters and routing (F1, F2, F4, F5, P15) and publishing.

Everything is a column predicate or projection: filters on ``topic`` reach the
parquet scan as pushed filters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tankcast.functions.payload import to_text

# The eight dashboard routes, in matching order.
DASHBOARD_ROUTES = (
    "tank/temperature",
    "tank/forecast",
    "boiler/enabled",
    "boiler/threshold",
    "boiler/threshold/set",
    "utility/enabled",
    "utility/threshold",
    "utility/threshold/set",
)
# The topics the gateway reacts to (first match wins); use with
# ``route(df, prefix, GATEWAY_ROUTES)``.
GATEWAY_ROUTES = ("tank/forecast", "boiler/threshold/set", "utility/threshold/set")


def exact_topics(df: DataFrame, prefix: str, suffixes: Sequence[str],
                 col: str = "topic") -> DataFrame:
    """subscription to exact topics (an IN filter, pushed to the scan)."""
    return df.filter(F.col(col).isin([f"{prefix}/{s}" for s in suffixes]))


def in_subtree(col: Column | str, root: str) -> Column:
    """``root/#`` -- the root itself and every level below it, but not a
    sibling that merely shares the prefix (``site2/x`` is not under ``site``)."""
    c = F.col(col) if isinstance(col, str) else col
    return (c == F.lit(root)) | c.startswith(root + "/")


def subtree(df: DataFrame, root: str, col: str = "topic") -> DataFrame:
    return df.filter(in_subtree(col, root))


def route(df: DataFrame, prefix: str, routes: Sequence[str] = DASHBOARD_ROUTES,
          col: str = "topic", out: str = "route") -> DataFrame:
    """first matching route (1-based index and its suffix); unmatched
    messages are dropped.  Consumers then filter on ``route`` or a sink
    writes with ``partitionBy(route)``."""
    idx = None
    for i, s in enumerate(routes, start=1):
        cond = F.col(col) == F.lit(f"{prefix}/{s}")
        idx = F.when(cond, F.lit(i)) if idx is None else idx.when(cond, F.lit(i))
    names = F.array(*[F.lit(s) for s in routes])
    return (df.withColumn(out + "_index", idx)
              .filter(F.col(out + "_index").isNotNull())
              .withColumn(out, F.element_at(names, F.col(out + "_index"))))


def command_guard(df: DataFrame, prefix: str, widget_col: str, incoming_topic: str,
                  out: str = "topic") -> DataFrame:
    """F5 + P15: a value becomes a command only when it arrives without a topic
    (typed by a user, not echoed by the broker); it is then tagged with the
    ``/set`` topic of its widget (``boiler`` or ``utility``)."""
    return (df.filter(F.col(incoming_topic).isNull())
              .withColumn(out, F.concat(F.lit(prefix + "/"), F.col(widget_col),
                                        F.lit("/threshold/set"))))


def publish(df: DataFrame, prefix: str, suffix: str, value: str, ts: str = "ts",
            key_cols: Sequence[str] = ()) -> DataFrame:
    """Rows to publish -- (keys..., topic, payload, ts) with the value as
    text.  A sink (``streaming.sinks``) writes them; an empty batch writes
    nothing."""
    return df.select(*key_cols, F.lit(f"{prefix}/{suffix}").alias("topic"),
                     to_text(value).alias("payload"), F.col(ts).alias("ts"))


# The status series the gateway publishes, (suffix, column).
STATUS_SERIES = (
    ("tank/temperature", "tank_temperature"),
    ("boiler/enabled", "boiler_enabled"),
    ("boiler/threshold", "boiler_threshold"),
    ("utility/enabled", "utility_enabled"),
    ("utility/threshold", "utility_threshold"),
)


def publish_status(state: DataFrame, prefix: str, ts: str = "tick",
                   key_cols: Sequence[str] = ("site_id",),
                   full_col: str = "full_status") -> DataFrame:
    """S3: melt each status row into topic rows.  The temperature goes out
    every tick; the other four only on rows where ``full_col`` is true."""
    pairs = ", ".join(f"'{prefix}/{s}', CAST({c} AS STRING), {('true' if s == 'tank/temperature' else full_col)}"
                      for s, c in STATUS_SERIES)
    melted = state.selectExpr(*key_cols, ts,
                              f"stack({len(STATUS_SERIES)}, {pairs}) AS (topic, payload, __send)")
    return melted.filter("__send").select(*key_cols, F.col(ts).alias("ts"), "topic", "payload")
