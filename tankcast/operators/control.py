"""Gateway control: held state on a tick grid and the two threshold rules.

The gateway keeps the newest tank temperature, forecast and both thresholds
and, every tick, switches the boiler on when the tank is colder than its
threshold and the utility on when the forecast is hotter than its threshold.
Here that is an as-of join of four message series onto a per-site tick grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankcast.functions.payload import active_low, parse_double
from tankcast.operators.segmented import DEFAULT_SEGMENT, asof_fill
from tankcast.operators.windows import _seconds

# Held-state series (topic suffix -> column) and initial values.
HELD_SERIES = {
    "tank/temperature": "tank_temperature",
    "tank/forecast": "tank_forecast",
    "boiler/threshold/set": "boiler_threshold",
    "utility/threshold/set": "utility_threshold",
}
INITIAL_STATE = {
    "tank_temperature": 0.0,
    "tank_forecast": 0.0,
    "boiler_threshold": 45.0,
    "utility_threshold": 60.0,
}
STATUS_EVERY = 6  # full status on every 6th tick

TICKS_PER_CHUNK = 4096


def tick_grid(events: DataFrame, keys: Sequence[str], ts: str = "ts", tick: str = "1 hour",
              ticks_per_chunk: int = TICKS_PER_CHUNK) -> DataFrame:
    """W1 grid: per key, ticks from the tick-aligned first event to the last
    event, with their 0-based ``tick_index``.

    Bounds are a partial aggregate (one row per key).  The grid is generated
    in two steps -- chunk starts, then ticks inside each chunk -- and the
    chunk rows are hash-partitioned before the second explode, so a key with
    millions of ticks is spread over many tasks.
    """
    keys = list(keys)
    step = _seconds(tick)
    chunk = step * ticks_per_chunk
    bounds = (events.groupBy(*keys)
              .agg(F.min(ts).alias("__lo"), F.max(ts).alias("__hi"))
              .withColumn("grid_start", F.window("__lo", tick).start))
    chunks = bounds.select(
        *keys, "grid_start", "__hi",
        F.posexplode(F.expr(f"sequence(grid_start, __hi, make_dt_interval(0, 0, 0, {chunk}))"))
        .alias("__ci", "__cs"))
    chunks = chunks.repartition(*keys, "__ci")
    last = F.least(F.col("__hi"), F.col("__cs") + F.expr(
        f"make_dt_interval(0, 0, 0, {step * (ticks_per_chunk - 1)})"))
    grid = chunks.select(
        *keys, "grid_start", "__ci",
        F.posexplode(F.sequence(F.col("__cs"), last,
                                F.expr(f"make_dt_interval(0, 0, 0, {step})"))).alias("__i", "tick"))
    return grid.select(*keys, "tick",
                       (F.col("__ci") * ticks_per_chunk + F.col("__i")).cast("bigint").alias("tick_index"))


def held_state(messages: DataFrame, prefix: str, keys: Sequence[str] = ("site_id",),
               tick: str = "1 hour", series: dict | None = None,
               segment: str = DEFAULT_SEGMENT) -> DataFrame:
    """W1 + J4: the newest value of each held series as of every tick (a
    message at the tick's instant counts), or its initial value."""
    keys = list(keys)
    series = series or HELD_SERIES
    topics = {f"{prefix}/{s}": c for s, c in series.items()}
    msgs = (messages.filter(F.col("topic").isin(list(topics)))
            .select(*keys, "ts", "msg_id", "topic", parse_double("payload").alias("__v")))
    grid = tick_grid(msgs, keys, "ts", tick)
    ev = msgs.select(*keys, "ts", F.lit(0).alias("__side"), F.col("msg_id").alias("__id"),
                     F.lit(None).cast("bigint").alias("tick_index"), "topic", "__v")
    tk = grid.select(*keys, F.col("tick").alias("ts"), F.lit(1).alias("__side"),
                     F.lit(None).cast("bigint").alias("__id"), "tick_index",
                     F.lit(None).cast("string").alias("topic"),
                     F.lit(None).cast("double").alias("__v"))
    both = ev.unionByName(tk)
    fills = {c: F.when(F.col("topic") == t, F.col("__v")) for t, c in topics.items()}
    filled = asof_fill(both, keys, ["ts", "__side", "__id"], fills, segment=segment)
    return filled.filter(F.col("__side") == 1).select(
        *keys, F.col("ts").alias("tick"), "tick_index",
        *[F.coalesce(F.col(c), F.lit(INITIAL_STATE.get(c, 0.0))).alias(c) for c in topics.values()])


def apply_rules(state: DataFrame) -> DataFrame:
    """Strict threshold rules and the active-low pin levels.  A
    rule with NaN on either side is off (Spark alone ranks NaN above numbers)."""
    def numbers(*names):
        return ~F.isnan(names[0]) & ~F.isnan(names[1])

    boiler = (numbers("tank_temperature", "boiler_threshold")
              & (F.col("tank_temperature") < F.col("boiler_threshold")))
    utility = (numbers("tank_forecast", "utility_threshold")
               & (F.col("tank_forecast") > F.col("utility_threshold")))
    return (state.withColumn("boiler_enabled", boiler)
                 .withColumn("utility_enabled", utility)
                 .withColumn("boiler_pin", active_low("boiler_enabled"))
                 .withColumn("utility_pin", active_low("utility_enabled")))


def with_cadence(state: DataFrame, every: int = STATUS_EVERY) -> DataFrame:
    """The full status goes out on every ``every``-th tick (1-based).
    The grid is regular, so the tick count is arithmetic -- no window."""
    return state.withColumn("full_status", (F.col("tick_index") % every) == every - 1)


def control_state(messages: DataFrame, prefix: str, keys: Sequence[str] = ("site_id",),
                  tick: str = "1 hour", segment: str = DEFAULT_SEGMENT) -> DataFrame:
    return apply_rules(held_state(messages, prefix, keys, tick, segment=segment))


def threshold_history(messages: DataFrame, prefix: str, keys: Sequence[str] = ("site_id",),
                      segment: str = DEFAULT_SEGMENT) -> DataFrame:
    """Each accepted ``/set`` message is the effective threshold from its
    time until the next accepted one of the same series (``valid_to`` null
    while current).  The "next" is a backward segmented scan, not a window
    over the whole series."""
    keys = list(keys)
    sets = [f"{prefix}/boiler/threshold/set", f"{prefix}/utility/threshold/set"]
    m = (messages.filter(F.col("topic").isin(sets))
         .select(*keys, "topic", "ts", "msg_id", parse_double("payload").alias("threshold"))
         .filter(F.col("threshold").isNotNull()))
    nxt = asof_fill(m, [*keys, "topic"], ["ts", "msg_id"], {"valid_to": F.col("ts")},
                    segment=segment, inclusive=False, backward=True)
    return nxt.select(*keys, "topic", "msg_id", F.col("ts").alias("valid_from"), "valid_to",
                      "threshold")


def control_on_messages(messages: DataFrame, prefix: str, keys: Sequence[str] = ("site_id",),
                        segment: str = DEFAULT_SEGMENT) -> DataFrame:
    """The gateway's state and rules right after every accepted control
    message (the batch twin of the live control stream)."""
    keys = list(keys)
    topics = {f"{prefix}/{s}": c for s, c in HELD_SERIES.items()}
    msgs = (messages.filter(F.col("topic").isin(list(topics)))
            .select(*keys, "ts", "msg_id", "topic", parse_double("payload").alias("__v"))
            .filter(F.col("__v").isNotNull()))
    fills = {c: F.when(F.col("topic") == t, F.col("__v")) for t, c in topics.items()}
    filled = asof_fill(msgs, keys, ["ts", "msg_id"], fills, segment=segment)
    state = filled.select(*keys, "ts", "msg_id",
                          *[F.coalesce(F.col(c), F.lit(INITIAL_STATE[c])).alias(c)
                            for c in topics.values()])
    return apply_rules(state)
