"""Structured Streaming versions of the forecast, control, change-only and
training flows (T1-T6).

* Event time with a watermark (default 10 minutes; later rows are dropped),
  not processing time.
* Windowed aggregates run in append mode: a window is emitted once, when the
  watermark passes its end, so every downstream step sees final rows.
* Flows over an ordered series (held values, extremes, samples, chart history,
  training) compute a micro-batch with the batch operators, whose scans split a
  busy key by time.  What a key hands to the next batch (its newest value, its
  extremes, its last sample, at most k points, its model and last panes) is a
  small table under the checkpoint (``_carried``), rewritten each batch, so that
  a batch reads as much as its keys need and never its own history.
* Flows with event-time timers are in ``tankcast.streaming.stateful``.
* Every query has a checkpoint under the shared ``spark.checkpoint.dir``;
  ``foreachBatch`` sinks write per ``batch_id`` so a replay is idempotent.
* A micro-batch is computed once: flows that use its rows several times write
  them first (``sinks.staged``) and go on from the written rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from tankcast.functions.payload import DEFAULT_WEIGHTS, parse_double
from tankcast.operators import control as C
from tankcast.operators import training as M
from tankcast.operators.forecast import enrich_with_weather, predict, quarantine
from tankcast.operators.sampling import min_interval_sample
from tankcast.operators.segmented import asof_fill, running_extremes_since_reset
from tankcast.operators.sensors import change_only
from tankcast.operators.topics import publish
from tankcast.operators.views import history_window
from tankcast.operators.windows import last_in_window
from tankcast.session import scratch_path, ship_package
from tankcast.streaming.sinks import staged, write_batch
from tankcast.streaming.sources import to_ntz

WATERMARK = "10 minutes"
TRIGGER = "1 second"  # the reference's micro-batch interval


def _start(df: DataFrame, name: str, checkpoint: str | None, trigger: dict | None,
           output_mode: str = "append", batch_fn=None, sink=None) -> StreamingQuery:
    spark = df.sparkSession
    ship_package(spark)
    w = (df.writeStream.outputMode(output_mode).queryName(name)
         .option("checkpointLocation", checkpoint or scratch_path(spark, f"streams/{name}")))
    w = w.trigger(**(trigger or {"processingTime": TRIGGER}))
    if batch_fn is not None:
        w = w.foreachBatch(batch_fn)
    elif sink is not None:
        w = sink(w)
    return w.start()


def _base(df: DataFrame, checkpoint: str | None, name: str) -> str:
    return checkpoint or scratch_path(df.sparkSession, f"streams/{name}")


def _carried(spark: SparkSession, checkpoint: str, batch_id: int, schema: str, name: str = "carried") -> DataFrame:
    """What the batch before handed on; nothing, for the first one.  The tables
    lie in two folders taken in turn: a replayed batch overwrites its own and
    still finds that of its predecessor, so every batch must hand one on."""
    if not batch_id:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{checkpoint.rstrip('/')}/{name}/batch_id={(batch_id - 1) % 2}")


def _carry(df: DataFrame, checkpoint: str, batch_id: int, name: str = "carried") -> None:
    write_batch(df, f"{checkpoint.rstrip('/')}/{name}", batch_id % 2)


def _readings(messages: DataFrame, prefix: str) -> DataFrame:
    return (messages.filter(F.col("topic") == f"{prefix}/tank/temperature")
            .select("msg_id", "device_id", "site_id", "ts",
                    parse_double("payload").alias("tank_temperature"))
            .filter(F.col("tank_temperature").isNotNull()))


WEATHER_LOOKBACK = "1 day"


def _current(weather: DataFrame | Callable[[], DataFrame]) -> DataFrame:
    """The weather table as it is now: a callable is asked again each batch, so
    files added after the start are seen; a DataFrame keeps its first file list."""
    return weather() if callable(weather) else weather


def _enrich_batch(df: DataFrame, weather: DataFrame,
                  lookback: str = WEATHER_LOOKBACK) -> tuple[DataFrame, DataFrame]:
    """As-of weather for one micro-batch without re-reading the weather
    history: only weather in [batch start - lookback, batch end] is read
    (pushed to the scan, pruned by date partitions).  Readings with no weather
    in that window -- rare once a site reports -- are enriched from the older
    history instead, so the result equals the full as-of join."""
    lo, hi = df.agg(F.min("ts"), F.max("ts")).first()  # of the staged batch: file statistics
    start = F.lit(lo) - F.expr(f"make_dt_interval(0, 0, 0, {M._seconds(lookback)})")
    recent = weather.filter((F.col("ts") >= start) & (F.col("ts") <= F.lit(hi)))
    enriched = enrich_with_weather(df, recent).persist()
    missing = enriched.filter(~F.col("weather_found"))
    if missing.isEmpty():
        return enriched, enriched
    older = weather.filter(F.col("ts") < start)
    refill = enrich_with_weather(missing.select(*df.columns), older)
    return enriched.filter(F.col("weather_found")).unionByName(refill), enriched


# --- T5: forecast ---------------------------------------------------------------

def forecast_stream(messages: DataFrame, weather: DataFrame | Callable[[], DataFrame], out_path: str,
                    prefix: str = "site", width: str = "5 seconds", watermark: str = WATERMARK,
                    weights=DEFAULT_WEIGHTS, checkpoint: str | None = None,
                    trigger: dict | None = None, name: str = "forecast",
                    models_path: str | None = None,
                    weather_lookback: str = WEATHER_LOOKBACK) -> StreamingQuery:
    """Newest reading per device and window (A1, on the stream), then -- per
    micro-batch, on final windows only -- weather as of the reading (J1),
    the forecast (M1), and the publish rows (S2).  With ``models_path`` (the
    model table a training stream writes) each window is scored with the
    newest model version of its site (M3); before the first one, ``weights``.
    A batch reads the model batches that came since the one before, not their history."""
    spark, checkpoint = messages.sparkSession, _base(messages, checkpoint, name)
    r = _readings(messages, prefix).withWatermark("ts", watermark)
    newest = last_in_window(r, ["device_id"], "ts", "msg_id", width,
                            cols=["site_id", "ts", "msg_id", "tank_temperature"])

    def batch(df: DataFrame, batch_id: int) -> None:
        df = staged(to_ntz(df, "ts", "window_start", "window_end"), f"{out_path}/windows", batch_id)
        models = _scoring_models(df, models_path, checkpoint, batch_id) if models_path else None
        if df.isEmpty():
            return
        enriched, held = _enrich_batch(df, _current(weather), weather_lookback)
        if models is not None:
            pred = M.forecast_with_models(enriched, models, ["site_id"], initial=weights)
        else:
            pred = predict(enriched, weights)
        pred = pred.persist()
        write_batch(pred, f"{out_path}/forecast", batch_id)
        write_batch(publish(pred, prefix, "tank/forecast", "forecast", key_cols=["device_id"]),
                    f"{out_path}/publish", batch_id)
        pred.unpersist()
        held.unpersist()

    return _start(newest, name, checkpoint, trigger, batch_fn=batch)


VERSIONS = ("site_id int, version_ts timestamp_ntz, " + ", ".join(f"{w} double" for w in M.WEIGHTS[:len(M.FEATURES)])
            + ", intercept double, batch_id int")


def _scoring_models(windows: DataFrame, models_path: str, checkpoint: str, batch_id: int) -> DataFrame:
    """The model versions that ``windows`` or later ones can need: each site's
    newest one published by the first end of ``windows``, and all after it.

    They are handed on from batch to batch.  Of the model table only the training
    batches from the newest one known are read: that one again, as it may have
    been half written.  Windows come by their ends, so a version that is older
    than the newest one at the first end is never needed again."""
    spark, columns = windows.sparkSession, [c.split()[0] for c in VERSIONS.split(", ")]
    held = None
    if batch_id:
        held = _read_or_none(spark, f"{checkpoint.rstrip('/')}/versions/batch_id={(batch_id - 1) % 2}",
                             VERSIONS.replace("batch_id", "trained"))
    if held is None:  # the first batch, or one that goes on from batches without models
        held = spark.createDataFrame([], VERSIONS.replace("batch_id", "trained"))
    lo = windows.agg(F.min("window_end")).first()[0]  # of the staged batch: file statistics
    known = held.agg(F.max("trained")).first()[0]
    found = None if lo is None else _read_or_none(spark, models_path, VERSIONS)
    if found is not None:
        found = found if known is None else found.filter(F.col("batch_id") >= known)
        held = held.unionByName(found.select(*columns).withColumnRenamed("batch_id", "trained"))
        row = F.struct(*[c for c in held.columns if c not in ("site_id", "version_ts")])
        held = (held.groupBy("site_id", "version_ts").agg(F.max_by(row, "trained").alias("v"))
                .select("site_id", "version_ts", "v.*"))
        by_first = F.max(F.when(F.col("version_ts") <= F.lit(lo), F.col("version_ts"))).over(Window.partitionBy("site_id"))
        held = (held.withColumn("by_first", by_first)
                .filter(F.col("by_first").isNull() | (F.col("version_ts") >= F.col("by_first"))).drop("by_first"))
    return staged(held, f"{checkpoint.rstrip('/')}/versions", batch_id % 2)


# --- A2 on a stream: sliding newest/oldest -------------------------------------------

def sliding_stream(messages: DataFrame, out_path: str, prefix: str = "site",
                   length: str = "3 hours", slide: str = "30 minutes",
                   watermark: str = WATERMARK, checkpoint: str | None = None,
                   trigger: dict | None = None, name: str = "sliding") -> StreamingQuery:
    """Newest and oldest tank reading per site and sliding window, emitted once
    per window when the watermark passes its end (T2).

    Two stateful operators in a row: a reading enters one pane, as long as the
    slide; a final pane (a row) enters the windows that hold it.  State is a row
    an open pane and window, and readings are never copied."""
    r = _readings(messages, prefix).withWatermark("ts", watermark)
    row = F.struct(F.col("ts").alias("ts"), F.col("msg_id").alias("id"), F.col("tank_temperature").alias("v"))
    panes = (r.groupBy("site_id", F.window("ts", slide).alias("p"))
             .agg(F.count(F.lit(1)).alias("n"), F.max_by(row, F.struct("ts", "msg_id")).alias("newest"),
                  F.min_by(row, F.struct("ts", "msg_id")).alias("oldest")))
    agg = (panes.groupBy("site_id", F.window(F.window_time("p"), length, slide).alias("w"))
           .agg(F.sum("n").alias("n"), F.max_by("newest", F.struct("newest.ts", "newest.id")).alias("nw"),
                F.min_by("oldest", F.struct("oldest.ts", "oldest.id")).alias("od")))
    out = agg.select("site_id", F.col("w.start").alias("window_start"),
                     F.col("w.end").alias("window_end"), "n",
                     F.col("nw.ts").alias("newest_ts"), F.col("nw.id").alias("newest_id"),
                     F.col("nw.v").alias("newest_value"), F.col("od.ts").alias("oldest_ts"),
                     F.col("od.id").alias("oldest_id"), F.col("od.v").alias("oldest_value"))

    def batch(df: DataFrame, batch_id: int) -> None:
        write_batch(to_ntz(df, "window_start", "window_end", "newest_ts", "oldest_ts"),
                    out_path, batch_id)

    return _start(out, name, checkpoint, trigger, batch_fn=batch)


# --- A4 and W4 on a stream: per-device running state ---------------------------------

EXTREMES = "device_id bigint, mn double, mx double, ep bigint"
SAMPLED = "device_id bigint, last timestamp_ntz"


def extremes_stream(values: DataFrame, out_path: str, checkpoint: str | None = None,
                    trigger: dict | None = None, name: str = "extremes") -> StreamingQuery:
    """A4 live: ``values`` is streaming (device_id, ts, msg_id, value, is_reset).

    A device hands on its (min, max, resets so far).  In the next batch these are
    two rows before all others, the minimum counting as so many resets and the
    maximum as none, and the batch operator goes on from them by its own rules
    (a maximum of NaN stays)."""
    spark, checkpoint = values.sparkSession, _base(values, checkpoint, name)
    v = values.select("device_id", "ts", "msg_id", F.col("value").cast("double").alias("value"), "is_reset")

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = staged(to_ntz(df, "ts").withColumns({"side": F.lit(1), "resets": F.coalesce(F.col("is_reset").cast("int"), F.lit(0))}),
                      f"{checkpoint}/rows", batch_id % 2)
        before = _carried(spark, checkpoint, batch_id, EXTREMES).select(
            "device_id", F.posexplode(F.array(F.struct(F.col("mn").alias("value"), F.col("ep").alias("resets")),
                                              F.struct(F.col("mx").alias("value"), F.lit(0).cast("bigint").alias("resets")))))
        before = before.select("device_id", F.col("pos").cast("bigint").alias("msg_id"), "col.value",
                               F.col("col.resets").cast("int").alias("resets"), F.lit(0).alias("side"))
        out = running_extremes_since_reset(rows.unionByName(before, allowMissingColumns=True), ["device_id"],
                                           ["ts", "side", "msg_id"], "value", "resets")
        out = staged(out, f"{checkpoint}/out", batch_id % 2)  # the carried rows and the result come from one scan
        write_batch(out.filter("side = 1").drop("side", "resets"), out_path, batch_id)
        last = F.struct(F.col("min_since_reset").alias("mn"), F.col("max_since_reset").alias("mx"), F.col("reset_epoch").alias("ep"))
        _carry(out.groupBy("device_id").agg(F.max_by(last, F.struct("side", "ts", "msg_id")).alias("l")).select("device_id", "l.*"),
               checkpoint, batch_id)

    return _start(v, name, checkpoint, trigger, batch_fn=batch)


def sample_stream(values: DataFrame, out_path: str, interval: str = "5 seconds",
                  checkpoint: str | None = None, trigger: dict | None = None,
                  name: str = "sample", segment: str | None = None) -> StreamingQuery:
    """W4 live: a device hands on the time of its last kept reading.  Readings
    up to one interval after it go (late ones, too); the batch operator samples
    the rest, a busy device in parallel by segments (an hour, or one interval if
    that is longer).  Readings without a time are kept, as in batch."""
    spark, checkpoint = values.sparkSession, _base(values, checkpoint, name)
    after = F.expr(f"make_dt_interval(0, 0, 0, {M._seconds(interval)})")
    v = values.select("device_id", "ts", "msg_id", F.col("value").cast("double").alias("value"))
    segment = segment or f"{max(3600, M._seconds(interval))} seconds"

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = staged(to_ntz(df, "ts").withColumn("side", F.lit(1)), f"{checkpoint}/rows", batch_id % 2)
        before = _carried(spark, checkpoint, batch_id, SAMPLED)
        both = rows.unionByName(before.withColumn("side", F.lit(0)), allowMissingColumns=True)
        known = asof_fill(both, ["device_id"], ["ts", "side", "msg_id"], {"held": "last"}).filter("side = 1")
        due = known.filter(F.col("held").isNull() | F.col("ts").isNull() | (F.col("ts") > F.col("held") + after))
        kept = min_interval_sample(due.select("device_id", "ts", "msg_id", "value"), ["device_id"], "ts", "msg_id",
                                   interval, segment)
        kept = staged(kept, out_path, batch_id)
        _carry(kept.select("device_id", F.col("ts").alias("last")).unionByName(before)
               .groupBy("device_id").agg(F.max("last").alias("last")), checkpoint, batch_id)

    return _start(v, name, checkpoint, trigger, batch_fn=batch)


# --- A3 on a stream: latest value per topic -----------------------------------------

def latest_stream(messages: DataFrame, out_path: str, checkpoint: str | None = None,
                  trigger: dict | None = None, name: str = "latest") -> StreamingQuery:
    """Newest payload per (site, topic), in update mode: each micro-batch
    writes the keys whose newest value changed (gauges and status texts).
    State is one row per key."""
    row = F.struct(F.col("ts"), F.col("msg_id"), F.col("payload"))
    agg = (messages.groupBy("site_id", "topic")
           .agg(F.max_by(row, F.struct("ts", "msg_id")).alias("l"),
                F.count(F.lit(1)).alias("n_messages")))
    out = agg.select("site_id", "topic", F.col("l.ts").alias("ts"), F.col("l.msg_id").alias("msg_id"),
                     F.col("l.payload").alias("payload"), "n_messages")

    def batch(df: DataFrame, batch_id: int) -> None:
        write_batch(to_ntz(df, "ts"), out_path, batch_id)

    return _start(out, name, checkpoint, trigger, output_mode="update", batch_fn=batch)


# --- W3 on a stream: live chart history ---------------------------------------------

POINTS = "site_id int, topic string, ts timestamp_ntz, msg_id bigint, value double"


def history_stream(messages: DataFrame, out_path: str, max_points: int = 100,
                   max_age: str = "1 hour", checkpoint: str | None = None,
                   trigger: dict | None = None, name: str = "history") -> StreamingQuery:
    """W3 live: a series (site, topic) hands on its at most ``max_points`` newest
    points within ``max_age`` of the newest one.  They and the batch's points are
    ranked by the batch operator, whose group limit lets at most that many rows
    of a series leave a task.  Every micro-batch emits the chart of the series
    that it touched (the newest batch_id per series is the chart)."""
    spark, checkpoint = messages.sparkSession, _base(messages, checkpoint, name)
    vals = (messages.select("site_id", "topic", "ts", "msg_id", parse_double("payload").alias("value"))
            .filter(F.col("value").isNotNull()))

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = staged(to_ntz(df, "ts"), f"{checkpoint}/rows", batch_id % 2)
        points = rows.unionByName(_carried(spark, checkpoint, batch_id, POINTS))
        chart = history_window(points, ["site_id", "topic"], "ts", "msg_id", max_points, max_age)
        chart = staged(chart, f"{checkpoint}/charts", batch_id % 2)
        _carry(chart.select("site_id", "topic", "ts", "msg_id", "value"), checkpoint, batch_id)
        touched = rows.select("site_id", "topic").distinct()
        write_batch(chart.join(touched, chart["site_id"].eqNullSafe(touched["site_id"])
                               & chart["topic"].eqNullSafe(touched["topic"]), "left_semi"), out_path, batch_id)

    return _start(vals, name, checkpoint, trigger, batch_fn=batch)


# --- P2 on a stream: quarantine ---------------------------------------------------------

def quarantine_stream(messages: DataFrame, out_path: str, checkpoint: str | None = None,
                      trigger: dict | None = None, name: str = "quarantine") -> StreamingQuery:
    """Messages whose payload is present but not a number, kept aside instead
    of failing the task (stateless, append)."""
    bad = quarantine(messages)

    def batch(df: DataFrame, batch_id: int) -> None:
        write_batch(to_ntz(df, "ts"), out_path, batch_id)

    return _start(bad, name, checkpoint, trigger, batch_fn=batch)


def _held_before(rows: DataFrame, keys: list[str], checkpoint: str, batch_id: int) -> DataFrame:
    """The micro-batch's ``rows`` (``ts``, ``msg_id``, ``value`` without nulls)
    and, ordered in front of them by ``__side`` = 0 and a null time, the newest
    value of each key from the batches before.  The newest values after this
    batch are written for the next one.

    Rows and values lie in two folders each under the checkpoint, taken in turn:
    a replayed batch overwrites its own and still finds those of its predecessor."""
    spark, base = rows.sparkSession, f"{checkpoint.rstrip('/')}/held"
    rows = staged(rows.withColumn("__side", F.lit(1)), f"{base}/rows", batch_id % 2)
    if batch_id:
        schema = T.StructType([f for f in rows.schema.fields if f.name in (*keys, "value")])
        before = spark.read.schema(schema).parquet(f"{base}/values/batch_id={(batch_id - 1) % 2}")
        rows = rows.unionByName(before.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    newest = rows.groupBy(*keys).agg(F.max_by("value", F.struct("__side", "ts", "msg_id")).alias("value"))
    write_batch(newest, f"{base}/values", batch_id % 2)
    return rows


# --- T6: gateway control on live messages -----------------------------------------

def control_stream(messages: DataFrame, out_path: str, prefix: str = "site",
                   checkpoint: str | None = None, trigger: dict | None = None,
                   name: str = "control") -> StreamingQuery:
    """Held state per site, rules evaluated on every accepted control message
    (C1, C2, P12).  Within a micro-batch messages are applied in event-time
    order; a message arriving in a later batch with an older time is applied
    when it arrives, as the gateway does.  For an in-order log this equals
    ``control.control_on_messages`` in batch.  A batch is one segmented scan."""
    checkpoint = checkpoint or scratch_path(messages.sparkSession, f"streams/{name}")
    topics = {f"{prefix}/{s}": c for s, c in C.HELD_SERIES.items()}
    # parsed by the batch rules; other topics and unparsable payloads leave the state alone
    m = (messages.filter(F.col("topic").isin(list(topics)))
         .select("site_id", "ts", "msg_id", "topic", parse_double("payload").alias("value"))
         .filter(F.col("value").isNotNull()))

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = _held_before(to_ntz(df, "ts"), ["site_id", "topic"], checkpoint, batch_id)
        fills = {c: F.when(F.col("topic") == t, F.col("value")) for t, c in topics.items()}
        filled = asof_fill(rows, ["site_id"], ["ts", "__side", "msg_id"], fills).filter(F.col("__side") == 1)
        state = filled.select("site_id", "ts", "msg_id", *[
            F.coalesce(F.col(c), F.lit(C.INITIAL_STATE[c])).alias(c) for c in topics.values()])
        write_batch(C.apply_rules(state), out_path, batch_id)

    return _start(m, name, checkpoint, trigger, batch_fn=batch)


# --- F6 on a stream: emit on change ---------------------------------------------------

def change_stream(values: DataFrame, out_path: str, initial: float = 0.0,
                  checkpoint: str | None = None, trigger: dict | None = None,
                  name: str = "change") -> StreamingQuery:
    """``values``: streaming (device_id, ts, msg_id, value).  A null value
    neither goes out nor changes the held one, as in ``sensors.change_only``,
    which computes each micro-batch.  The held value only changes when a
    different one arrives, so it is always the previous reading."""
    checkpoint = checkpoint or scratch_path(values.sparkSession, f"streams/{name}")
    v = (values.filter(F.col("value").isNotNull())
         .select("device_id", "ts", "msg_id", F.col("value").cast("double").alias("value")))

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = _held_before(to_ntz(df, "ts"), ["device_id"], checkpoint, batch_id)
        out = change_only(rows, ["device_id"], ["ts", "__side", "msg_id"], "value", initial)
        write_batch(out.filter(F.col("__side") == 1).drop("__side"), out_path, batch_id)

    return _start(v, name, checkpoint, trigger, batch_fn=batch)


# --- T3: training across micro-batches ----------------------------------------------

def _read_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # anything else is an error, not "no model yet"
            raise
        return None


RECENT = "site_id int, pane timestamp_ntz, " + ", ".join(f"{c} double" for c in M.FEATURES)
MODELS = "site_id int, version_ts timestamp_ntz, state array<double>, n bigint"


def training_stream(messages: DataFrame, weather: DataFrame | Callable[[], DataFrame], out_path: str,
                    prefix: str = "site", watermark: str = WATERMARK, scale=M.FEATURE_SCALE,
                    checkpoint: str | None = None, trigger: dict | None = None,
                    name: str = "training",
                    weather_lookback: str = WEATHER_LOOKBACK) -> StreamingQuery:
    """Final 30-minute panes (newest reading each) are enriched and stored;
    each new pane is the label of the pane three hours before it; the pairs of
    a micro-batch are reduced to statistics and folded, warm-started from each
    site's model, into new versions.

    A site hands on its newest model and the panes of its last three hours, so a
    batch reads no older panes or models.  Panes and models are written under
    ``batch_id=<n>``; a replay overwrites its own, so it is idempotent."""
    spark, checkpoint = messages.sparkSession, _base(messages, checkpoint, name)
    r = _readings(messages, prefix).withWatermark("ts", watermark)
    panes = last_in_window(r, ["site_id"], "ts", "msg_id", M.PERIOD,
                           cols=["ts", "msg_id", "device_id", "tank_temperature"])
    panes_path, models_path = f"{out_path}/panes", f"{out_path}/models"
    hz = F.expr(f"make_dt_interval(0, 0, 0, {M._seconds(M.HORIZON)})")

    def batch(df: DataFrame, batch_id: int) -> None:
        df = to_ntz(df, "ts", "window_start").withColumnRenamed("window_start", "pane").drop("window_end")
        df = staged(df, f"{out_path}/windows", batch_id)
        recent = _carried(spark, checkpoint, batch_id, RECENT, "panes")
        held = _carried(spark, checkpoint, batch_id, MODELS, "models")
        if df.isEmpty():
            _carry(recent, checkpoint, batch_id, "panes")
            _carry(held, checkpoint, batch_id, "models")
            return
        new, kept = _enrich_batch(df, _current(weather), weather_lookback)
        write_batch(new, panes_path, batch_id)
        kept.unpersist()
        new = spark.read.schema(new.schema).parquet(f"{panes_path}/batch_id={batch_id}")
        known = new.select("site_id", "pane", *M.FEATURES).unionByName(recent)
        pairs = known.select("site_id", (F.col("pane") + hz).alias("label_pane"), F.col("pane").alias("feature_pane"),
                             *M.FEATURES).join(
            new.select("site_id", F.col("pane").alias("label_pane"), F.col("tank_temperature").alias("label")),
            ["site_id", "label_pane"])
        stats = M.train_statistics(pairs, ["site_id"], scale=scale)
        versions = M.train_weights(stats, ["site_id"], scale=scale, start=held, with_state=True)
        versions = staged(versions, f"{checkpoint}/versions", batch_id % 2)
        write_batch(versions.drop("state"), models_path, batch_id)
        # a pane is needed until its site has one three hours later
        newest = F.max("pane").over(Window.partitionBy("site_id"))
        _carry(known.withColumn("newest", newest).filter(F.col("pane") > F.col("newest") - hz).drop("newest"),
               checkpoint, batch_id, "panes")
        weights = [c.split()[0] for c in MODELS.split(", ")[1:]]
        _carry(versions.select("site_id", *weights).unionByName(held).groupBy("site_id")
               .agg(F.max_by(F.struct(*weights), "version_ts").alias("m")).select("site_id", "m.*"),
               checkpoint, batch_id, "models")

    return _start(panes, name, checkpoint, trigger, batch_fn=batch)


# --- T2: rows behind the watermark -----------------------------------------------------

def late_rows_stream(messages: DataFrame, out_path: str, watermark: str = WATERMARK, checkpoint: str | None = None,
                     trigger: dict | None = None, name: str = "late-rows") -> StreamingQuery:
    """Rows told apart before an operator would drop them: ``kept`` and ``late``
    (time at or before the watermark that the earlier batches set), and a row a
    batch in ``counts`` with the watermark and both numbers, which are observed
    while the rows are written.  Rows without a time are kept."""
    spark, checkpoint = messages.sparkSession, _base(messages, checkpoint, name)

    def batch(df: DataFrame, batch_id: int) -> None:
        passed, newest = _watermark(spark, checkpoint, batch_id, watermark)
        late = F.coalesce(F.col("ts") <= passed, F.lit(False))
        seen = Observation()
        rows = to_ntz(df, "ts").withColumn("late", late).observe(
            seen, F.count(F.lit(1)).alias("n"), F.count_if("late").alias("n_late"), F.max("ts").alias("newest"))
        rows = staged(rows, f"{checkpoint}/rows", batch_id % 2)
        write_batch(rows.filter(~F.col("late")).drop("late"), f"{out_path}/kept", batch_id)
        write_batch(rows.filter("late").drop("late"), f"{out_path}/late", batch_id)
        found = seen.get
        counts = spark.range(1).select(passed.alias("watermark"), F.lit(found["n"] - found["n_late"]).cast("bigint").alias("n_kept"),
                                       F.lit(found["n_late"]).cast("bigint").alias("n_late"))
        write_batch(counts, f"{out_path}/counts", batch_id)
        _carry_watermark(spark, checkpoint, batch_id, newest, found["newest"])

    return _start(messages, name, checkpoint, trigger, batch_fn=batch)


def _watermark(spark: SparkSession, checkpoint: str, batch_id: int, delay: str):
    """The watermark set by the earlier batches (a null, before any), and their newest time."""
    row = _carried(spark, checkpoint, batch_id, "newest timestamp_ntz", "watermark").first()
    newest = row.newest if row else None
    passed = F.lit(newest).cast("timestamp_ntz") - F.expr(f"make_dt_interval(0, 0, 0, {M._seconds(delay)})")
    return passed, newest


def _carry_watermark(spark: SparkSession, checkpoint: str, batch_id: int, *times) -> None:
    newest = max((t for t in times if t is not None), default=None)
    _carry(spark.createDataFrame([(newest,)], "newest timestamp_ntz"), checkpoint, batch_id, "watermark")


# --- F6 with corrections: a changelog ---------------------------------------------------

RETAINED = "device_id bigint, ts timestamp_ntz, msg_id bigint, value double, side int"


def change_log_stream(values: DataFrame, out_path: str, initial: float = 0.0, watermark: str = WATERMARK,
                      checkpoint: str | None = None, trigger: dict | None = None,
                      name: str = "change-log") -> StreamingQuery:
    """F6 that restates: an older message arriving in a later batch, but within
    the watermark, corrects what was emitted.  Output rows carry ``op``: 1 adds a
    change, -1 takes one back that no longer holds; their sum over the batches is
    the batch operator's result, whatever the order of arrival.

    A device hands on its readings after the watermark and the value held there.
    A batch computes the changes without and with its own rows and emits the
    difference.  Rows behind the watermark go to ``<out_path>/late``."""
    spark, checkpoint = values.sparkSession, _base(values, checkpoint, name)
    v = (values.filter(F.col("value").isNotNull())
         .select("device_id", "ts", "msg_id", F.col("value").cast("double").alias("value")))

    def changes(rows: DataFrame, op: int) -> DataFrame:
        out = change_only(rows, ["device_id"], ["ts", "side", "msg_id"], "value", initial)
        return out.filter("side = 1").drop("side").withColumn("op", F.lit(op))

    def batch(df: DataFrame, batch_id: int) -> None:
        passed, newest = _watermark(spark, checkpoint, batch_id, watermark)
        rows = staged(to_ntz(df, "ts").withColumn("late", F.coalesce(F.col("ts") <= passed, F.lit(False))),
                      f"{checkpoint}/rows", batch_id % 2)
        write_batch(rows.filter("late").drop("late"), f"{out_path}/late", batch_id)
        own = rows.filter(~F.col("late")).drop("late").withColumn("side", F.lit(1))
        # side 0, without a time: the value held where the watermark stands
        before = _carried(spark, checkpoint, batch_id, RETAINED)
        both = before.unionByName(own)
        # only devices with rows of their own can differ
        touched = own.select("device_id").distinct()
        mine = before.join(touched, "device_id", "left_semi")
        emitted = changes(mine, -1).unionByName(changes(mine.unionByName(own), 1))
        columns = [c for c in emitted.columns if c != "op"]
        write_batch(emitted.groupBy(*columns).agg(F.sum("op").cast("int").alias("op")).filter("op != 0"),
                    f"{out_path}/changes", batch_id)
        latest = max((t for t in (newest, rows.agg(F.max("ts")).first()[0]) if t is not None), default=None)
        stands = F.lit(latest).cast("timestamp_ntz") - F.expr(f"make_dt_interval(0, 0, 0, {M._seconds(watermark)})")
        # rows without a time come first, as in batch, and are settled at once
        settled = F.col("ts").isNull() | (F.col("ts") <= stands)
        held = both.filter(settled).groupBy("device_id").agg(
            F.max_by("value", F.struct("ts", "side", "msg_id")).alias("value"))
        open_rows = both.filter(~settled)
        _carry(open_rows.unionByName(held.withColumn("side", F.lit(0)), allowMissingColumns=True), checkpoint, batch_id)
        _carry_watermark(spark, checkpoint, batch_id, latest)

    return _start(v, name, checkpoint, trigger, batch_fn=batch)
