"""Registered queries of the streaming flows and of the log reader and writer.

Each stream reads the whole ``events`` table through the message view as a file
stream of at least twelve micro-batches (``_split_log``), runs until everything
present is processed (``availableNow``), and returns the rows it wrote.  Outputs and checkpoints lie in a folder of their own
under ``spark.checkpoint.dir``.  Windowed flows return final windows only: those
that ended by the watermark, ten minutes before the newest reading.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tankcast.functions.payload import parse_double
from tankcast.plans.catalog import PREFIX, TEST_SCALE, Query
from tankcast.session import scratch_path
from tankcast.sources import fixtures as X
from tankcast.sources.messages import read_messages, read_weather, write_messages
from tankcast.streaming import stateful as SF
from tankcast.streaming import streams as ST
from tankcast.streaming import topic_log as TL
from tankcast.streaming.sinks import publish_batches
from tankcast.streaming.sources import MESSAGE_SCHEMA


#: Files of a split log, and rows of one at most.
PARTS, PART_ROWS = 12, 2_000_000
_LOGS: dict[tuple[str, str], str] = {}


def _split_log(spark: SparkSession, sf_dir: str, order: str = "time") -> str:
    """``events`` as files, the earlier ones written first: a stream that takes
    one file a trigger sees the log in many micro-batches.  Files go by time; by
    ``jittered`` time, where a row arrives up to six hours late; or by
    ``remainder`` of the id, where any row may come at any time.  Written once an
    application and table."""
    key = (spark.sparkContext.applicationId, f"{sf_dir} {order}")
    if key not in _LOGS:
        base = scratch_path(spark, f"live/events-{uuid.uuid4().hex}")
        events = X.load_table(spark, sf_dir, "events")
        n, lo, hi = events.agg(F.count(F.lit(1)), F.min("ts"), F.max("ts")).first()
        parts = max(PARTS, -(-n // PART_ROWS))
        width = max((hi - lo).total_seconds() / parts, 1e-6) if n else 1.0
        late = F.pmod(F.xxhash64("event_id"), F.lit(6 * 3600)) if order == "jittered" else F.lit(0)
        since = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(lo).cast("timestamp"))) / 1e6
        # a row without a time goes with the oldest
        part = F.floor(F.coalesce(F.least((since + late) / width, F.lit(parts - 1)), F.lit(0))).cast("int")
        if order == "remainder":
            part = F.pmod(F.col("event_id"), F.lit(PARTS)).cast("int")
        staged = f"{base}/staged"
        events.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(staged)
        for [k] in sorted(spark.read.parquet(staged).select("part").distinct().collect()):
            (spark.read.schema(events.schema).parquet(f"{staged}/part={k}").coalesce(1)
             .write.mode("append").parquet(f"{base}/log"))
        _LOGS[key] = f"{base}/log"
    return _LOGS[key]


def _log_stream(spark: SparkSession, sf_dir: str, order: str = "time", path: str | None = None) -> DataFrame:
    """The split log's events, one file a micro-batch, with a time that can carry a watermark."""
    schema = X.load_table(spark, sf_dir, "events").schema
    events = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .parquet(path or _split_log(spark, sf_dir, order)))
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _messages(spark: SparkSession, sf_dir: str, order: str = "time") -> DataFrame:
    return X.messages_view(_log_stream(spark, sf_dir, order))


def _values(spark: SparkSession, sf_dir: str, order: str = "time") -> DataFrame:
    return _messages(spark, sf_dir, order).withColumn("value", parse_double("payload")).filter(F.col("value").isNotNull())


def _run(spark: SparkSession, name: str, start: Callable[..., StreamingQuery], part: str = "") -> DataFrame:
    """Rows that the stream wrote (into sub-folder ``part``)."""
    tag = f"{name}-{uuid.uuid4().hex}"
    base = scratch_path(spark, f"live/{tag}")
    start(out_path=f"{base}/out", checkpoint=f"{base}/state", trigger={"availableNow": True},
          name=tag).awaitTermination()
    return spark.read.parquet(f"{base}/out{part}")


def q_stream_forecast(spark, sf_dir):
    """Windows, weather read anew each batch, forecast, publishing."""
    return _run(spark, "forecast", lambda **kw: ST.forecast_stream(
        _messages(spark, sf_dir), lambda: X.load_weather(spark, sf_dir), prefix=PREFIX, **kw),
        "/forecast").drop("batch_id")


def q_stream_sliding(spark, sf_dir):
    """Newest and oldest reading per sliding window."""
    return _run(spark, "sliding", lambda **kw: ST.sliding_stream(
        _messages(spark, sf_dir), prefix=PREFIX, **kw)).drop("batch_id")


def q_stream_training(spark, sf_dir):
    """Model versions of every final period; a period without pairs gives none."""
    return _run(spark, "training", lambda **kw: ST.training_stream(
        _messages(spark, sf_dir), lambda: X.load_weather(spark, sf_dir), prefix=PREFIX, scale=TEST_SCALE, **kw),
        "/models").drop("batch_id")


def q_stream_control(spark, sf_dir):
    """Held state and rules after every accepted control message."""
    return _run(spark, "control", lambda **kw: ST.control_stream(
        _messages(spark, sf_dir), prefix=PREFIX, **kw)).drop("batch_id")


def q_stream_change(spark, sf_dir):
    """F6 on a stream."""
    v = X.with_held_value(_values(spark, sf_dir)).select("device_id", "ts", "msg_id", F.col("held_value").alias("value"))
    return _run(spark, "change", lambda **kw: ST.change_stream(v, **kw)).drop("batch_id").withColumnRenamed(
        "value", "held_value")


def q_stream_latest(spark, sf_dir):
    """A3 on a stream: a key's newest output is its state."""
    out = _run(spark, "latest", lambda **kw: ST.latest_stream(_messages(spark, sf_dir), **kw))
    values = F.struct("ts", "msg_id", "payload", "n_messages")
    return out.groupBy("site_id", "topic").agg(F.max_by(values, "batch_id").alias("l")).select(
        "site_id", "topic", "l.*")


def q_message_log(spark, sf_dir):
    """The log written by the sink and read back through the reader's topic filter."""
    path = scratch_path(spark, f"live/log-{uuid.uuid4().hex}")
    write_messages(X.load_messages(spark, sf_dir), path)
    return read_messages(spark, path, PREFIX, ["tank/temperature", "tank/forecast"]).drop("date")


def q_weather_source(spark, sf_dir):
    """A weather table written as files and read by its reader."""
    path = scratch_path(spark, f"live/weather-{uuid.uuid4().hex}")
    X.load_weather(spark, sf_dir).write.parquet(path)
    return read_weather(spark, path)


def q_stream_tick_control(spark, sf_dir):
    """State, rules and cadence on every tick of every site, in micro-batches of one file."""
    return _run(spark, "tick-control", lambda **kw: SF.tick_control_stream(
        _messages(spark, sf_dir), prefix=PREFIX, tick="1 hour", **kw)).drop("batch_id")


def q_stream_weather_enrich(spark, sf_dir):
    """J1 with readings and weather both streaming, each in micro-batches of one file."""
    m, w = _messages(spark, sf_dir), X.weather_view(_log_stream(spark, sf_dir))
    return _run(spark, "weather-enrich", lambda **kw: SF.weather_enrich_stream(
        m, w, prefix=PREFIX, **kw)).drop("batch_id")


def q_stream_extremes(spark, sf_dir):
    """A4 on a stream."""
    v = X.with_reset_flags(_values(spark, sf_dir)).select("device_id", "ts", "msg_id", "value", "is_reset")
    return _run(spark, "extremes", lambda **kw: ST.extremes_stream(v, **kw)).drop("batch_id")


def q_stream_sample(spark, sf_dir):
    """W4 on a stream, with the interval that thins the sparse test series."""
    v = _values(spark, sf_dir).select("device_id", "ts", "msg_id", "value")
    return _run(spark, "sample", lambda **kw: ST.sample_stream(
        v, interval="2 hours", segment="6 hours", **kw)).drop("batch_id")


def q_stream_history(spark, sf_dir):
    """W3 on a stream: each series' chart is the one emitted last."""
    out = _run(spark, "history", lambda **kw: ST.history_stream(
        _messages(spark, sf_dir), max_age="48 hours", **kw))
    last = out.groupBy("site_id", "topic").agg(F.max("batch_id").alias("batch_id"))
    return out.join(last, ["site_id", "topic", "batch_id"]).drop("batch_id")


def q_stream_late_rows(spark, sf_dir):
    """Rows kept and late per batch, of messages that arrive in any order."""
    return _run(spark, "late", lambda **kw: ST.late_rows_stream(
        _messages(spark, sf_dir, "remainder"), watermark="8 hours", **kw), "/counts").select(
        F.col("batch_id").cast("bigint").alias("batch_id"), "n_kept", "n_late")


def q_stream_change_log(spark, sf_dir):
    """F6 with corrections: the sum of a changelog over messages up to six hours late."""
    v = X.with_held_value(_values(spark, sf_dir, "jittered")).select(
        "device_id", "ts", "msg_id", F.col("held_value").alias("value"))
    out = _run(spark, "change-log", lambda **kw: ST.change_log_stream(v, watermark="7 hours", **kw), "/changes")
    return (out.groupBy("device_id", "ts", "msg_id", "value", "previous_value").agg(F.sum("op").alias("op"))
            .filter("op != 0").select("device_id", "ts", "msg_id", F.col("value").alias("held_value"), "previous_value"))


SUBSCRIBED = ["tank/temperature", "tank/forecast"]


def _topic_log(spark, sf_dir) -> str:
    """The messages published by the transactional sink, an epoch a micro-batch."""
    base = scratch_path(spark, f"live/topic-log-{uuid.uuid4().hex}")
    m = _messages(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    TL.write_topic_log(m, f"{base}/log", f"{base}/state", {"availableNow": True}).awaitTermination()
    return f"{base}/log"


def q_topic_log_sink(spark, sf_dir):
    """Published in epochs, read back as committed, two topics only."""
    return TL.read_topic_log(spark, _topic_log(spark, sf_dir), MESSAGE_SCHEMA, [f"{PREFIX}/{t}" for t in SUBSCRIBED])


def q_topic_log_source(spark, sf_dir):
    """A stream subscribed to two topics of the log, by offsets."""
    log = _topic_log(spark, sf_dir)
    m = TL.read_topic_log(spark, log, MESSAGE_SCHEMA, [f"{PREFIX}/{t}" for t in SUBSCRIBED], stream=True)
    return _run(spark, "topic-source", lambda out_path, checkpoint, trigger, name: (
        m.writeStream.foreachBatch(publish_batches(out_path)).option("checkpointLocation", checkpoint)
        .trigger(**trigger).queryName(name).start())).drop("batch_id")


def q_stream_restart(spark, sf_dir):
    """T4: the live tick stopped with half of the log, and started again from
    its checkpoint when the other half is there."""
    whole = _split_log(spark, sf_dir)
    base = scratch_path(spark, f"live/restart-{uuid.uuid4().hex}")
    schema = X.load_table(spark, sf_dir, "events").schema
    files = (spark.read.schema(schema).parquet(whole).select("_metadata.file_path", "_metadata.file_modification_time")
             .distinct().orderBy("file_modification_time", "file_path").collect())
    half = len(files) // 2
    for some in (files[:half], files[half:]):
        for f in some:
            spark.read.schema(schema).parquet(f.file_path).coalesce(1).write.mode("append").parquet(f"{base}/log")
        m = X.messages_view(_log_stream(spark, sf_dir, path=f"{base}/log"))
        SF.tick_control_stream(m, f"{base}/out", prefix=PREFIX, tick="1 hour", checkpoint=f"{base}/state",
                               trigger={"availableNow": True}, name=f"restart-{uuid.uuid4().hex}").awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch_id")


QUERIES: dict[str, Query] = {
    "stream_extremes": q_stream_extremes,
    "stream_sample": q_stream_sample,
    "stream_history": q_stream_history,
    "stream_late_rows": q_stream_late_rows,
    "stream_change_log": q_stream_change_log,
    "stream_restart": q_stream_restart,
    "topic_log_sink": q_topic_log_sink,
    "topic_log_source": q_topic_log_source,
    "stream_tick_control": q_stream_tick_control,
    "stream_weather_enrich": q_stream_weather_enrich,
    "stream_forecast": q_stream_forecast,
    "stream_sliding": q_stream_sliding,
    "stream_training": q_stream_training,
    "stream_control": q_stream_control,
    "stream_change": q_stream_change,
    "stream_latest": q_stream_latest,
    "message_log": q_message_log,
    "weather_source": q_weather_source,
}
