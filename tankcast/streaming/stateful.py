"""Flows with a state of their own per key and event-time timers (T6 live tick,
J1 between two streams), by ``transformWithState``.

A timer expires when the watermark passes it.  It emits all that has become
final, removes it from the state and arms the next timer, so a key without new
rows goes on being served.  The state lives in RocksDB; ``started`` asks for that
store and for as many state partitions as the cluster has cores (the number
stays fixed for a checkpoint).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tankcast.functions.payload import parse_double
from tankcast.operators import control as C
from tankcast.operators.windows import _seconds
from tankcast.streaming.sinks import write_batch
from tankcast.streaming.sources import to_ntz
from tankcast.streaming.streams import WATERMARK, _readings, _start

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Ticks or rows given on in one frame.
GIVEN = 1 << 16


@contextmanager
def state_settings(spark: SparkSession, partitions: int | None = None):
    """Settings a query takes when it starts; the session gets its own back."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
              "spark.sql.shuffle.partitions": str(partitions or spark.sparkContext.defaultParallelism)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _micros(column: pd.Series) -> np.ndarray:
    return column.to_numpy().astype("datetime64[us]").astype("int64")


def _number(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(float("nan")))


# --- T6: the gateway's tick ---------------------------------------------------------

SERIES = list(C.HELD_SERIES.values())
#: ``had``: bit k tells that series k has a value (frames know no null apart from NaN).
TICKS = "site_id int, tick timestamp, tick_index bigint, had int, " + ", ".join(f"{c} double" for c in SERIES)


class TickProcessor(StatefulProcessor):
    """One row per key and tick.  Input: ``tick`` (the instant at which a row's
    values count), ``first``, ``had`` and the newest value of each series within
    the tick.  State: values of ticks still to come, the values held, the next
    tick and its index."""

    def __init__(self, step_us: int):
        self.step = step_us

    def init(self, handle) -> None:
        self.handle = handle
        values = ", ".join(f"v{k} double" for k in range(len(SERIES)))
        self.coming = handle.getMapState("coming", "tick bigint", f"had int, {values}")
        self.held = handle.getValueState("held", f"next bigint, idx bigint, had int, {values}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            if not len(pdf):
                continue
            low = int(_micros(pdf["first"]).min())
            first = low if first is None else min(first, low)
            for tick, had, values in zip(_micros(pdf["tick"]).tolist(), pdf["had"].tolist(), pdf[SERIES].to_numpy().tolist()):
                self.coming.updateValue((tick,), (had, *values))
        if first is not None and not self.held.exists():
            start = first // self.step * self.step
            self.held.update((start, 0, 0, *[0.0] * len(SERIES)))
            self.handle.registerTimer(-(-start // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        start, index, had, *held = self.held.get()
        coming = sorted((t, *v) for (t,), v in self.coming.iterator() if t <= until)
        done = 0
        while start <= until:
            ticks = np.arange(start, min(until, start + (GIVEN - 1) * self.step) + 1, self.step)
            mask, values = np.full(len(ticks), had, np.int32), np.tile(np.array(held, float), (len(ticks), 1))
            while done < len(coming) and coming[done][0] <= ticks[-1]:
                tick, some, *new = coming[done]
                at = (tick - start) // self.step  # holds from here on
                had |= some
                mask[at:] = had
                for k, v in enumerate(new):
                    if some >> k & 1:
                        values[at:, k] = held[k] = v
                self.coming.removeKey((tick,))
                done += 1
            yield pd.DataFrame({"site_id": key[0], "tick": pd.to_datetime(ticks, unit="us"),
                                "tick_index": np.arange(index, index + len(ticks)), "had": mask,
                                **{c: values[:, k] for k, c in enumerate(SERIES)}})
            start, index = start + len(ticks) * self.step, index + len(ticks)
        self.held.update((start, index, had, *held))
        self.handle.registerTimer(-(-start // 1000))

    def close(self) -> None:
        pass


def tick_control_stream(messages: DataFrame, out_path: str, prefix: str = "site", tick: str = "1 second",
                        watermark: str = WATERMARK, checkpoint: str | None = None, trigger: dict | None = None,
                        name: str = "tick-control", partitions: int | None = None) -> StreamingQuery:
    """Held state, rules and status cadence (W1, J4, C1, C2, P12, W2) on every
    tick of every site from its first control message on, silent ticks too, each
    once the watermark has passed it.

    A tick's messages are combined per site before they reach the state (partial
    aggregates, then one row a site and tick), so a busy site is no hot key."""
    topics = {f"{prefix}/{s}": c for s, c in C.HELD_SERIES.items()}
    # a message at the tick's instant counts, and windows end before their end
    m = (messages.filter(F.col("topic").isin(list(topics)))
         .select("site_id", (F.col("ts") - F.expr("interval 1 microsecond")).alias("before"), "ts", "msg_id", "topic",
                 parse_double("payload").alias("value"))
         .withWatermark("before", watermark))

    def newest(topic):
        own = (F.col("topic") == topic) & F.col("value").isNotNull()
        return F.max_by(F.when(own, F.col("value")), F.when(own, F.struct("ts", "msg_id")))

    per_tick = (m.groupBy("site_id", F.window("before", tick).alias("w"))
                .agg(F.min("ts").alias("first"), *[newest(t).alias(c) for t, c in topics.items()]))
    had = sum(F.when(F.col(c).isNull(), 0).otherwise(1 << k) for k, c in enumerate(SERIES))
    rows = per_tick.select("site_id", F.window_time("w").alias("event"), F.col("w.end").alias("tick"), "first",
                           had.cast("int").alias("had"), *SERIES)
    state = rows.groupBy("site_id").transformWithStateInPandas(
        TickProcessor(_seconds(tick) * 1_000_000), TICKS, "append", "eventTime")
    # what a frame gave back as null is the number NaN
    state = state.select("site_id", "tick", "tick_index", *[
        F.when(F.col("had").bitwiseAND(1 << k) == 0, F.lit(C.INITIAL_STATE[c])).otherwise(_number(c)).alias(c)
        for k, c in enumerate(SERIES)])
    out = C.with_cadence(C.apply_rules(state))

    def batch(df: DataFrame, batch_id: int) -> None:
        write_batch(to_ntz(df, "tick"), out_path, batch_id)

    with state_settings(messages.sparkSession, partitions):
        return _start(out, name, checkpoint, trigger, batch_fn=batch)


# --- J1 between two streams ----------------------------------------------------------

WEATHER = ["temperature", "humidity", "wind"]
ENRICHED = ("site_id int, device_id bigint, ts timestamp, msg_id bigint, tank_temperature double, "
            "weather_temperature double, weather_humidity double, weather_wind double, weather_found boolean")


#: Rows of the state, many to a block: a call of the state store takes a block, not a row.
READING = np.dtype([("ts", "<i8"), ("device", "<i8"), ("id", "<i8"), ("value", "<f8")])
VERSION = np.dtype([("ts", "<i8"), ("id", "<i8"), *((n, "<f8") for n in WEATHER)])


def _block(dtype: np.dtype, *columns) -> np.ndarray:
    out = np.empty(len(columns[0]), dtype)
    for name, column in zip(dtype.names, columns):
        out[name] = pd.Series(column).astype(dtype[name])  # fails on an id that is missing
    return out


def _rows(state, dtype: np.dtype) -> np.ndarray:
    blocks = [np.frombuffer(b, dtype) for [b] in state.get()] if state.exists() else []
    return np.concatenate(blocks) if blocks else np.empty(0, dtype)


def _cut(rows: np.ndarray) -> list[tuple[bytes]]:
    return [(rows[lo:lo + GIVEN].tobytes(),) for lo in range(0, len(rows), GIVEN)]


class AsOfProcessor(StatefulProcessor):
    """Readings with the newest weather at or before them, emitted when the
    watermark has passed them.  State: blocks of readings still open and of
    weather versions, in order of arrival; of versions with one (time, id) the
    last to arrive counts.  Of those the watermark has passed only the newest stays."""

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "block binary")
        self.versions = handle.getListState("versions", "block binary")
        self.armed = handle.getValueState("armed", "at bigint")

    def arm(self, micros: int) -> None:
        at = -(-micros // 1000)
        before = self.armed.get()[0] if self.armed.exists() else None
        if before is None or at < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
            self.armed.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came: dict[str, list[np.ndarray]] = {"open": [], "versions": []}
        for pdf in rows:
            us, is_weather = _micros(pdf["ts"]), pdf["weather"].to_numpy(bool)
            weather, own = pdf[is_weather], pdf[~is_weather]
            came["versions"].append(_block(VERSION, us[is_weather], weather["id"], *(weather[n] for n in WEATHER)))
            came["open"].append(_block(READING, us[~is_weather], own["device_id"], own["id"], own["value"]))
        first = []
        for name, blocks in came.items():
            some = np.concatenate(blocks) if blocks else []
            if len(some):
                getattr(self, name).appendList(_cut(some))
                first.append(int(some["ts"].min()))
        if first:
            self.arm(min(first))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        rows, versions = _rows(self.open, READING), _rows(self.versions, VERSION)
        rows = rows[np.argsort(rows["ts"], kind="stable")]
        versions = versions[np.lexsort((versions["id"], versions["ts"]))]  # stable: the last to arrive comes last
        times = versions["ts"]
        done = int(np.searchsorted(rows["ts"], until, side="right"))
        passed = int(np.searchsorted(times, until, side="right"))
        for lo in range(0, done, GIVEN):
            some = rows[lo:min(lo + GIVEN, done)]
            found = np.searchsorted(times, some["ts"], side="right")  # 0: none, else the version before
            yield pd.DataFrame({
                "site_id": key[0], "device_id": some["device"], "ts": pd.to_datetime(some["ts"], unit="us"),
                "msg_id": some["id"], "tank_temperature": some["value"],
                **{f"weather_{n}": np.concatenate(([0.0], versions[n]))[found] for n in WEATHER},
                "weather_found": found > 0})
        left, kept = rows[done:], versions[max(passed - 1, 0):]
        for state, now, whole in ((self.open, left, rows), (self.versions, kept, versions)):
            if len(now) < len(whole):
                state.put(_cut(now)) if len(now) else state.clear()
        self.armed.clear()
        following = [*left["ts"][:1].tolist(), *times[passed:passed + 1].tolist()]
        if following:
            self.arm(min(following))

    def close(self) -> None:
        pass


def weather_enrich_stream(messages: DataFrame, weather: DataFrame, out_path: str, prefix: str = "site",
                          watermark: str = WATERMARK, buckets: int = 8, checkpoint: str | None = None,
                          trigger: dict | None = None, name: str = "weather-enrich",
                          partitions: int | None = None) -> StreamingQuery:
    """J1 with both sides streaming: a reading waits until the watermark (the
    lesser of both streams') has passed it, so weather that arrives after it but
    within the watermark still counts.

    A site's readings are dealt by device to ``buckets`` keys, each with the
    site's weather: a busy site is spread, and weather is the small side."""
    r = _readings(messages, prefix).withWatermark("ts", watermark)
    w = weather.withWatermark("ts", watermark)
    none = [F.lit(None).cast("double").alias(n) for n in WEATHER]
    r = r.select("site_id", F.pmod(F.xxhash64("device_id"), F.lit(buckets)).alias("bucket"), F.lit(False).alias("weather"),
                 "ts", "device_id", F.col("msg_id").alias("id"), F.col("tank_temperature").alias("value"), *none)
    w = w.select("site_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint"))).alias("bucket"),
                 F.lit(True).alias("weather"), "ts", F.lit(0).cast("bigint").alias("device_id"),  # a null makes floats of all
                 F.col("weather_id").alias("id"), F.lit(None).cast("double").alias("value"),
                 *[F.coalesce(n, F.lit(0.0)).alias(n) for n in WEATHER])
    out = r.unionByName(w).groupBy("site_id", "bucket").transformWithStateInPandas(
        AsOfProcessor(), ENRICHED, "append", "eventTime")
    # nothing in there is null, so what a frame gave back as null is the number NaN
    numbers = [f.name for f in out.schema.fields if f.dataType.typeName() == "double"]
    out = out.withColumns({n: _number(n) for n in numbers})

    def batch(df: DataFrame, batch_id: int) -> None:
        write_batch(to_ntz(df, "ts"), out_path, batch_id)

    with state_settings(messages.sparkSession, partitions):
        return _start(out, name, checkpoint, trigger, batch_fn=batch)
