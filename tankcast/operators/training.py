"""Training the linear forecast: horizon pairs, sufficient statistics,
mini-batch SGD, model versions and latest-model scoring (J2 J3 P6 P7 F3 M2 M3 M4).

Intent (the reference's pairing is inverted and its labels are NaN): the
features of the newest reading of a 30-minute pane are paired with the newest
tank temperature of the pane three hours later, per model key.

Physical plan:
* newest row per (key, pane) is a partial aggregate -- the data shrinks to one
  row per pane before anything else;
* pairs are an equi-join on (key, pane + horizon) -- no range join;
* each training period (mini-batch) is reduced to sums (n, X'X as a packed
  triangle, X'y) by one grouped aggregate, for any list of features: four, or the
  seven of the documented model (weather at label time as well);
* only the fold across periods is sequential: one ``applyInPandas`` group per
  model key, holding one small row per period (its size grows with time
  covered, not with the data volume).
"""

from __future__ import annotations

from collections.abc import Sequence

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankcast.functions.payload import DEFAULT_WEIGHTS, linear_model, round_half_up2
from tankcast.operators.asof import asof_left_join
from tankcast.operators.forecast import FEATURES, enrich_with_weather
from tankcast.operators.segmented import DEFAULT_SEGMENT
from tankcast.operators.windows import _seconds
from tankcast.session import ship_package

# Streaming SGD defaults of the reference's model.
STEP_SIZE = 0.1
NUM_ITERATIONS = 50
CONVERGENCE_TOL = 0.001
HORIZON = "3 hours"
PERIOD = "30 minutes"
# Fixed divisors that bring the features to unit range for a stable step
# (dashboard slider maxima: tank 100, weather 10).  None trains on raw values.
FEATURE_SCALE = (100.0, 10.0, 10.0, 10.0)

GLOBAL_KEY = "model_key"

# The documented model also sees the weather at label time; its weights start at zero.
DOCUMENTED = (*FEATURES, "current_temperature", "current_humidity", "current_wind")
WEIGHTS = ("w_tank", "w_temp", "w_hum", "w_wind", "w_current_temp", "w_current_hum", "w_current_wind")
DOCUMENTED_WEIGHTS = (*DEFAULT_WEIGHTS, 0.0, 0.0, 0.0)
DOCUMENTED_SCALE = (*FEATURE_SCALE, 10.0, 10.0, 10.0)


def triangle(d: int) -> list[tuple[int, int, str]]:
    """(i, j, column) of the packed upper triangle of X'X."""
    mark = "" if d <= 10 else "_"
    return [(i, j, f"xx_{i}{mark}{j}") for i in range(d) for j in range(i, d)]


def pane_newest(readings: DataFrame, keys: Sequence[str], period: str = PERIOD) -> DataFrame:
    """Newest reading per (key, pane); pane = tumbling window of one period."""
    keys = list(keys)
    row = F.struct("ts", "msg_id", "device_id", "site_id", "tank_temperature")
    agg = (readings.groupBy(*[F.col(k) for k in keys],
                            F.window("ts", period).start.alias("pane"))
           .agg(F.max_by(row, F.struct("ts", "msg_id")).alias("r")))
    sel = [*keys, "pane", *[F.col(f"r.{c}").alias(c)
                            for c in ("ts", "msg_id", "device_id", "site_id", "tank_temperature")
                            if c not in keys]]
    return agg.select(*sel)


def training_pairs(readings: DataFrame, weather: DataFrame, keys: Sequence[str] = ("site_id",),
                   horizon: str = HORIZON, period: str = PERIOD, documented: bool = False,
                   segment: str = DEFAULT_SEGMENT) -> DataFrame:
    """J2 (+ J3 when ``documented``): one labelled row per key and pane that
    has a successor pane exactly ``horizon`` later.

    Columns: keys, feature_pane, label_pane, the four features (newest reading
    of the feature pane with its weather), ``label`` (newest tank temperature
    of the label pane); documented adds the label pane's weather.
    """
    keys = list(keys)
    # the raw readings cover every pane's segment: the as-of summary reads them
    newest = enrich_with_weather(pane_newest(readings, keys, period), weather, segment=segment,
                                 readings_cover=readings)
    # Each pane row plays two roles: features for the pane ``horizon`` later
    # and label for its own pane.  One aggregate on (key, label pane) pairs
    # them -- a self-join would compute the enriched panes twice.
    hz = F.expr(f"make_dt_interval(0, 0, 0, {_seconds(horizon)})")
    lab_src = ["tank_temperature"] + (
        ["weather_temperature", "weather_humidity", "weather_wind"] if documented else [])
    lab_out = ["label"] + (["current_temperature", "current_humidity", "current_wind"]
                           if documented else [])
    roles = newest.select(
        *keys, "pane", *FEATURES,
        F.explode(F.array(F.lit(0), F.lit(1))).alias("__role"))
    roles = roles.withColumn(
        "label_pane", F.when(F.col("__role") == 0, F.col("pane") + hz).otherwise(F.col("pane")))
    is_f, is_l = F.col("__role") == 0, F.col("__role") == 1
    paired = roles.groupBy(*keys, "label_pane").agg(
        F.max(F.when(is_f, F.col("pane"))).alias("feature_pane"),
        *[F.max(F.when(is_f, F.col(c))).alias(c) for c in FEATURES],
        F.max(F.when(is_l, F.lit(1))).alias("__has_label"),
        *[F.max(F.when(is_l, F.col(c))).alias(o) for c, o in zip(lab_src, lab_out)])
    return (paired.filter(F.col("feature_pane").isNotNull() & F.col("__has_label").isNotNull())
                  .select(*keys, "label_pane", "feature_pane", *FEATURES, *lab_out))


def label_filter(pairs: DataFrame, label: str = "label") -> DataFrame:
    """drop rows whose label is NaN or null (Spark treats NaN = NaN as
    true, so the test is isnan, never a comparison)."""
    return pairs.filter(~F.isnan(F.col(label)) & F.col(label).isNotNull())


def _scaled(c: str, d: float | None):
    return F.col(c) / F.lit(d) if d else F.col(c)


def train_statistics(pairs: DataFrame, model_keys: Sequence[str] = ("site_id",),
                     batch: str = "label_pane", scale=FEATURE_SCALE,
                     features: Sequence[str] = FEATURES) -> DataFrame:
    """M2 statistics: per model key and training period, n, X'X (its packed
    triangle) and X'y of the (scaled) features.  One partial+final aggregate."""
    model_keys = list(model_keys)
    if not model_keys:  # one global model: every pair of a period is one mini-batch
        pairs = pairs.withColumn(GLOBAL_KEY, F.lit("global"))
        model_keys = [GLOBAL_KEY]
    clean = label_filter(pairs)
    sc = scale or (None,) * len(features)
    x = [_scaled(c, d) for c, d in zip(features, sc, strict=True)]
    y = F.col("label")
    # non-finite features would poison the model: reject such rows
    finite = None
    for xi in x:
        ok = ~F.isnan(xi) & xi.isNotNull() & (F.abs(xi) != F.lit(float("inf")))
        finite = ok if finite is None else finite & ok
    clean = clean.filter(finite & (F.abs(y) != F.lit(float("inf"))))
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(x[i] * x[j]).alias(c) for i, j, c in triangle(len(x))]
    aggs += [F.sum(xi * y).alias(f"xy_{i}") for i, xi in enumerate(x)]
    return clean.groupBy(*model_keys, F.col(batch).alias("batch")).agg(*aggs)


def _dot(a: list[float], b: list[float]) -> float:
    """Summed from left to right (``sum`` and numpy add in other ways)."""
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        total += x * y
    return total


def sgd_fold(stats: pd.DataFrame, w0, step: float = STEP_SIZE, iters: int = NUM_ITERATIONS,
             tol: float = CONVERGENCE_TOL, total: int = 0) -> pd.DataFrame:
    """Run mini-batch SGD over the batches of ONE model, in batch order,
    warm-starting each batch from the previous weights.  Per batch (full
    mini-batch): w_i = w_{i-1} - step/sqrt(i) * (X'X w_{i-1} - X'y)/n, stopping
    from i = 2 when |w_i - w_{i-1}| < tol * max(|w_i|, 1).  Empty batches do
    not exist here (M4: a period without pairs changes nothing).  ``total``:
    pairs seen before."""
    stats = stats.sort_values("batch")
    w, d, rows = [float(x) for x in w0], len(w0), []
    steps = [step / math.sqrt(i) for i in range(1, iters + 1)]
    packed = triangle(d)
    xx = stats[[c for _, _, c in packed]].to_numpy(dtype=float)
    xy = stats[[f"xy_{i}" for i in range(d)]].to_numpy(dtype=float)
    ns = stats["n"].to_numpy(dtype=float)
    batches = stats["batch"].tolist()
    for r in range(len(stats)):
        n = ns[r]
        if n <= 0:
            continue
        # the small problem in plain floats: numpy call overhead would dominate
        s = [[0.0] * d for _ in range(d)]
        for (i, j, _), v in zip(packed, (xx[r] / n).tolist()):
            s[i][j] = s[j][i] = v
        b = (xy[r] / n).tolist()
        for it in range(iters):
            new = [wk - steps[it] * (_dot(row, w) - bk) for wk, row, bk in zip(w, s, b)]
            change = [x - y for x, y in zip(new, w)]
            w = new
            if it > 0 and math.sqrt(_dot(change, change)) < tol * max(math.sqrt(_dot(w, w)), 1.0):
                break
        total += int(n)
        rows.append((batches[r], *w, total))
    return pd.DataFrame(rows, columns=["batch", *[f"w{i}" for i in range(d)], "n"])


def train_weights(stats: DataFrame, model_keys: Sequence[str] = ("site_id",),
                  initial=DEFAULT_WEIGHTS, scale=FEATURE_SCALE, period: str = PERIOD,
                  step: float = STEP_SIZE, iters: int = NUM_ITERATIONS,
                  tol: float = CONVERGENCE_TOL, start: DataFrame | None = None,
                  with_state: bool = False) -> DataFrame:
    """M2 fold: model versions, one per (model key, training period), for as
    many features as ``initial`` has weights.

    ``version_ts`` is the end of the period whose batch produced the weights;
    weights are reported in original feature units, in columns ``WEIGHTS``.
    ``with_state`` adds ``state``, the weights as the fold holds them.  ``start``
    (model keys, ``state``, ``n``) goes on from such versions, e.g. the last of a
    streaming run, as if there had been no break; other keys start at ``initial``.
    """
    model_keys = list(model_keys) or [GLOBAL_KEY]
    names = WEIGHTS[:len(initial)]
    sc = np.asarray(scale if scale else (1.0,) * len(initial), dtype=float)
    w0 = np.asarray(initial, dtype=float) * sc
    if start is not None:
        stats = stats.join(start.select(*model_keys, F.col("state").alias("start_state"), F.col("n").alias("start_n")),
                           model_keys, "left")
    else:
        stats = stats.select("*", F.lit(None).cast("array<double>").alias("start_state"),
                             F.lit(None).cast("bigint").alias("start_n"))
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}"
                           for f in stats.schema.fields if f.name in model_keys)
    batch_type = stats.schema["batch"].dataType.simpleString()
    schema = (f"{key_schema}, batch {batch_type}, {', '.join(f'{n} double' for n in names)}, "
              f"intercept double, n bigint, state array<double>")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        first, seen = pdf["start_state"].iloc[0], pdf["start_n"].iloc[0]
        res = sgd_fold(pdf, w0 if first is None else first, step, iters, tol, 0 if pd.isna(seen) else int(seen))
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * len(res) for k in model_keys})
        out["batch"] = res["batch"].values
        weights = res[[f"w{i}" for i in range(len(names))]].to_numpy(dtype=float)
        for i, name in enumerate(names):
            out[name] = weights[:, i] / sc[i]
        out["intercept"] = 0.0
        out["n"] = res["n"].astype("int64").values
        out["state"] = list(weights)
        return out

    ship_package(stats.sparkSession)
    versions = stats.groupBy(*model_keys).applyInPandas(fold, schema)
    per = F.expr(f"make_dt_interval(0, 0, 0, {_seconds(period)})")
    versions = versions.withColumn("version_ts", F.col("batch") + per).drop("batch")
    return versions if with_state else versions.drop("state")


def forecast_with_models(rows: DataFrame, models: DataFrame, model_keys: Sequence[str] = ("site_id",),
                         time_col: str = "window_end", id_col: str = "msg_id",
                         initial=DEFAULT_WEIGHTS, segment: str = DEFAULT_SEGMENT,
                         rows_cover: DataFrame | None = None, features: Sequence[str] = FEATURES) -> DataFrame:
    """M3: score each row's ``features`` with the newest model version published
    at or before ``time_col``; rows before the first version use ``initial``.
    ``rows_cover`` (model keys + ``time_col``) may cover the rows' segments
    more cheaply than recomputing ``rows`` (see ``asof_left_join``)."""
    model_keys = list(model_keys)
    left = rows.withColumn("__t", F.col(time_col))
    names = WEIGHTS[:len(features)]
    right = models.select(*model_keys, F.col("version_ts").alias("__t"),
                          F.xxhash64("version_ts").alias("__vid"),  # deterministic tie-break id
                          *names, "intercept", F.col("version_ts").alias("model_version_ts"))
    j = asof_left_join(left, right, on=model_keys, ts="__t", right_cols=[*names, "intercept", "model_version_ts"],
                       left_id=id_col, right_id="__vid",
                       left_cover=None if rows_cover is None else rows_cover.withColumnRenamed(time_col, "__t"),
                       defaults={**dict(zip(names, initial, strict=True)), "intercept": 0.0}, segment=segment)
    f = linear_model(features, [F.col(c) for c in names], F.col("intercept"))
    return (j.drop("__t").withColumn("forecast", f)
             .withColumn("forecast_r2", round_half_up2(F.col("forecast"))))


def with_weather_at_horizon(rows: DataFrame, weather: DataFrame, ts: str = "ts", id_col: str = "msg_id",
                            horizon: str = HORIZON, segment: str = DEFAULT_SEGMENT,
                            rows_cover: DataFrame | None = None) -> DataFrame:
    """The documented model's other three features: the weather known for the
    time the forecast is for (a horizon after ``ts``), in ``current_*``."""
    hz = F.expr(f"make_dt_interval(0, 0, 0, {_seconds(horizon)})")
    there = {"__t": F.col(ts) + hz}
    names = {"temperature": "current_temperature", "humidity": "current_humidity", "wind": "current_wind"}
    right = weather.select("site_id", F.col("ts").alias("__t"), "weather_id", *[F.col(c).alias(n) for c, n in names.items()])
    return asof_left_join(rows.withColumns(there), right, on=["site_id"], ts="__t", right_cols=list(names.values()),
                          left_id=id_col, right_id="weather_id", defaults=dict.fromkeys(names.values(), 0.0),
                          left_cover=None if rows_cover is None else rows_cover.withColumns(there),
                          segment=segment).drop("__t")
