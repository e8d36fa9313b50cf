"""Training: horizon pairs, label filter, SGD fold vs MLlib, model scoring."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tankcast.operators import training as M

T0 = dt.datetime(2024, 1, 1)
MSG = "msg_id long, device_id long, site_id int, ts timestamp_ntz, tank_temperature double"
WEATHER = ("weather_id long, site_id int, ts timestamp_ntz, temperature double, "
           "humidity double, wind double")

X = [(.5, .2, .1, .3), (.9, .1, .4, .2), (.3, .8, .5, .6)]
Y = [.7, 1.1, .9]
W0 = (1.0, 1.0, 0.1, 0.2)


def _stats_frame(rows, ys):
    a = np.asarray(rows)
    b = np.asarray(ys)
    rec = {"batch": [0], "n": [len(rows)]}
    for i in range(4):
        for j in range(i, 4):
            rec[f"xx_{i}{j}"] = [float((a[:, i] * a[:, j]).sum())]
        rec[f"xy_{i}"] = [float((a[:, i] * b).sum())]
    return pd.DataFrame(rec)


def test_sgd_rule_golden():
    res = M.sgd_fold(_stats_frame(X, Y), W0)
    assert np.allclose(res.iloc[0][["w0", "w1", "w2", "w3"]].astype(float).values,
                       [0.97826, 0.91382, 0.05310, 0.13559], atol=5e-6)


def test_sgd_matches_mllib(spark):
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.regression import LabeledPoint, LinearRegressionWithSGD
    pts = spark.sparkContext.parallelize(
        [LabeledPoint(y, Vectors.dense(x)) for x, y in zip(X, Y)], 1)
    model = LinearRegressionWithSGD.train(pts, iterations=50, step=0.1, miniBatchFraction=1.0,
                                          initialWeights=Vectors.dense(W0), convergenceTol=0.001)
    mine = M.sgd_fold(_stats_frame(X, Y), W0).iloc[0][["w0", "w1", "w2", "w3"]].astype(float).values
    assert np.allclose(mine, model.weights.toArray(), atol=1e-6)


def test_pairs_horizon_and_missing_pane(spark):
    rd = spark.createDataFrame([
        (1, 7, 0, T0, 40.0),
        (2, 7, 0, T0 + dt.timedelta(hours=3, minutes=1), 44.0),
        (3, 7, 0, T0 + dt.timedelta(minutes=40), 41.0),       # pane 00:30, no pane 03:30
    ], MSG)
    weather = spark.createDataFrame([(9, 0, T0, 5.0, 3.0, 7.0)], WEATHER)
    pairs = M.training_pairs(rd, weather).collect()
    assert len(pairs) == 1
    p = pairs[0]
    assert p.feature_pane == T0 and p.label == 44.0 and p.tank_temperature == 40.0
    assert p.weather_temperature == 5.0
    doc = M.training_pairs(rd, weather, documented=True).first()
    assert doc.current_temperature == 5.0 and doc.label == 44.0


def test_label_filter(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (50.0,)], "label double")
    assert [r.label for r in M.label_filter(df).collect()] == [50.0]


def test_statistics_fold_and_scoring(spark):
    rows = []
    for b in range(3):
        for i, (x, y) in enumerate(zip(X, Y)):
            rows.append((0, T0 + dt.timedelta(minutes=30 * b), *x, y))
    pairs = spark.createDataFrame(rows, "site_id int, label_pane timestamp_ntz, tank_temperature double, "
                                  "weather_temperature double, weather_humidity double, "
                                  "weather_wind double, label double")
    stats = M.train_statistics(pairs, ["site_id"], scale=None)
    models = M.train_weights(stats, ["site_id"], scale=None).orderBy("version_ts").collect()
    assert len(models) == 3 and models[-1].n == 9
    first = (models[0].w_tank, models[0].w_temp, models[0].w_hum, models[0].w_wind)
    assert np.allclose(first, [0.97826, 0.91382, 0.05310, 0.13559], atol=5e-6)
    # scoring: a row before the first version uses the initial weights
    win = spark.createDataFrame([
        (0, 1, T0, 1.0, 1.0, 1.0, 1.0),
        (0, 2, T0 + dt.timedelta(hours=2), 1.0, 1.0, 1.0, 1.0)],
        "site_id int, msg_id long, window_end timestamp_ntz, tank_temperature double, "
        "weather_temperature double, weather_humidity double, weather_wind double")
    sm = spark.createDataFrame([(m.site_id, m.version_ts, m.w_tank, m.w_temp, m.w_hum, m.w_wind, 0.0)
                                for m in models],
                               "site_id int, version_ts timestamp_ntz, w_tank double, w_temp double, "
                               "w_hum double, w_wind double, intercept double")
    got = {r.msg_id: r for r in M.forecast_with_models(win, sm).collect()}
    assert abs(got[1].forecast - 2.3) < 1e-12 and got[1].model_version_ts is None
    last = models[-1]
    assert abs(got[2].forecast - (last.w_tank + last.w_temp + last.w_hum + last.w_wind)) < 1e-12


def test_scaled_training_reports_original_units(spark):
    # a scaled run is the same model expressed in original units
    rows = [(0, T0, *[v * 10 for v in x], y) for x, y in zip(X, Y)]
    pairs = spark.createDataFrame(rows, "site_id int, label_pane timestamp_ntz, tank_temperature double, "
                                  "weather_temperature double, weather_humidity double, "
                                  "weather_wind double, label double")
    stats = M.train_statistics(pairs, ["site_id"], scale=(10.0, 10.0, 10.0, 10.0))
    scaled = M.train_weights(stats, ["site_id"], initial=(0.1, 0.1, 0.01, 0.02),
                             scale=(10.0, 10.0, 10.0, 10.0)).first()
    assert np.allclose([scaled.w_tank * 10, scaled.w_temp * 10, scaled.w_hum * 10, scaled.w_wind * 10],
                       [0.97826, 0.91382, 0.05310, 0.13559], atol=5e-5)
    assert F is not None


def test_global_model(spark):
    rows = [(s, T0, *x, y) for s in (0, 1) for x, y in zip(X, Y)]
    pairs = spark.createDataFrame(rows, "site_id int, label_pane timestamp_ntz, tank_temperature double, "
                                  "weather_temperature double, weather_humidity double, "
                                  "weather_wind double, label double")
    stats = M.train_statistics(pairs, [], scale=None)
    assert stats.first().n == 6
    v = M.train_weights(stats, [], scale=None).first()
    # the same three points twice give the same gradient, so the same weights
    assert np.allclose([v.w_tank, v.w_temp, v.w_hum, v.w_wind], [0.97826, 0.91382, 0.05310, 0.13559],
                       atol=5e-6)
