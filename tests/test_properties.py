"""Order-insensitivity: the same rows in another partitioning and order give
the same result (no operator depends on arrival order)."""

import pytest
from pyspark.sql import functions as F

from tankcast.operators import control as C
from tankcast.operators import sensors as S
from tankcast.operators import training as M
from tankcast.operators.forecast import enrich_with_weather, tank_readings
from tankcast.plans.forecast import forecast
from tankcast.sources.fixtures import load_messages, load_weather, with_reset_flags

SF = "/root/testdata/sf0.001"


def shuffled(df, n, seed):
    return df.repartition(n).orderBy(F.rand(seed))


def same(a, b):
    cols = sorted(a.columns)
    return sorted(map(tuple, a.select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_order_insensitive(spark, seed):
    m, w = load_messages(spark, SF), load_weather(spark, SF)
    ms, ws = shuffled(m, 5, seed), shuffled(w, 3, seed)
    assert same(forecast(m, w), forecast(ms, ws))
    assert same(enrich_with_weather(tank_readings(m, "site"), w),
                enrich_with_weather(tank_readings(ms, "site"), ws, segment="10 minutes"))
    assert same(C.control_state(m, "site"), C.control_state(ms, "site", segment="3 hours"))
    assert same(M.training_pairs(tank_readings(m, "site"), w),
                M.training_pairs(tank_readings(ms, "site"), ws))
    v = with_reset_flags(m.withColumn("v", F.col("payload").cast("double")))
    vs = with_reset_flags(ms.withColumn("v", F.col("payload").cast("double")))
    assert same(S.change_only(v.select("device_id", "ts", "msg_id", "v"), ["device_id"], ["ts", "msg_id"], "v"),
                S.change_only(vs.select("device_id", "ts", "msg_id", "v"), ["device_id"], ["ts", "msg_id"], "v",
                              segment="1 day"))
    assert same(S.min_max_since_reset(v.select("device_id", "ts", "msg_id", "v", "is_reset"),
                                      ["device_id"], ["ts", "msg_id"], "v", "is_reset"),
                S.min_max_since_reset(vs.select("device_id", "ts", "msg_id", "v", "is_reset"),
                                      ["device_id"], ["ts", "msg_id"], "v", "is_reset", segment="2 hours"))
