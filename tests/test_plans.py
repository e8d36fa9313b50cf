"""Physical-plan properties the scale design relies on (read from the plans
Spark actually builds, so a regression shows up here, not at 100 TB)."""

import re

from tankcast.operators import sampling as W
from tankcast.operators import training as M
from tankcast.operators import views as V
from tankcast.operators.forecast import tank_readings
from tankcast.plans.catalog import QUERIES
from tankcast.plans.forecast import forecast
from tankcast.sources.fixtures import load_messages, load_weather
from tankcast.sources.messages import read_messages, write_messages

SF = "/root/testdata/sf0.01"


def plan_of(df, executed=False):
    if executed:
        df.collect()  # AQE's final plan (stage reuse, runtime joins)
    return df._jdf.queryExecution().executedPlan().toString()


def test_topic_and_time_filters_reach_the_scan(spark, scratch):
    write_messages(load_messages(spark, "/root/testdata/sf0.001"), f"{scratch}/log")
    df = read_messages(spark, f"{scratch}/log", "site", ["tank/temperature"],
                       start="2024-01-10", end="2024-01-12")
    p = plan_of(df)
    assert re.search(r"PushedFilters: \[[^\]]*topic", p)
    assert re.search(r"PushedFilters: \[[^\]]*ts", p)
    assert "ReadSchema" in p


def test_top_k_limits_before_the_shuffle(spark):
    m = load_messages(spark, SF).withColumnRenamed("payload", "value")
    p = plan_of(V.history_window(m, ["site_id", "topic"], "ts", "msg_id", 100, "48 hours"))
    assert re.search(r"WindowGroupLimit .* Partial", p)


def test_asof_windows_are_split_by_segment(spark):
    p = plan_of(forecast(load_messages(spark, SF), load_weather(spark, SF)))
    specs = re.findall(r"windowspecdefinition\(([^)]*)\)", p)
    assert specs
    # data windows are partitioned by (key, segment); the carry window runs
    # over one row per segment, ordered by it -- no window spans a whole key
    assert all("__seg" in spec for spec in specs), specs


def test_training_pairs_have_no_self_join(spark):
    pairs = M.training_pairs(tank_readings(load_messages(spark, SF), "site"), load_weather(spark, SF))
    p = plan_of(pairs)
    assert not re.search(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) \[[^\]]*label_pane", p)


def test_sampler_shuffles_the_data_once(spark):
    v = load_messages(spark, SF).selectExpr("device_id", "ts", "msg_id", "try_cast(payload as double) AS value")
    p = plan_of(W.min_interval_sample(v, ["device_id"], "ts", "msg_id", "2 hours", "6 hours"),
                executed=True)
    final = p.split("Initial Plan")[0]
    assert "ReusedExchange" in final


def test_resource_catalogue_is_the_only_forced_broadcast():
    import pathlib
    root = pathlib.Path(__file__).parent.parent.joinpath("tankcast")
    # the corpus operators bound theirs themselves (a limit, a count of ranges)
    src = "".join(p.read_text() for p in root.rglob("*.py") if root / "llm" not in p.parents)
    assert src.count("F.broadcast(") == 1


def test_topics_are_filtered_in_the_scan(spark):
    for name in ("message_source", "forecast_default", "range_conformance"):
        p = plan_of(QUERIES[name](spark, SF))
        assert re.search(r"PushedFilters: \[[^\]]*\(event_type", p), name


def test_history_never_shuffles_raw_rows_by_series(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = plan_of(QUERIES["history_window"](spark, SF))
        clear = plan_of(QUERIES["history_after_clear"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the newest points: no join, and a group limit below the exchange
    assert "Join" not in kept and re.search(r"WindowGroupLimit .* Partial", kept)
    # the data's window runs by (series, segment); joins are on both
    joins = re.findall(r"SortMergeJoin \[([^\]]*)\]", clear)
    assert joins and all("__seg" in j for j in joins)
