"""DuckDB SQL with the same meaning as each registered query.

The driver pre-registers the base tables (``events`` ...) as views; the
message and weather views of ``tankcast.sources.fixtures`` are repeated here
as CTEs.  Every computed column carries the same alias as in Spark.
"""

from __future__ import annotations

from tankcast.operators.control import HELD_SERIES, INITIAL_STATE
from tankcast.sources.catalogue import RESOURCES, RESOURCE_IDS
from tankcast.sources.fixtures import DEFAULT_PREFIX, EVENT_TOPICS, N_SITES

P = DEFAULT_PREFIX


def _topic_case() -> str:
    whens = " ".join(f"WHEN '{et}' THEN '{P}/{sfx}'" for et, sfx in EVENT_TOPICS.items())
    return f"CASE event_type {whens} END"


MESSAGES = f"""messages AS (
  SELECT event_id AS msg_id, user_id AS device_id,
         CAST(user_id % {N_SITES} AS INTEGER) AS site_id, ts,
         {_topic_case()} AS topic, CAST(value AS VARCHAR) AS payload
  FROM events)"""

WEATHER = f"""weather AS (
  SELECT event_id AS weather_id, CAST(user_id % {N_SITES} AS INTEGER) AS site_id, ts,
         value AS temperature,
         CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS DOUBLE) AS humidity,
         CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS DOUBLE) AS wind
  FROM events WHERE event_type = 'error')"""

READINGS = f"""readings AS (
  SELECT * FROM (
    SELECT msg_id, device_id, site_id, ts, TRY_CAST(payload AS DOUBLE) AS tank_temperature
    FROM messages WHERE topic = '{P}/tank/temperature') t
  WHERE tank_temperature IS NOT NULL)"""


def with_views(*ctes: str) -> str:
    return "WITH " + ",\n".join([MESSAGES, WEATHER, *ctes]) + "\n"


def r2(x: str) -> str:
    """P10 in SQL: floor(x*100+0.5)/100."""
    return f"(floor(({x}) * 100 + 0.5) / 100)"


def fc(t: str, a: str, h: str, w: str) -> str:
    """M1 with the default weights, evaluated left to right as in Spark."""
    return (f"({t} * CAST(1.0 AS DOUBLE) + {a} * CAST(1.0 AS DOUBLE) "
            f"+ {h} * CAST(0.1 AS DOUBLE) + {w} * CAST(0.2 AS DOUBLE))")


NEWEST_5S = """newest AS (
  SELECT device_id, window_start, window_start + INTERVAL '5 seconds' AS window_end,
         site_id, ts, msg_id, tank_temperature
  FROM (SELECT *, time_bucket(INTERVAL '5 seconds', ts) AS window_start,
               row_number() OVER (PARTITION BY device_id, time_bucket(INTERVAL '5 seconds', ts)
                                  ORDER BY ts DESC, msg_id DESC) AS rn
        FROM readings) x
  WHERE rn = 1)"""

ENRICHED = """enriched AS (
  SELECT n.*, COALESCE(w.temperature, 0.0) AS weather_temperature,
         COALESCE(w.humidity, 0.0) AS weather_humidity,
         COALESCE(w.wind, 0.0) AS weather_wind,
         w.weather_id IS NOT NULL AS weather_found
  FROM newest n ASOF LEFT JOIN weather w ON n.site_id = w.site_id AND n.ts >= w.ts)"""

FORECAST_DEFAULT = with_views(READINGS, NEWEST_5S, ENRICHED) + f"""
SELECT *, {fc('tank_temperature', 'weather_temperature', 'weather_humidity', 'weather_wind')} AS forecast,
       {r2(fc('tank_temperature', 'weather_temperature', 'weather_humidity', 'weather_wind'))} AS forecast_r2
FROM enriched"""


PARSED = """parsed AS (
  SELECT * FROM (SELECT *, TRY_CAST(payload AS DOUBLE) AS value FROM messages) t
  WHERE value IS NOT NULL)"""

_IDS = ", ".join(str(i) for i in list(RESOURCE_IDS) + [9999])
RESOURCE_PATH = f"""rp AS (
  SELECT msg_id, '/3300/' || CAST(device_id % 3 AS VARCHAR) || '/'
         || CAST(([{_IDS}])[msg_id % 10 + 1] AS VARCHAR) AS resource_path
  FROM messages)"""

RESOURCE_SPLIT = """rs AS (
  SELECT msg_id, resource_path,
         TRY_CAST(split_part(resource_path, '/', 2) AS INTEGER) AS object_id,
         TRY_CAST(split_part(resource_path, '/', 3) AS INTEGER) AS instance_id,
         TRY_CAST(split_part(resource_path, '/', 4) AS INTEGER) AS resource_id
  FROM rp)"""


def _values(rows):
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, int):
            return str(v)
        return "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


CATALOGUE = f"""cat(resource_id, resource_name, resource_type, operations, mandatory) AS (
  SELECT * FROM (VALUES {_values([(r[0], r[1], r[3], r[2], r[4]) for r in RESOURCES])}))"""

WEATHER_JSON = """wj AS (
  SELECT *, CASE WHEN weather_id % 10 = 0 THEN 'oops'
                 WHEN weather_id % 10 = 1 THEN '{"temperature":' || CAST(temperature AS VARCHAR) || '}'
                 ELSE '{"temperature":' || CAST(temperature AS VARCHAR) || ',"humidity":'
                      || CAST(humidity AS VARCHAR) || ',"wind":' || CAST(wind AS VARCHAR) || '}'
            END AS weather_json
  FROM weather)"""


def _jfield(doc: str, f: str) -> str:
    return (f"CASE WHEN json_valid({doc}) THEN COALESCE(TRY_CAST(json_extract({doc}, '$.{f}') AS DOUBLE), 0.0) "
            f"ELSE 0.0 END")


_DASH = ["tank/temperature", "tank/forecast", "boiler/enabled", "boiler/threshold",
         "boiler/threshold/set", "utility/enabled", "utility/threshold", "utility/threshold/set"]
_ROUTE_IDX = "CASE topic " + " ".join(f"WHEN '{P}/{s}' THEN {i}" for i, s in enumerate(_DASH, 1)) + " END"
_HELD = [("tank/temperature", "tank_temperature", "0.0"), ("tank/forecast", "tank_forecast", "0.0"),
         ("boiler/threshold/set", "boiler_threshold", "45.0"),
         ("utility/threshold/set", "utility_threshold", "60.0")]


def _held_sql(series, tick: str = "1 hour", tick_s: int = 3600) -> str:
    topics = ", ".join(f"'{P}/{s}'" for s, _, _ in series)
    ctes = [f"""ctl AS (SELECT site_id, ts, msg_id, topic, TRY_CAST(payload AS DOUBLE) AS v
               FROM messages WHERE topic IN ({topics}))""",
            f"""bounds AS (SELECT site_id, time_bucket(INTERVAL '{tick}', min(ts)) AS g0, max(ts) AS g1
               FROM ctl GROUP BY site_id)""",
            f"""ticks AS (SELECT site_id, g0, unnest(generate_series(g0, g1, INTERVAL '{tick}')) AS tick
               FROM bounds)"""]
    for i, (s, c, _) in enumerate(series):
        ctes.append(f"s{i} AS (SELECT site_id, ts, v FROM ctl WHERE topic = '{P}/{s}' AND v IS NOT NULL)")
    cols = ", ".join(f"COALESCE(s{i}.v, {d}) AS {c}" for i, (_, c, d) in enumerate(series))
    joins = " ".join(f"ASOF LEFT JOIN s{i} ON t.site_id = s{i}.site_id AND t.tick >= s{i}.ts"
                     for i in range(len(series)))
    ctes.append(f"""held AS (SELECT t.site_id, t.tick,
               CAST(date_diff('second', t.g0, t.tick) // {tick_s} AS BIGINT) AS tick_index, {cols}
               FROM ticks t {joins})""")
    return with_views(*ctes)


_CTRL_RULES = """, ctrl AS (
  SELECT *, tank_temperature < boiler_threshold AS boiler_enabled,
         tank_forecast > utility_threshold AS utility_enabled,
         NOT (tank_temperature < boiler_threshold) AS boiler_pin,
         NOT (tank_forecast > utility_threshold) AS utility_pin,
         tick_index % 6 = 5 AS full_status
  FROM held)
"""
CONTROL = _held_sql(_HELD) + _CTRL_RULES
_CTRL_COLS = """
SELECT site_id, tick, tick_index, tank_temperature, tank_forecast, boiler_threshold,
       utility_threshold, boiler_enabled, utility_enabled, boiler_pin, utility_pin
FROM ctrl"""

_STATUS = [("tank/temperature", "tank_temperature"), ("boiler/enabled", "boiler_enabled"),
           ("boiler/threshold", "boiler_threshold"), ("utility/enabled", "utility_enabled"),
           ("utility/threshold", "utility_threshold")]

PANE_NEWEST = """pn AS (
  SELECT site_id, pane, ts, msg_id, device_id, tank_temperature FROM (
    SELECT *, time_bucket(INTERVAL '30 minutes', ts) AS pane,
           row_number() OVER (PARTITION BY site_id, time_bucket(INTERVAL '30 minutes', ts)
                              ORDER BY ts DESC, msg_id DESC) AS rn FROM readings) x
  WHERE rn = 1)"""
PANE_ENRICHED = """pe AS (
  SELECT pn.*, COALESCE(w.temperature, 0.0) AS weather_temperature,
         COALESCE(w.humidity, 0.0) AS weather_humidity, COALESCE(w.wind, 0.0) AS weather_wind
  FROM pn ASOF LEFT JOIN weather w ON pn.site_id = w.site_id AND pn.ts >= w.ts)"""
PAIRS = """pairs AS (
  SELECT f.site_id, l.pane AS label_pane, f.pane AS feature_pane, f.tank_temperature,
         f.weather_temperature, f.weather_humidity, f.weather_wind, l.tank_temperature AS label,
         l.weather_temperature AS current_temperature, l.weather_humidity AS current_humidity,
         l.weather_wind AS current_wind
  FROM pe f JOIN pe l ON f.site_id = l.site_id AND l.pane = f.pane + INTERVAL '3 hours')"""
_PAIR_COLS = ("site_id, label_pane, feature_pane, tank_temperature, weather_temperature, "
              "weather_humidity, weather_wind, label")
_SCALE = (500.0, 500.0, 100.0, 10.0)
_FEATS = ("tank_temperature", "weather_temperature", "weather_humidity", "weather_wind")
_DOC_FEATS = (*_FEATS, "current_temperature", "current_humidity", "current_wind")
_DOC_SCALE = (*_SCALE, 500.0, 100.0, 10.0)
_START = ("CAST(1.0 AS DOUBLE)", "CAST(1.0 AS DOUBLE)", "CAST(0.1 AS DOUBLE)", "CAST(0.2 AS DOUBLE)",
          *["CAST(0.0 AS DOUBLE)"] * 3)
_WEIGHTS = ("w_tank", "w_temp", "w_hum", "w_wind", "w_current_temp", "w_current_hum", "w_current_wind")


def _stats_sql(feats=_FEATS, scale=_SCALE) -> str:
    x = [f"({c} / CAST({d} AS DOUBLE))" for c, d in zip(feats, scale)]
    d = range(len(x))
    return ", ".join(["CAST(count(*) AS BIGINT) AS n"] + [f"sum({x[i]} * {x[j]}) AS xx_{i}{j}" for i in d for j in d if j >= i]
                     + [f"sum({x[i]} * label) AS xy_{i}" for i in d])


_STATS = _stats_sql()

SQL: dict[str, str] = {
    "forecast_default": FORECAST_DEFAULT,
    "message_source": with_views() + f"""
SELECT * FROM messages WHERE topic IN ('{P}/tank/temperature', '{P}/tank/forecast')""",
    "weather_enrich": with_views(READINGS) + """
SELECT r.*, COALESCE(w.temperature, 0.0) AS weather_temperature,
       COALESCE(w.humidity, 0.0) AS weather_humidity, COALESCE(w.wind, 0.0) AS weather_wind,
       w.weather_id IS NOT NULL AS weather_found
FROM readings r ASOF LEFT JOIN weather w ON r.site_id = w.site_id AND r.ts >= w.ts""",
    "last_in_window": with_views(PARSED) + """
SELECT site_id, topic, window_start, window_start + INTERVAL '30 minutes' AS window_end, ts, msg_id, value
FROM (SELECT *, time_bucket(INTERVAL '30 minutes', ts) AS window_start,
             row_number() OVER (PARTITION BY site_id, topic, time_bucket(INTERVAL '30 minutes', ts)
                                ORDER BY ts DESC, msg_id DESC) AS rn FROM parsed) x
WHERE rn = 1""",
    "sliding_first_last": with_views(READINGS, """w AS (
  SELECT site_id, ts, msg_id, tank_temperature,
         time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes' * i AS window_start
  FROM (SELECT *, unnest(generate_series(0, 5)) AS i FROM readings) e)""", """g AS (
  SELECT *, count(*) OVER (PARTITION BY site_id, window_start) AS n,
         row_number() OVER (PARTITION BY site_id, window_start ORDER BY ts DESC, msg_id DESC) AS rd,
         row_number() OVER (PARTITION BY site_id, window_start ORDER BY ts, msg_id) AS ra
  FROM w)""") + """
SELECT a.site_id, a.window_start, a.window_start + INTERVAL '3 hours' AS window_end, a.n,
       a.ts AS newest_ts, a.msg_id AS newest_id, a.tank_temperature AS newest_value,
       b.ts AS oldest_ts, b.msg_id AS oldest_id, b.tank_temperature AS oldest_value
FROM g a JOIN g b ON a.site_id = b.site_id AND a.window_start = b.window_start
WHERE a.rd = 1 AND b.ra = 1""",
    "payload_decode": with_views() + """
SELECT msg_id, decode(encode(payload)) AS payload_text FROM messages""",
    "payload_parse": with_views() + """
SELECT msg_id, payload_dirty, TRY_CAST(payload_dirty AS DOUBLE) AS value
FROM (SELECT msg_id, CASE WHEN msg_id % 7 = 0 THEN 'x' || payload ELSE payload END AS payload_dirty
      FROM messages) d""",
    "payload_quarantine": with_views() + """
SELECT msg_id, topic, payload_dirty
FROM (SELECT msg_id, topic, CASE WHEN msg_id % 7 = 0 THEN 'x' || payload ELSE payload END AS payload_dirty
      FROM messages) d
WHERE payload_dirty IS NOT NULL AND TRY_CAST(payload_dirty AS DOUBLE) IS NULL""",
    "weather_json_parse": with_views(WEATHER_JSON) + f"""
SELECT weather_id, site_id, ts, weather_json,
       {_jfield('weather_json', 'temperature')} AS temperature,
       {_jfield('weather_json', 'humidity')} AS humidity,
       {_jfield('weather_json', 'wind')} AS wind
FROM wj""",
    "weather_json_roundtrip": with_views() + """
SELECT weather_id,
       CAST(to_json({'temperature': temperature, 'humidity': humidity, 'wind': wind}) AS VARCHAR) AS weather_doc,
       TRUE AS temperature_same, TRUE AS humidity_same, TRUE AS wind_same
FROM weather""",
    "device_hex": with_views() + """
SELECT msg_id, device_id, printf('%016x', device_id) AS device_hex FROM messages""",
    "round_half_up2": with_views(PARSED) + f"""
SELECT msg_id, value / 8 AS x, {r2('value / 8')} AS x_r2 FROM parsed""",
    "weather_factor": with_views() + f"""
SELECT weather_id, site_id, ts,
       {r2('temperature * CAST(1.0 AS DOUBLE) + humidity * CAST(0.1 AS DOUBLE) + wind * CAST(0.2 AS DOUBLE)')} AS weather_factor
FROM weather""",
    "topic_subtree": with_views() + f"""
SELECT msg_id, topic_tree FROM (
  SELECT msg_id, CASE WHEN msg_id % 11 = 0 THEN '{P}2/x' WHEN msg_id % 11 = 1 THEN '{P}'
                      ELSE topic END AS topic_tree FROM messages) t
WHERE topic_tree = '{P}' OR starts_with(topic_tree, '{P}/')""",
    "topic_route": with_views() + f"""
SELECT msg_id, topic, route_index, ([{", ".join(f"'{s}'" for s in _DASH)}])[route_index] AS route
FROM (SELECT msg_id, topic, {_ROUTE_IDX} AS route_index FROM messages) t
WHERE route_index IS NOT NULL""",
    "command_guard": with_views() + f"""
SELECT msg_id, split_part(topic, '/', 2) AS widget, payload,
       '{P}/' || split_part(topic, '/', 2) || '/threshold/set' AS topic
FROM messages
WHERE topic IN ('{P}/boiler/threshold/set', '{P}/utility/threshold/set') AND msg_id % 3 = 0""",
    "publish_forecast": with_views(READINGS, NEWEST_5S, ENRICHED) + f"""
SELECT device_id, site_id, '{P}/tank/forecast' AS topic,
       CAST({fc('tank_temperature', 'weather_temperature', 'weather_humidity', 'weather_wind')} AS VARCHAR) AS payload,
       ts
FROM enriched""",
    "resource_path_split": with_views(RESOURCE_PATH, RESOURCE_SPLIT) + """
SELECT * FROM rs""",
    "latest_per_topic": with_views() + """
SELECT site_id, topic, ts, msg_id, payload, n_messages FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id, topic ORDER BY ts DESC, msg_id DESC) AS rn,
         count(*) OVER (PARTITION BY site_id, topic) AS n_messages FROM messages) t
WHERE rn = 1""",
    "tick_sample_hold": _held_sql(_HELD[:1]) + """
SELECT * FROM held""",
    "control_state": CONTROL + """
SELECT site_id, tick, tick_index, tank_temperature, tank_forecast, boiler_threshold,
       utility_threshold, boiler_enabled, utility_enabled, boiler_pin, utility_pin
FROM ctrl""",
    "status_cadence": CONTROL + """
SELECT site_id, tick, tick_index, full_status FROM ctrl""",
    "publish_status": CONTROL + " " + " UNION ALL ".join(
        f"SELECT site_id, tick AS ts, '{P}/{s}' AS topic, CAST({c} AS VARCHAR) AS payload FROM ctrl"
        + ("" if s == "tank/temperature" else " WHERE full_status") for s, c in _STATUS),
    "threshold_history": with_views() + f"""
SELECT site_id, topic, msg_id, ts AS valid_from,
       lead(ts) OVER (PARTITION BY site_id, topic ORDER BY ts, msg_id) AS valid_to, threshold
FROM (SELECT site_id, topic, msg_id, ts, TRY_CAST(payload AS DOUBLE) AS threshold FROM messages
      WHERE topic IN ('{P}/boiler/threshold/set', '{P}/utility/threshold/set')) t
WHERE threshold IS NOT NULL""",
    "history_window": with_views(PARSED) + """
SELECT * FROM (
  SELECT site_id, topic, ts, msg_id, value,
         row_number() OVER (PARTITION BY site_id, topic ORDER BY ts DESC, msg_id DESC) AS point_rank,
         strftime(ts, '%H:%M:%S') AS time_label
  FROM (SELECT *, max(ts) OVER (PARTITION BY site_id, topic) AS mx FROM parsed) a
  WHERE ts >= mx - INTERVAL '48 hours') b
WHERE point_rank <= 100""",
    "history_after_clear": with_views() + """
SELECT site_id, topic, ts, msg_id, payload, is_clear FROM (
  SELECT *, max(CASE WHEN is_clear THEN (ts, msg_id) END) OVER (PARTITION BY site_id, topic) AS lc
  FROM (SELECT site_id, topic, ts, msg_id, payload, msg_id % 500 = 0 AS is_clear FROM messages) m) t
WHERE lc IS NULL OR (ts, msg_id) > lc""",
    "change_only": with_views(PARSED) + """
SELECT device_id, ts, msg_id, held_value, previous_value FROM (
  SELECT *, COALESCE(lag(held_value) OVER (PARTITION BY device_id ORDER BY ts, msg_id), 0.0) AS previous_value
  FROM (SELECT device_id, ts, msg_id, CAST(floor(value / 50) AS DOUBLE) AS held_value FROM parsed) p) t
WHERE held_value <> previous_value""",
    "range_conformance": with_views(READINGS) + """
SELECT msg_id, device_id, tank_temperature, tank_temperature BETWEEN -55.0 AND 125.0 AS in_range
FROM readings""",
    "resource_lookup": with_views(RESOURCE_PATH, RESOURCE_SPLIT, CATALOGUE) + """
SELECT rs.*, cat.resource_name, cat.resource_type, cat.operations, cat.mandatory
FROM rs LEFT JOIN cat ON rs.object_id = 3300 AND rs.resource_id = cat.resource_id""",
    "min_max_since_reset": with_views(PARSED) + """
SELECT *, min(value) OVER (PARTITION BY device_id, reset_epoch ORDER BY ts, msg_id ROWS UNBOUNDED PRECEDING) AS min_since_reset,
          max(value) OVER (PARTITION BY device_id, reset_epoch ORDER BY ts, msg_id ROWS UNBOUNDED PRECEDING) AS max_since_reset
FROM (SELECT *, CAST(sum(CAST(is_reset AS BIGINT)) OVER (PARTITION BY device_id ORDER BY ts, msg_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS reset_epoch
      FROM (SELECT device_id, ts, msg_id, value, msg_id % 100 = 0 AS is_reset FROM parsed) p) e""",
    "training_pairs": with_views(READINGS, PANE_NEWEST, PANE_ENRICHED, PAIRS) + f"""
SELECT {_PAIR_COLS} FROM pairs""",
    "training_pairs_documented": with_views(READINGS, PANE_NEWEST, PANE_ENRICHED, PAIRS) + f"""
SELECT {_PAIR_COLS}, current_temperature, current_humidity, current_wind FROM pairs""",
    "label_filter": with_views(READINGS, PANE_NEWEST, PANE_ENRICHED, PAIRS) + f"""
SELECT {_PAIR_COLS} FROM pairs WHERE NOT isnan(label) AND label IS NOT NULL""",
    "feature_vector": with_views(READINGS, NEWEST_5S, ENRICHED) + """
SELECT device_id, window_start, tank_temperature AS feature_0, weather_temperature AS feature_1,
       weather_humidity AS feature_2, weather_wind AS feature_3 FROM enriched""",
    "train_statistics": with_views(READINGS, PANE_NEWEST, PANE_ENRICHED, PAIRS) + f"""
SELECT site_id, label_pane AS batch, {_STATS} FROM pairs
WHERE NOT isnan(label) AND label IS NOT NULL GROUP BY site_id, label_pane""",
    "min_interval_sample": "WITH RECURSIVE " + ",\n".join([MESSAGES, WEATHER, PARSED]) + """,
nx AS (
  SELECT p.device_id, p.ts, p.msg_id, p.value, q.msg_id AS next_id
  FROM parsed p ASOF LEFT JOIN
       (SELECT device_id, ts - INTERVAL '2 hours' AS ts_back, msg_id FROM parsed) q
       ON p.device_id = q.device_id AND q.ts_back > p.ts),
chain AS (
  SELECT * FROM nx WHERE (device_id, ts, msg_id) IN (
    SELECT (device_id, ts, msg_id) FROM (
      SELECT device_id, ts, msg_id,
             row_number() OVER (PARTITION BY device_id ORDER BY ts, msg_id) AS rn FROM parsed) f
    WHERE rn = 1)
  UNION ALL
  SELECT nx.* FROM chain JOIN nx ON nx.msg_id = chain.next_id)
SELECT device_id, ts, msg_id, value FROM chain""",
}


def _sgd_sql() -> str:
    """One mini-batch of SGD as a recursive CTE (M2 oracle)."""
    init = ("CAST(1.0 AS DOUBLE) * 500.0", "CAST(1.0 AS DOUBLE) * 500.0",
            "CAST(0.1 AS DOUBLE) * 100.0", "CAST(0.2 AS DOUBLE) * 10.0")

    def xx(i, j):
        return f"fb.xx_{min(i, j)}{max(i, j)}"
    grads = [" + ".join(f"{xx(k, j)} * it.w{j}" for j in range(4)) for k in range(4)]
    new = [f"it.w{k} - (CAST(0.1 AS DOUBLE) / sqrt(it.i + 1)) * (({grads[k]} - fb.xy_{k}) / fb.n) AS n{k}"
           for k in range(4)]
    diff = " + ".join(f"(s.n{k} - s.w{k}) * (s.n{k} - s.w{k})" for k in range(4))
    norm = " + ".join(f"s.n{k} * s.n{k}" for k in range(4))
    ctes = [READINGS, PANE_NEWEST, PANE_ENRICHED, PAIRS,
            f"""st AS (SELECT site_id, label_pane AS batch, {_STATS} FROM pairs
               WHERE NOT isnan(label) AND label IS NOT NULL GROUP BY site_id, label_pane)""",
            "fb AS (SELECT * FROM st)",
            f"""it AS (
               SELECT site_id, batch, 0 AS i, {init[0]} AS w0, {init[1]} AS w1, {init[2]} AS w2,
                      {init[3]} AS w3, FALSE AS done FROM fb
               UNION ALL
               SELECT s.site_id, s.batch, s.i + 1, s.n0, s.n1, s.n2, s.n3,
                      (s.i + 1 >= 2 AND sqrt({diff}) < CAST(0.001 AS DOUBLE) * greatest(sqrt({norm}), 1.0))
               FROM (SELECT it.*, {", ".join(new)} FROM it JOIN fb ON it.site_id = fb.site_id AND it.batch = fb.batch
                     WHERE NOT it.done AND it.i < 50) s)"""]
    return "WITH RECURSIVE " + ",\n".join([MESSAGES, WEATHER, *ctes]) + """
SELECT it.site_id, it.batch + INTERVAL '30 minutes' AS version_ts,
       round(w0 / 500.0, 4) AS w_tank, round(w1 / 500.0, 4) AS w_temp,
       round(w2 / 100.0, 4) AS w_hum, round(w3 / 10.0, 4) AS w_wind
FROM (SELECT *, row_number() OVER (PARTITION BY site_id, batch ORDER BY i DESC) AS rn FROM it) it
WHERE rn = 1"""


SQL["train_first_batch"] = _sgd_sql()


def _history_sql(age: str) -> str:
    return with_views(PARSED) + f"""
SELECT * FROM (
  SELECT site_id, topic, ts, msg_id, value,
         row_number() OVER (PARTITION BY site_id, topic ORDER BY ts DESC, msg_id DESC) AS point_rank,
         strftime(ts, '%H:%M:%S') AS time_label
  FROM (SELECT *, max(ts) OVER (PARTITION BY site_id, topic) AS mx FROM parsed) a
  WHERE ts >= mx - INTERVAL '{age}') b
WHERE point_rank <= 100"""


def _sample_sql(interval: str) -> str:
    return SQL["min_interval_sample"].replace("INTERVAL '2 hours'", f"INTERVAL '{interval}'")


SQL["history_window_1h"] = _history_sql("1 hour")
SQL["min_interval_sample_5s"] = _sample_sql("5 seconds")
SQL["control_state_1m"] = _held_sql(_HELD, "1 minute", 60) + _CTRL_RULES + _CTRL_COLS


def _fold_ctes(key: str = "site_id", key_expr: str = "site_id", feats=_FEATS, scale=_SCALE) -> list[str]:
    """The whole SGD fold (M2) as one recursive CTE: a state (batch k, step i,
    weights) moves one gradient step per level, and to the next batch when it
    converges or after 50 steps.  Same float operations, same order as the
    Spark-side fold, so the weights agree exactly."""
    d = range(len(feats))
    init = ", ".join(f"{_START[k]} * {scale[k]} AS w{k}" for k in d)
    norm_cols = ", ".join([f"xx_{i}{j} / n AS s{i}{j}" for i in d for j in d if j >= i] + [f"xy_{i} / n AS b{i}" for i in d])

    def sv(i, j):
        return f"bn.s{min(i, j)}{max(i, j)}"
    grads = [" + ".join(f"{sv(k, j)} * it.w{j}" for j in d) + f" - bn.b{k}" for k in d]
    new = ", ".join(f"it.w{k} - (CAST(0.1 AS DOUBLE) / sqrt(it.i + 1)) * ({grads[k]}) AS n{k}" for k in d)
    diff = " + ".join(f"(x.n{k} - x.w{k}) * (x.n{k} - x.w{k})" for k in d)
    norm = " + ".join(f"x.n{k} * x.n{k}" for k in d)
    done = f"(x.i + 1 >= 2 AND sqrt({diff}) < CAST(0.001 AS DOUBLE) * greatest(sqrt({norm}), 1.0)) OR x.i + 1 >= 50"
    ctes = [READINGS, PANE_NEWEST, PANE_ENRICHED, PAIRS,
            f"""st AS (SELECT {key_expr} AS {key}, label_pane AS batch, {_stats_sql(feats, scale)} FROM pairs
               WHERE NOT isnan(label) AND label IS NOT NULL GROUP BY 1, label_pane)""",
            f"""bn AS (SELECT {key}, batch, n,
               row_number() OVER (PARTITION BY {key} ORDER BY batch) AS k,
               count(*) OVER (PARTITION BY {key}) AS nb,
               CAST(sum(n) OVER (PARTITION BY {key} ORDER BY batch ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_total,
               {norm_cols} FROM st)""",
            f"""it AS (
               SELECT {key}, CAST(1 AS BIGINT) AS k, 0 AS i, {init} FROM bn WHERE k = 1
               UNION ALL
               SELECT x.{key},
                      CASE WHEN {done} THEN x.k + 1 ELSE x.k END,
                      CASE WHEN {done} THEN 0 ELSE x.i + 1 END,
                      {", ".join(f"x.n{k}" for k in d)}
               FROM (SELECT it.*, {new} FROM it JOIN bn ON it.{key} = bn.{key} AND it.k = bn.k) x)"""]
    ctes.append(f"""models AS (
  SELECT it.{key}, {", ".join(f"w{k} / {scale[k]} AS {_WEIGHTS[k]}" for k in d)},
         CAST(0.0 AS DOUBLE) AS intercept, bn.n_total AS n,
         bn.batch + INTERVAL '30 minutes' AS version_ts
  FROM it JOIN bn ON it.{key} = bn.{key} AND it.k = bn.k + 1
  WHERE it.i = 0)""")
    return ctes


def _fold_sql() -> str:
    return "WITH RECURSIVE " + ",\n".join([MESSAGES, WEATHER, *_fold_ctes()]) + """
SELECT site_id, w_tank, w_temp, w_hum, w_wind, intercept, n, version_ts FROM models"""


def _forecast_trained_sql() -> str:
    """M3: each 5 s window scored with the newest model version at or before
    its end; the default weights before the first version."""
    f = ("e.tank_temperature * COALESCE(m.w_tank, 1.0) + e.weather_temperature * COALESCE(m.w_temp, 1.0) "
         "+ e.weather_humidity * COALESCE(m.w_hum, CAST(0.1 AS DOUBLE)) "
         "+ e.weather_wind * COALESCE(m.w_wind, CAST(0.2 AS DOUBLE)) + COALESCE(m.intercept, 0.0)")
    return "WITH RECURSIVE " + ",\n".join([MESSAGES, WEATHER, *_fold_ctes(), NEWEST_5S, ENRICHED]) + f"""
SELECT e.*, COALESCE(m.w_tank, 1.0) AS w_tank, COALESCE(m.w_temp, 1.0) AS w_temp,
       COALESCE(m.w_hum, CAST(0.1 AS DOUBLE)) AS w_hum, COALESCE(m.w_wind, CAST(0.2 AS DOUBLE)) AS w_wind,
       COALESCE(m.intercept, 0.0) AS intercept, m.version_ts AS model_version_ts,
       {f} AS forecast, {r2(f)} AS forecast_r2
FROM enriched e ASOF LEFT JOIN models m ON e.site_id = m.site_id AND e.window_end >= m.version_ts"""


def _documented_sql(scored: bool) -> str:
    """The seven-feature model, and each 5 s window scored with its newest
    version and the weather three hours after the reading."""
    ctes = [MESSAGES, WEATHER, *_fold_ctes(feats=_DOC_FEATS, scale=_DOC_SCALE)]
    if not scored:
        return "WITH RECURSIVE " + ",\n".join(ctes) + f"""
SELECT site_id, {", ".join(_WEIGHTS)}, intercept, n, version_ts FROM models"""
    ctes += [NEWEST_5S, ENRICHED, """later AS (
  SELECT e.* EXCLUDE (weather_found), COALESCE(w.temperature, 0.0) AS current_temperature,
         COALESCE(w.humidity, 0.0) AS current_humidity, COALESCE(w.wind, 0.0) AS current_wind
  FROM enriched e ASOF LEFT JOIN weather w ON e.site_id = w.site_id AND e.ts + INTERVAL '3 hours' >= w.ts)"""]
    w = [f"COALESCE(m.{n}, {s})" for n, s in zip(_WEIGHTS, _START)]
    f = " + ".join(f"e.{c} * {x}" for c, x in zip(_DOC_FEATS, w)) + " + COALESCE(m.intercept, 0.0)"
    return "WITH RECURSIVE " + ",\n".join(ctes) + f"""
SELECT e.*, {", ".join(f"{x} AS {n}" for n, x in zip(_WEIGHTS, w))},
       COALESCE(m.intercept, 0.0) AS intercept, m.version_ts AS model_version_ts, {f} AS forecast, {r2(f)} AS forecast_r2
FROM later e ASOF LEFT JOIN models m ON e.site_id = m.site_id AND e.window_end >= m.version_ts"""


SQL["train_weights_documented"] = _documented_sql(False)
SQL["forecast_documented"] = _documented_sql(True)
SQL["train_weights"] = _fold_sql()
SQL["forecast_trained"] = _forecast_trained_sql()


def _fold_global_sql() -> str:
    ctes = _fold_ctes("model_key", "'global'")
    return "WITH RECURSIVE " + ",\n".join([MESSAGES, WEATHER, *ctes]) + """
SELECT model_key, version_ts, n, round(w_tank, 6) AS w_tank, round(w_temp, 6) AS w_temp,
       round(w_hum, 6) AS w_hum, round(w_wind, 6) AS w_wind FROM models"""


SQL["train_weights_global"] = _fold_global_sql()


def _final(query: str, end: str) -> str:
    """Rows of windows that ended by the watermark: ten minutes before the
    newest reading, in whole milliseconds."""
    return f"""SELECT * FROM ({query}) q WHERE {end} <= (
  SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '10 minutes' FROM events
  WHERE event_type = 'view' AND value IS NOT NULL)"""


def _control_sql() -> str:
    """Newest value of each held series up to every message, its initial value
    before the first; a rule with NaN on either side is off."""
    held = ", ".join(
        f"COALESCE(last_value(CASE WHEN topic = '{P}/{s}' THEN value END IGNORE NULLS) OVER w, "
        f"CAST({INITIAL_STATE[c]} AS DOUBLE)) AS {c}" for s, c in HELD_SERIES.items())
    topics = ", ".join(f"'{P}/{s}'" for s in HELD_SERIES)
    return with_views(PARSED, f"""held AS (
  SELECT site_id, ts, msg_id, {held} FROM parsed WHERE topic IN ({topics})
  WINDOW w AS (PARTITION BY site_id ORDER BY ts, msg_id ROWS UNBOUNDED PRECEDING))""", """ruled AS (
  SELECT *, NOT isnan(tank_temperature) AND NOT isnan(boiler_threshold)
              AND tank_temperature < boiler_threshold AS boiler_enabled,
         NOT isnan(tank_forecast) AND NOT isnan(utility_threshold)
              AND tank_forecast > utility_threshold AS utility_enabled FROM held)""") + """
SELECT *, NOT boiler_enabled AS boiler_pin, NOT utility_enabled AS utility_pin FROM ruled"""


SQL |= {
    "stream_forecast": _final(SQL["forecast_default"], "window_end"),
    "stream_sliding": _final(SQL["sliding_first_last"], "window_end"),
    "stream_training": _final(SQL["train_weights"], "version_ts"),
    "stream_control": _control_sql(),
    "stream_change": SQL["change_only"],
    "stream_latest": SQL["latest_per_topic"],
    "message_log": SQL["message_source"],
    "weather_source": with_views() + "SELECT * FROM weather",
}


def _tick_control_sql() -> str:
    """The control state on each tick of every site up to the stream's watermark."""
    until = ("(SELECT date_trunc('milliseconds', max(ts) - INTERVAL '1 microsecond') - INTERVAL '10 minutes' FROM ctl)")
    ctrl = (_held_sql(_HELD) + _CTRL_RULES).replace("max(ts) AS g1", f"{until} AS g1")
    return ctrl + _CTRL_COLS.replace("utility_pin", "utility_pin, full_status")


SQL |= {
    "stream_tick_control": _tick_control_sql(),
    "stream_weather_enrich": f"""SELECT * FROM ({SQL['weather_enrich']}) q WHERE ts <= (
  SELECT date_trunc('milliseconds', least(max(ts) FILTER (WHERE event_type = 'view' AND value IS NOT NULL),
         max(ts) FILTER (WHERE event_type = 'error'))) - INTERVAL '10 minutes' FROM events)""",
}


SQL |= {
    "stream_extremes": SQL["min_max_since_reset"],
    "stream_sample": SQL["min_interval_sample"],
    "stream_history": SQL["history_window"],
    "stream_change_log": SQL["change_only"],
    "stream_restart": SQL["stream_tick_control"],
    # a batch's watermark lies eight hours before the newest time of the batches before it
    "stream_late_rows": """
WITH e AS (SELECT event_id % 12 AS batch_id, ts FROM events),
b AS (SELECT batch_id, max(max(ts)) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
             - INTERVAL '8 hours' AS passed FROM e GROUP BY batch_id)
SELECT CAST(batch_id AS BIGINT) AS batch_id, count(*) FILTER (WHERE passed IS NULL OR ts IS NULL OR ts > passed) AS n_kept,
       count(*) FILTER (WHERE ts <= passed) AS n_late FROM e JOIN b USING (batch_id) GROUP BY batch_id""",
}
SQL |= {"topic_log_sink": SQL["message_source"], "topic_log_source": SQL["message_source"]}
