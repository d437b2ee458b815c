"""The same results in SQL, for a check by another engine."""

from __future__ import annotations

SENSOR = """sensor AS (
  SELECT event_id, user_id, 1704067200 + event_id AS t, event_id % 8 AS series,
         1704067200 + event_id // 8 AS kt, epoch_us(ts) AS us,
         CASE WHEN event_id % 5 = 0 THEN 'predictions' ELSE 'temperature_modbus' END AS topic,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS set_t,
         CAST(trunc(value) AS INTEGER) AS v_t
  FROM events)"""


def scaled(source: str = "sensor", bounds_of: str = "sensor", by: str = "", name: str = "scaled"):
    """CTEs: bounds over one relation, applied to another."""
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    on = f"JOIN {name}_bounds b USING ({by})" if by else f"CROSS JOIN {name}_bounds b"
    return f"""{name}_bounds AS (
  SELECT {keys}min(set_t) AS a0, max(set_t) AS b0, min(v_t) AS a1, max(v_t) AS b1
  FROM {bounds_of}{group}),
{name} AS (
  SELECT s.*,
         CASE WHEN b0 = a0 THEN 0.5 ELSE (s.set_t - a0) / CAST(b0 - a0 AS DOUBLE) END AS x0,
         CASE WHEN b1 = a1 THEN 0.5 ELSE (s.v_t - a1) / CAST(b1 - a1 AS DOUBLE) END AS x1
  FROM {source} s {on})"""


def windowed(source: str = "scaled", t: str = "t", by: str = "", name: str = "win"):
    """CTE: every point once per 20 s / 1 s window, with its place in the window."""
    keys = f"{by}, " if by else ""
    return f"""{name} AS (
  SELECT {keys}{t} - k AS ws, x0, x1,
         row_number() OVER (PARTITION BY {keys}{t} - k ORDER BY {t}, event_id) - 1 AS pos,
         count(*) OVER (PARTITION BY {keys}{t} - k) AS n
  FROM {source}, range(0, 20) AS r(k))"""


def row_windowed(source: str, order: str, by: str = "", name: str = "seq"):
    """CTE: every row with its 19 followers."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    same = f" AND a.{by} = b.{by}" if by else ""
    first = f"a.{by}, " if by else ""
    return f"""{name}_idx AS (
  SELECT {keys}event_id, x0, x1, row_number() OVER ({part}ORDER BY {order}) AS rn,
         count(*) OVER ({part}) AS n
  FROM {source}),
{name} AS (
  SELECT {first}a.event_id AS first_event, k AS pos, b.x0, b.x1
  FROM {name}_idx a, range(0, 20) AS r(k), {name}_idx b
  WHERE b.rn = a.rn + k{same} AND a.rn + 19 <= a.n)"""


def errors(source: str, key: str, name: str, where: str = ""):
    """CTE: mean absolute deviation from the mean, per sequence and channel."""
    return f"""{name} AS (
  SELECT {key}, round(avg(abs(x0 - m0)), 12) AS e0, round(avg(abs(x1 - m1)), 12) AS e1
  FROM (SELECT *, avg(x0) OVER (PARTITION BY {key}) AS m0, avg(x1) OVER (PARTITION BY {key}) AS m1
        FROM {source}{where}) d
  GROUP BY {key})"""


HISTORY = "hist AS (SELECT * FROM sensor WHERE topic = 'temperature_modbus')"

# Threshold from the history's row sequences, scores of all windows.
FITTED = ",\n".join(
    [
        SENSOR,
        HISTORY,
        scaled("hist", "hist", name="hs"),
        row_windowed("hs", "t, event_id", name="train"),
        errors("train", "first_event", "train_errors"),
        "thr AS (SELECT max(e0) AS t0, max(e1) AS t1 FROM train_errors)",
    ]
)
JUMPED = """jumped AS (
  SELECT * REPLACE (v_t + CASE WHEN event_id % 500 = 0 THEN 1000 ELSE 0 END AS v_t) FROM sensor)"""


def scored(source: str = "sensor", *before: str) -> str:
    """CTEs up to ``scores``: every complete window of a relation, judged by the history."""
    return ",\n".join(
        [
            FITTED,
            *before,
            scaled(source, "hist"),
            windowed(),
            errors("win", "ws", "win_errors", " WHERE n >= 20"),
            """scores AS (
  SELECT ws, ws + 20 AS we, e0 > t0 OR e1 > t1 AS flag, e0, e1, t0, t1
  FROM win_errors CROSS JOIN thr)""",
        ]
    )


SCORED = scored()
JUMP_SCORED = scored("jumped", JUMPED)
SCORE_COLUMNS = """ws AS window_start, we AS window_end, flag AS is_anomaly,
       round(e0, 9) AS mae_set_t, round(e1, 9) AS mae_v_t,
       round(t0, 9) AS threshold_set_t, round(t1, 9) AS threshold_v_t"""

# Leading components by squaring the covariance until only the first one is left, then taking
# it out of the covariance, and so on. Matrices are lists of lists and symmetric.
SQUARINGS = 22


def _each(a: str, b: str, value: str) -> str:
    """Two matrices, element by element: ``value`` of x and y."""
    cell = f"list_transform(list_zip(z[1], z[2]), lambda c: {value})".replace("x", "c[1]").replace("y", "c[2]")
    return f"list_transform(list_zip({a}, {b}), lambda z: {cell})"


def _scaled_to_trace(m: str) -> str:
    trace = f"list_sum(list_transform(range(1, len({m}) + 1), lambda i: {m}[i][i]))"
    return f"list_transform({m}, lambda r: list_transform(r, lambda v: v / {trace}))"


def components(k: int) -> str:
    """CTEs up to ``scores``: every complete window, rebuilt from the first k of the history."""
    square = "list_transform(m, lambda r: list_transform(m, lambda s: list_dot_product(r, s)))"
    return ",\n".join(
        [
            FITTED,
            scaled("sensor", "hist"),
            windowed(),
            f"""tv AS MATERIALIZED (
  SELECT first_event AS s, 2 * pos AS d, x0 AS x FROM train
  UNION ALL SELECT first_event, 2 * pos + 1, x1 FROM train),
center AS MATERIALIZED (SELECT d, avg(x) AS mid FROM tv GROUP BY d),
dev AS MATERIALIZED (SELECT s, d, x - mid AS y FROM tv JOIN center USING (d)),
cov AS MATERIALIZED (SELECT a.d AS i, b.d AS j, sum(a.y * b.y) AS v FROM dev a JOIN dev b USING (s) GROUP BY a.d, b.d),
lists AS (SELECT i, list(v ORDER BY j) AS r FROM cov GROUP BY i),
matrix AS (SELECT list(r ORDER BY i) AS c FROM lists),
power AS (
  SELECT 0 AS found, 0 AS n, c, {_scaled_to_trace("c")} AS m,
         list_transform(c, lambda r: list_transform(r, lambda v: CAST(0 AS DOUBLE))) AS total FROM matrix
  UNION ALL
  SELECT found + CAST(n = {SQUARINGS} AS INTEGER), CASE WHEN n = {SQUARINGS} THEN 0 ELSE n + 1 END, c,
         {_scaled_to_trace("m")}, total
  FROM (SELECT found, n, CASE WHEN n = {SQUARINGS} THEN less ELSE c END AS c,
               CASE WHEN n = {SQUARINGS} THEN less ELSE {square} END AS m,
               CASE WHEN n = {SQUARINGS} THEN {_each("total", "m", "x + y")} ELSE total END AS total
        FROM (SELECT *, {_each("c", "m", "x - value * y")} AS less
              FROM (SELECT *, list_dot_product(flatten(c), flatten(m)) AS value FROM power)))
  WHERE found < {k}),
projection AS MATERIALIZED (
  SELECT i, generate_subscripts(r, 1) - 1 AS j, unnest(r) AS v
  FROM (SELECT generate_subscripts(total, 1) - 1 AS i, unnest(total) AS r FROM power WHERE found = {k} AND n = 0)),
wv AS MATERIALIZED (
  SELECT ws AS s, 2 * pos AS d, x0 AS x FROM win WHERE n >= 20
  UNION ALL SELECT ws, 2 * pos + 1, x1 FROM win WHERE n >= 20)""",
            *(
                f"""{name} AS MATERIALIZED (
  SELECT s, round(avg(gap) FILTER (d % 2 = 0), 12) AS e0, round(avg(gap) FILTER (d % 2 = 1), 12) AS e1
  FROM (SELECT a.s, a.d, abs(any_value(a.x) - any_value(o.mid) - sum(p.v * (b.x - c.mid))) AS gap
        FROM {rows} a JOIN center o ON o.d = a.d JOIN projection p ON p.i = a.d
        JOIN {rows} b ON b.s = a.s AND b.d = p.j JOIN center c ON c.d = b.d GROUP BY a.s, a.d)
  GROUP BY s)"""
                for name, rows in (("fit_errors", "tv"), ("found_errors", "wv"))
            ),
            """limits AS (SELECT max(e0) AS t0, max(e1) AS t1 FROM fit_errors),
scores AS (
  SELECT s AS ws, s + 20 AS we, e0 > t0 OR e1 > t1 AS flag, e0, e1, t0, t1
  FROM found_errors CROSS JOIN limits)""",
        ]
    )


CLOSED = "WHERE we <= (SELECT max(t) - 5 FROM sensor)"
STREAM_SCORES = f"WITH {SCORED}\nSELECT {SCORE_COLUMNS} FROM scores {CLOSED}"

MESSAGE = (
    """'{"set_t":' || set_t || ',"v_t":' || v_t || ',"event_timestamp":"' || t || '"}'"""
)
DIGESTS = """CAST(count(*) AS INTEGER) AS n_points,
       round(CAST(sum(x0 * (pos + 1)) AS DOUBLE), 9) AS digest_set_t,
       round(CAST(sum(x1 * (pos + 1)) AS DOUBLE), 9) AS digest_v_t"""


def own_time_windows(by: str, span: str, step: str) -> str:
    """CTE ``win``: all points per window of the events' own time, in order."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}, ws" if by else "PARTITION BY ws"
    n = f"({span}) // ({step})"
    return f"""spread AS (
  SELECT {keys}us, event_id, set_t AS x0, v_t AS x1, (us // ({step}) - k) * ({step}) AS ws
  FROM sensor, range(0, {n}) AS r(k)),
win AS (
  SELECT *, row_number() OVER ({part} ORDER BY us, event_id) - 1 AS pos
  FROM spread)"""


def stamp(seconds: str) -> str:
    return f"strftime(make_timestamp(({seconds}) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z')"


def message_columns() -> str:
    return f"""strftime(make_timestamp(we * 1000000), '%Y-%m-%d %H:%M:%S') AS key,
       {stamp("ws")} AS window_start, {stamp("we")} AS window_end, flag AS is_anomaly,
       round(e0, 9) AS mae_set_t, round(e1, 9) AS mae_v_t, round(t1, 9) AS threshold_v_t,
       round(last1, 9) AS last_v_t, round(m0, 9) AS mean_set_t"""


MESSAGES = f"""{SCORED},
ends AS (
  SELECT ws, max(CASE WHEN pos = 19 THEN x1 END) AS last1, avg(x0) AS m0 FROM win GROUP BY ws),
sent AS (SELECT * FROM scores JOIN ends USING (ws))"""

NESTED = f"""WITH {SCORED},
means AS (SELECT ws, avg(x0) AS m0, avg(x1) AS m1 FROM win WHERE n >= 20 GROUP BY ws),
cells AS (
  SELECT 'features_' || pos || '_0' AS field, x0 AS v, NULL AS s FROM win WHERE n >= 20
  UNION ALL SELECT 'features_' || pos || '_1', x1, NULL FROM win WHERE n >= 20
  UNION ALL SELECT 'prediction_' || k || '_0', m0, NULL FROM means, range(0, 20) AS r(k)
  UNION ALL SELECT 'prediction_' || k || '_1', m1, NULL FROM means, range(0, 20) AS r(k)
  UNION ALL SELECT 'mae_set_t', e0, NULL FROM scores
  UNION ALL SELECT 'mae_v_t', e1, NULL FROM scores
  UNION ALL SELECT 'threshold_set_t', t0, NULL FROM scores
  UNION ALL SELECT 'threshold_v_t', t1, NULL FROM scores
  UNION ALL SELECT 'window_start', NULL, {stamp("ws")} FROM scores
  UNION ALL SELECT 'window_end', NULL, {stamp("we")} FROM scores
  UNION ALL SELECT 'isAnomaly', NULL, CASE WHEN flag THEN 'true' ELSE 'false' END FROM scores)
SELECT 'predictions' AS key, field, count(v) AS n_values, count(s) AS n_texts,
       round(sum(v), 6) AS total, min(s) AS first_text, max(s) AS last_text
FROM cells GROUP BY field"""

POINTS = """points AS (
  SELECT event_id, topic, t, 'set_t' AS field, CAST(set_t AS DOUBLE) AS value FROM sensor
  UNION ALL SELECT event_id, topic, t, 'v_t', CAST(v_t AS DOUBLE) FROM sensor)"""

SCALE_COLUMNS = "event_id, round(x0, 9) AS scaled_set_t, round(x1, 9) AS scaled_v_t"

ALL: dict[str, str] = {
    "decode_records": f"""WITH {SENSOR}
SELECT event_id AS "offset", t AS event_time, set_t, v_t FROM sensor""",
    "decode_payload_time": f"""WITH {SENSOR}
SELECT event_id AS "offset", t AS event_time, set_t, v_t FROM sensor""",
    "damaged_records": f"""WITH {SENSOR}
SELECT event_id AS "offset", t AS event_time,
       CASE WHEN event_id % 40 NOT IN (0, 2) THEN set_t END AS set_t,
       CASE WHEN event_id % 40 > 2 THEN v_t END AS v_t FROM sensor""",
    "encode_records": f"""WITH {SENSOR}
SELECT event_id, 'modb_temp' AS key, {MESSAGE} AS message, t AS event_time FROM sensor""",
    "encode_records_plain": f"""WITH {SENSOR}
SELECT event_id, 'modb_temp' AS key,
       '{{"set_t":' || set_t || ',"v_t":' || v_t || '}}' AS message FROM sensor""",
    "oversize_drop": """SELECT doc_id, CAST(strlen(text) AS INTEGER) AS n_bytes
FROM documents WHERE strlen(text) <= 5000""",
    "topic_select": """SELECT event_id, event_type AS topic FROM events
WHERE event_type IN ('click', 'error')""",
    "points_unpivot": f"""WITH {SENSOR}, {POINTS}
SELECT 'kafka_consumer' AS measurement, topic AS key, t AS point_time, field, value,
       event_id AS arrival FROM points""",
    "points_unpivot_nested": NESTED,
    "points_unpivot_deep": f"""WITH {SENSOR}
SELECT topic AS key, t AS point_time, 'a_b_0_c' AS field, CAST(set_t AS DOUBLE) AS value FROM sensor
UNION ALL SELECT topic, t, 'a_b_0_d_0', CAST(v_t AS DOUBLE) FROM sensor""",
    "points_pivot": f"""WITH {SENSOR}
SELECT topic AS key, t AS point_time, CAST(set_t AS DOUBLE) AS set_t, CAST(v_t AS DOUBLE) AS v_t
FROM sensor""",
    "points_pivot_last": f"""WITH {SENSOR}
SELECT topic AS key, kt AS point_time, CAST(arg_max(set_t, event_id) AS DOUBLE) AS set_t,
       CAST(arg_max(v_t, event_id) AS DOUBLE) AS v_t
FROM sensor GROUP BY topic, kt""",
    "points_pivot_partitions": f"""WITH {SENSOR},
placed AS (SELECT *, (event_id % 4) * 1000000000 + event_id // 4 AS arrived FROM sensor)
SELECT topic AS key, kt AS point_time, CAST(arg_max(set_t, arrived) AS DOUBLE) AS set_t,
       CAST(arg_max(v_t, arrived) AS DOUBLE) AS v_t
FROM placed GROUP BY topic, kt""",
    "history_scan": f"""WITH {SENSOR}
SELECT us AS time_us, CAST(set_t AS FLOAT) AS set_t, CAST(v_t AS FLOAT) AS v_t FROM sensor
WHERE topic = 'temperature_modbus'
  AND us >= epoch_us(TIMESTAMP '2024-01-28 00:00:00')
  AND us < epoch_us(TIMESTAMP '2024-01-30 00:00:00')
ORDER BY us""",
    "archive_roundtrip": f"""WITH {SENSOR}
SELECT topic AS key, t AS event_time, CAST(set_t AS FLOAT) AS set_t, CAST(v_t AS FLOAT) AS v_t
FROM sensor""",
    "scaler_fit": f"""WITH {SENSOR}
SELECT CAST(min(set_t) AS DOUBLE) AS set_t_min, CAST(max(set_t) AS DOUBLE) AS set_t_max,
       CAST(min(v_t) AS DOUBLE) AS v_t_min, CAST(max(v_t) AS DOUBLE) AS v_t_max FROM sensor""",
    "scaler_fit_by_series": f"""WITH {SENSOR}
SELECT user_id, CAST(min(set_t) AS DOUBLE) AS set_t_min, CAST(max(set_t) AS DOUBLE) AS set_t_max,
       CAST(min(v_t) AS DOUBLE) AS v_t_min, CAST(max(v_t) AS DOUBLE) AS v_t_max
FROM sensor GROUP BY user_id""",
    "minmax_scale": f"WITH {SENSOR}, {scaled()}\nSELECT {SCALE_COLUMNS} FROM scaled",
    "minmax_scale_by_series": f"""WITH {SENSOR}, {scaled(by="user_id")}
SELECT user_id, {SCALE_COLUMNS} FROM scaled""",
    "minmax_scale_unseen_series": f"""WITH {SENSOR},
seen AS (SELECT * FROM sensor WHERE series <> 3), {scaled(bounds_of="seen", by="series")},
every AS (SELECT s.event_id, s.series, x0, x1 FROM sensor s LEFT JOIN scaled USING (event_id))
SELECT series, {SCALE_COLUMNS} FROM every""",
    "scaler_model_roundtrip": f"WITH {SENSOR}, {scaled()}\nSELECT {SCALE_COLUMNS} FROM scaled",
    "vector_assembly": f"""WITH {SENSOR}, {scaled()}
SELECT {SCALE_COLUMNS}, CAST(t AS DOUBLE) AS epoch_seconds FROM scaled""",
    "sliding_sequences": f"""WITH {SENSOR}, {scaled()}, {windowed()}
SELECT ws AS window_start, ws + 20 AS window_end, CAST(pos AS INTEGER) AS pos,
       round(x0, 9) AS set_t, round(x1, 9) AS v_t FROM win""",
    "sliding_sequences_by_series": f"""WITH {SENSOR}, {scaled()}, {windowed(t="kt", by="series")}
SELECT series, ws AS window_start, ws + 20 AS window_end, {DIGESTS} FROM win GROUP BY series, ws""",
    "sliding_sequences_irregular": f"""WITH {SENSOR},
{own_time_windows("user_id", "86400000000", "3600000000")}
SELECT user_id, ws // 1000000 AS window_start, ws // 1000000 + 86400 AS window_end, {DIGESTS}
FROM win GROUP BY user_id, ws""",
    "vector_sequences": f"""WITH {SENSOR}, {scaled()}, {windowed()}
SELECT ws AS window_start, ws + 20 AS window_end, {DIGESTS} FROM win GROUP BY ws""",
    "window_completeness": f"""WITH {SENSOR}, {own_time_windows("", "3600000000", "300000000")}
SELECT ws // 1000000 AS window_start, ws // 1000000 + 3600 AS window_end,
       CAST(count(*) AS INTEGER) AS n_points, count(*) >= 20 AS complete FROM win GROUP BY ws""",
    "sequence_shape": f"""WITH {SENSOR}, {scaled()}, {windowed()}
SELECT ws AS window_start, ws + 20 AS window_end, '(' || count(*) || ', 2)' AS shape_before,
       '(1, ' || count(*) || ', 2)' AS shape_after,
       CAST(0.25 AS DOUBLE) AS threshold_set_t, CAST(0.5 AS DOUBLE) AS threshold_v_t
FROM win GROUP BY ws HAVING count(*) >= 20""",
    "float32_sequences": f"""WITH {SENSOR}, {scaled()}, {windowed()}
SELECT ws AS window_start, CAST(pos AS INTEGER) AS pos,
       round(CAST(CAST(x0 AS FLOAT) AS DOUBLE), 9) AS set_t,
       round(CAST(CAST(x1 AS FLOAT) AS DOUBLE), 9) AS v_t FROM win""",
    "row_sequences": f"""WITH {SENSOR}, {scaled()}, {row_windowed("scaled", "t, event_id")}
SELECT first_event, CAST(pos AS INTEGER) AS pos, round(x0, 9) AS set_t, round(x1, 9) AS v_t
FROM seq""",
    "row_sequences_keyed": f"""WITH {SENSOR}, {scaled()},
{row_windowed("scaled", "us, event_id", by="user_id")}
SELECT user_id, first_event, {DIGESTS} FROM seq GROUP BY user_id, first_event""",
    "row_sequences_tied": f"""WITH {SENSOR}, {scaled()},
{row_windowed("scaled", "CASE WHEN event_id % 3 = 0 THEN -1 ELSE event_id END, event_id")}
SELECT first_event, {DIGESTS} FROM seq GROUP BY first_event""",
    "row_index_equal_rows": f"""WITH {SENSOR},
numbered AS (
  SELECT topic, CAST(set_t % 2 AS INTEGER) AS odd,
         row_number() OVER (ORDER BY topic, set_t % 2 NULLS FIRST) - 1 AS row_index
  FROM sensor)
SELECT topic, odd, min(row_index) AS first_row, max(row_index) AS last_row, count(*) AS n_rows
FROM numbered GROUP BY topic, odd""",
    "training_pairs": f"""WITH {SENSOR}, {scaled()}, {row_windowed("scaled", "t, event_id")}
SELECT first_event, CAST(2 * count(*) AS INTEGER) AS n,
       round(sum(x0 * (2 * pos + 1) + x1 * (2 * pos + 2)), 9) AS features,
       round(sum(x0 * (2 * pos + 1) + x1 * (2 * pos + 2)), 9) AS labels
FROM seq GROUP BY first_event""",
    "fit_split_preview": f"""WITH {SENSOR}, {scaled()}, {row_windowed("scaled", "t, event_id")},
firsts AS (SELECT DISTINCT first_event FROM seq ORDER BY first_event LIMIT 2)
SELECT first_event, CAST(2 * pos + c AS INTEGER) AS pos,
       round(CASE WHEN c = 0 THEN x0 ELSE x1 END, 9) AS label
FROM seq JOIN firsts USING (first_event), range(0, 2) AS r(c)""",
    "fit_split_schema": f"""WITH {SENSOR}, {scaled()}, {row_windowed("scaled", "t, event_id")},
pairs AS (SELECT first_event, list(x0 ORDER BY pos) AS features FROM seq GROUP BY first_event)
SELECT CAST(c AS INTEGER) AS position, ['event_id', 'features', 'labels'][c + 1] AS name,
       ['bigint', 'array<double>', 'array<double>'][c + 1] AS type, count(*) AS n_rows,
       count(*) - count(CASE WHEN c = 0 THEN CAST(first_event AS VARCHAR) ELSE CAST(features AS VARCHAR) END) AS n_nulls
FROM pairs, range(0, 3) AS r(c) GROUP BY c""",
    "sequence_mae": f"""WITH {SENSOR}, {scaled()}, {windowed()},
{errors("win", "ws", "win_errors", " WHERE n >= 20")}
SELECT ws AS window_start, ws + 20 AS window_end, round(e0, 9) AS mae_set_t,
       round(e1, 9) AS mae_v_t FROM win_errors""",
    "mae_threshold": f"""WITH {FITTED}
SELECT round(t0, 9) AS threshold_set_t, round(t1, 9) AS threshold_v_t FROM thr""",
    "anomaly_scores": f"""WITH {SCORED}
SELECT strftime(make_timestamp(we * 1000000), '%Y-%m-%d %H:%M:%S') AS window_key, {SCORE_COLUMNS}
FROM scores""",
    "anomaly_scores_jumps": f"WITH {JUMP_SCORED}\nSELECT {SCORE_COLUMNS} FROM scores",
    "anomaly_scores_by_series": f"""WITH {SENSOR}, {HISTORY},
{scaled("sensor", "hist", by="series")},
past AS (SELECT * FROM scaled WHERE topic = 'temperature_modbus'),
{row_windowed("past", "kt", by="series", name="train")},
{errors("train", "first_event", "train_errors")},
thr AS (SELECT max(e0) AS t0, max(e1) AS t1 FROM train_errors),
{windowed(t="kt", by="series")},
{errors("win", "series, ws", "win_errors", " WHERE n >= 20")},
scores AS (SELECT series, ws, ws + 20 AS we, e0 > t0 OR e1 > t1 AS flag, e0, e1, t0, t1
           FROM win_errors CROSS JOIN thr)
SELECT series, {SCORE_COLUMNS} FROM scores""",
    "anomaly_scores_incomplete": f"""WITH {SCORED},
sizes AS (SELECT ws, CAST(count(*) AS INTEGER) AS n_points FROM win GROUP BY ws)
SELECT n_points, z.ws AS window_start, z.ws + 20 AS window_end, flag AS is_anomaly,
       round(e0, 9) AS mae_set_t, round(e1, 9) AS mae_v_t,
       round(h.t0, 9) AS threshold_set_t, round(h.t1, 9) AS threshold_v_t
FROM sizes z LEFT JOIN scores s ON s.ws = z.ws CROSS JOIN thr h""",
    "predictions_message": f"""WITH {MESSAGES}
SELECT {message_columns()}, we AS event_time FROM sent""",
    "predictions_message_nested": f"""WITH {MESSAGES}
SELECT {message_columns()}, false AS has_event_time FROM sent""",
    "user_model_reconstruct": f"""WITH {SENSOR}, {scaled()}, {windowed()}
SELECT ws AS window_start, ws + 20 AS window_end,
       round(avg(abs(x0 / 2 - x0)), 12) > 0.2 OR round(avg(abs(x1 / 2 - x1)), 12) > 0.02
         AS "isAnomaly",
       round(avg(abs(x0 / 2 - x0)), 9) AS mae_set_t, round(avg(abs(x1 / 2 - x1)), 9) AS mae_v_t
FROM win GROUP BY ws HAVING count(*) >= 20""",
    "pca_fixed_basis": f"""WITH {SENSOR}, {scaled()}, {windowed()},
y AS (SELECT ws, pos - 9.5 AS p, x0 - 0.1 * (1 - 2 * (pos % 2)) AS y0,
             x1 - 0.1 * (1 - 2 * (pos % 2)) AS y1 FROM win WHERE n >= 20),
line AS (SELECT ws, avg(y0) AS m0, avg(y1) AS m1, sum(p * y0) / 665 AS s0, sum(p * y1) / 665 AS s1
         FROM y GROUP BY ws),
found AS (SELECT ws, avg(abs(y0 - m0 - s0 * p)) AS e0, avg(abs(y1 - m1 - s1 * p)) AS e1
          FROM y JOIN line USING (ws) GROUP BY ws)
SELECT ws AS window_start, ws + 20 AS window_end,
       round(e0, 12) > 0.2537 OR round(e1, 12) > 1.0 AS "isAnomaly",
       round(e0, 9) AS mae_set_t, round(e1, 9) AS mae_v_t FROM found""",
    "pca_reconstruct": f"WITH RECURSIVE {components(8)}\nSELECT {SCORE_COLUMNS} FROM scores",
    "pca_leading": f"WITH RECURSIVE {components(1)}\nSELECT {SCORE_COLUMNS} FROM scores",
    "pca_full_rank": f"""WITH {SENSOR}, {scaled()}, {windowed()}
SELECT ws AS window_start, CAST(0 AS DOUBLE) AS mae_set_t, CAST(0 AS DOUBLE) AS mae_v_t
FROM win GROUP BY ws HAVING count(*) >= 20""",
    "fit_detector": f"""WITH {FITTED}
SELECT 'set_t' AS channel, CAST(a0 AS DOUBLE) AS low, CAST(b0 AS DOUBLE) AS high,
       round(t0, 9) AS threshold FROM hs_bounds CROSS JOIN thr
UNION ALL SELECT 'v_t', a1, b1, round(t1, 9) FROM hs_bounds CROSS JOIN thr""",
    "stream_anomaly_scores": STREAM_SCORES,
    "stream_scores_by_series": f"""WITH {SENSOR}, {scaled()}, {windowed(t="kt", by="series")},
{errors("win", "series, ws", "win_errors", " WHERE n >= 20")},
scores AS (SELECT series, ws, ws + 20 AS we, e0 > 0.3 OR e1 > 0.1 AS flag, e0, e1,
                  CAST(0.3 AS DOUBLE) AS t0, CAST(0.1 AS DOUBLE) AS t1 FROM win_errors)
SELECT series, {SCORE_COLUMNS} FROM scores WHERE we <= (SELECT max(kt) - 5 FROM sensor)""",
    "stream_predictions_message": f"""WITH {MESSAGES}
SELECT {message_columns()}, we AS event_time FROM sent {CLOSED}""",
    "stream_predictions_message_nested": f"""WITH {MESSAGES}
SELECT {message_columns()}, false AS has_event_time FROM sent {CLOSED}""",
    "stream_late_drop": STREAM_SCORES,
    "stream_late_rows": f"""WITH {SENSOR}, {scaled()}, edge AS (SELECT max(t) - 5 AS w FROM sensor)
SELECT event_id AS "offset", t AS event_time, round(x0, 9) AS set_t, round(x1, 9) AS v_t,
       least(20, w - t) AS missed_windows FROM scaled CROSS JOIN edge WHERE t < w""",
    # A block is 160 windows of a series; a point is in those that start in its last 20 seconds.
    "stream_state": f"""WITH {SENSOR}, {scaled()}, edge AS (SELECT max(kt) - 5 - 20 AS ended FROM sensor),
homes AS (SELECT *, unnest(generate_series((kt - 19) // 160, kt // 160)) AS block FROM scaled)
SELECT series, block, count(*) AS n_points, min(event_id) AS first_offset, max(event_id) AS last_offset,
       round(sum(x1), 9) AS total
FROM homes CROSS JOIN edge WHERE least(kt, 160 * block + 159) > ended GROUP BY series, block""",
    "stream_rejects": f"""WITH {SENSOR}, r AS (
  SELECT t, event_id, event_id % 40 AS place, {MESSAGE} AS text FROM sensor),
bad AS (SELECT CASE place WHEN 0 THEN '{{' || text WHEN 1 THEN regexp_replace(text, '"v_t":[^,]*,', '') END AS value,
               CASE place WHEN 0 THEN 'no JSON' WHEN 1 THEN 'no v_t' ELSE 'no value' END AS reason
        FROM r WHERE place < 3),
ends AS (SELECT (SELECT max(t) - 5 FROM r WHERE place > 2) AS w),
full_ AS (SELECT ws FROM r, range(0, 20) AS k(k), LATERAL (SELECT t - k AS ws) WHERE place > 2
          GROUP BY ws HAVING count(*) >= 20)
SELECT reason, count(*) AS n_records, count(value) AS n_values, min(value) AS first_value, max(value) AS last_value,
       (SELECT count(*) FROM full_, ends WHERE ws + 20 <= w) AS n_messages
FROM bad GROUP BY reason""",
    "stream_lifecycle": STREAM_SCORES,
    "stream_restart_counts": f"""WITH {SENSOR},
placed AS (SELECT t, event_id % 40 >= 3 AS ok, CAST(t >= (SELECT (min(t) + max(t)) / 2.0 FROM sensor) AS INT) AS run
           FROM sensor),
filled AS (SELECT t, sum(CAST(ok AS INT)) OVER (ORDER BY t ROWS 19 PRECEDING) AS n FROM placed),
runs AS (SELECT run, count(*) AS n_records, count(*) FILTER (NOT ok) AS n_invalid, max(t) FILTER (ok) - 5 AS w
         FROM placed GROUP BY run)
SELECT run, n_records, n_invalid, CAST(0 AS BIGINT) AS n_dropped, true AS complete,
       (SELECT count(*) FROM filled WHERE n = 20 AND t + 1 <= w) AS n_scores
FROM runs""",
    "stream_scores_jumps": f"WITH {JUMP_SCORED}\nSELECT {SCORE_COLUMNS} FROM scores {CLOSED}",
    "stream_user_model": f"""WITH {SENSOR}, {scaled()}, {windowed()},
halved AS (SELECT ws, round(avg(abs(x0 / 2 - x0)), 12) AS e0, round(avg(abs(x1 / 2 - x1)), 12) AS e1
           FROM win GROUP BY ws HAVING count(*) >= 20),
scores AS (SELECT ws, ws + 20 AS we, e0 > 0.2537 OR e1 > 1.0 AS flag, e0, e1,
                  CAST(0.2537 AS DOUBLE) AS t0, CAST(1.0 AS DOUBLE) AS t1 FROM halved)
SELECT {SCORE_COLUMNS} FROM scores {CLOSED}""",
    "stream_shapes": f"""WITH {SENSOR}, {scaled()}, {windowed()}
SELECT {stamp("ws")} AS window_start, {stamp("ws + 20")} AS window_end,
       '(' || count(*) || ', 2)' AS shape_before, '(1, ' || count(*) || ', 2)' AS shape_after,
       CAST(0.5 AS DOUBLE) AS threshold_v_t
FROM win GROUP BY ws HAVING count(*) >= 20 AND ws + 20 <= (SELECT max(t) - 5 FROM sensor)""",
    "stream_archive": f"""WITH {SENSOR}, {POINTS}
SELECT 'kafka_consumer' AS measurement, topic AS key,
       strftime(make_timestamp(t * 1000000), '%Y-%m-%d') AS day, t AS point_time, field, value
FROM points""",
}
