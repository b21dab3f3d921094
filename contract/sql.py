"""SQL building blocks: the same tables as ``contract.tables``, written for DuckDB."""

from __future__ import annotations

from contract.tables import DUCK_LINE, DUCK_SERVER_LINE, SOURCE
from trafficlens import fixed_values as fixed

_FIELDS = ["ip", "timestamp_raw", "method", "endpoint", "status_raw", "bytes_raw"]
COMMON = fixed.COMMON_LOG_PATTERN
COMBINED = fixed.COMBINED_LOG_PATTERN
SERVER = fixed.SERVER_LOG_PATTERN
_BOT = "|".join(fixed.BOT_KEYWORDS)
FEATURES = list(fixed.NUMERIC_FEATURES)


def extracted(pattern: str, fields: list[str]) -> str:
    names = ", ".join(f"'{f}'" for f in fields)
    return f"regexp_extract(value, '{pattern}', [{names}])"


def typed(raw: str) -> str:
    """Access columns from the raw strings of relation ``raw``."""
    return f"""SELECT strptime(left(timestamp_raw, 20), '%d/%b/%Y:%H:%M:%S') AS "timestamp",
      ip, method, endpoint, CAST(status_raw AS INTEGER) AS status_code,
      CASE WHEN bytes_raw = '-' THEN 0 ELSE CAST(bytes_raw AS BIGINT) END AS bytes,
      user_agent, is_bot, CASE WHEN CAST(status_raw AS INTEGER) >= 400 THEN 1 ELSE 0 END AS is_error,
      least(CAST(status_raw AS INTEGER) // 100, 5) || 'xx' AS status_class, source
    FROM {raw}"""


def window_counts(bucket: str, start: str = "window_start", relation: str = "enriched") -> str:
    return f"""SELECT ip, {start} AS window_start, {start} + INTERVAL {bucket} AS window_end,
      count(*) AS request_count, CAST(sum(is_error) AS BIGINT) AS error_count,
      avg(bytes) AS avg_bytes, count(DISTINCT endpoint) AS unique_endpoints,
      CAST(sum(is_bot) AS BIGINT) AS bot_requests,
      CAST(sum(is_off_hours) AS BIGINT) AS off_hours_requests,
      count(*) FILTER (error_severity = 'fatal') AS fatal_count,
      count(*) FILTER (error_severity = 'medium') AS medium_count,
      count(*) FILTER (error_severity = 'low') AS low_count,
      sum(is_error)::DOUBLE / count(*) AS error_rate
    FROM {relation} GROUP BY ip, {start}"""


def ruled(counts: str, spike: int, rate: float, endpoints: int) -> str:
    return f"""SELECT *, CASE WHEN severity_score >= 0.7 THEN 'high'
        WHEN severity_score >= 0.3 THEN 'medium' ELSE 'low' END AS severity
    FROM (SELECT *, CASE WHEN fatal_count > 0 THEN 'server_error'
        WHEN request_count > {spike} THEN 'traffic_spike'
        WHEN error_rate > {rate} THEN 'high_error_rate'
        WHEN unique_endpoints > {endpoints} THEN 'scanning'
        WHEN bot_requests > 0 THEN 'bot_traffic' ELSE 'normal' END AS anomaly_type,
      least(fatal_count / (request_count + 1)::DOUBLE * 0.40::DOUBLE
        + medium_count / (request_count + 1)::DOUBLE * 0.25::DOUBLE
        + error_rate * 0.20::DOUBLE + request_count / 200::DOUBLE * 0.15::DOUBLE,
        1.0::DOUBLE) AS severity_score FROM {counts})"""


def rounded(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


MEASURES = (
    "request_count, error_count, round(avg_bytes, 6) AS avg_bytes, unique_endpoints, "
    "bot_requests, off_hours_requests, fatal_count, medium_count, low_count, "
    "round(error_rate, 6) AS error_rate"
)

TABLES = f"""WITH lines AS (SELECT {DUCK_LINE} AS value, {SOURCE} AS source FROM events),
  server_lines AS (SELECT {DUCK_SERVER_LINE} AS value, event_type FROM events),
  common_raw AS (SELECT unnest({extracted(COMMON, _FIELDS)}), NULL::VARCHAR AS user_agent,
      0 AS is_bot, source FROM lines
    WHERE source = 'access_log' AND regexp_matches(value, '{COMMON}')),
  combined_raw AS (SELECT *, CASE WHEN regexp_matches(lower(user_agent), '{_BOT}') THEN 1 ELSE 0 END
      AS is_bot FROM (SELECT unnest({extracted(COMBINED, [*_FIELDS, "referrer", "user_agent"])}),
      source FROM lines
    WHERE source = 'web_server_log' AND regexp_matches(value, '{COMBINED}'))),
  raw_rows AS (SELECT * FROM common_raw UNION ALL BY NAME
    SELECT * EXCLUDE (referrer) FROM combined_raw),
  access AS ({typed("raw_rows")}),
  enriched AS (SELECT *, CASE WHEN status_code IN (500, 502, 503, 504) THEN 'fatal'
      WHEN status_code IN (499, 401, 403, 429) THEN 'medium'
      WHEN status_code IN (400, 404, 405, 416) THEN 'low' ELSE 'none' END AS error_severity,
      CAST(hour("timestamp") AS INTEGER) AS hour_of_day,
      CAST(dayofweek("timestamp") + 1 AS INTEGER) AS day_of_week,
      CASE WHEN hour("timestamp") < 8 OR hour("timestamp") > 22 THEN 1 ELSE 0 END AS is_off_hours,
      date_trunc('day', "timestamp")::TIMESTAMP AS day_start,
      date_trunc('minute', "timestamp")::TIMESTAMP AS minute_start FROM access),
  minute_counts AS ({window_counts("1 MINUTE", "minute_start")}),
  day_counts AS ({window_counts("1 DAY", "day_start")}),
  minute_windows AS ({ruled("minute_counts", 200, 0.3, 30)}),
  windows AS ({ruled("day_counts", 5, 0.3, 3)}),
  frame AS (SELECT {", ".join(FEATURES)}, anomaly_type, severity, severity_score, ip,
      window_start, window_end,
      ('0x' || substr(md5(ip || '|' || CAST(epoch(window_start) AS BIGINT)), 1, 8))::BIGINT
        / 4294967296::DOUBLE AS fraction FROM windows),
  split_frame AS (SELECT * EXCLUDE (fraction), CASE WHEN fraction < 0.6 THEN 'train'
      WHEN fraction < 0.8 THEN 'validation' ELSE 'test' END AS split FROM frame),
  pairs AS (SELECT a.vec_id, a.label, b.vec_id AS other, b.label AS other_label,
      list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance
    FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
  near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, other) AS place
    FROM pairs),
  knn AS (SELECT vec_id, label, prediction FROM (SELECT vec_id, label, other_label AS prediction,
      row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, other_label) AS choice
    FROM near WHERE place <= 5 GROUP BY vec_id, label, other_label) WHERE choice = 1),
  confusion AS (SELECT label, prediction, count(*) AS n FROM knn GROUP BY ALL),
  classes AS (SELECT class, tp, fp, fn,
      CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS "precision",
      CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall,
      CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1
    FROM (SELECT c.class,
        CAST(coalesce(sum(n) FILTER (label = class AND prediction = class), 0) AS BIGINT) AS tp,
        CAST(coalesce(sum(n) FILTER (label <> class AND prediction = class), 0) AS BIGINT) AS fp,
        CAST(coalesce(sum(n) FILTER (label = class AND prediction <> class), 0) AS BIGINT) AS fn
      FROM (SELECT label AS class FROM confusion UNION SELECT prediction FROM confusion) c,
        confusion GROUP BY c.class))
"""
