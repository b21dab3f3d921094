"""Queries for orderings, rankings and the report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract import tables
from contract.registry import query
from trafficlens import fixed_values as fixed
from trafficlens.functions import requests as rq
from trafficlens.operators.enrich import request_profile
from trafficlens.operators.features import model_frame
from trafficlens.operators.histogram import histogram
from trafficlens.operators.ranking import by_count, count_by, top_k
from trafficlens.plans import reports
from trafficlens.sources.sinks import write_csv
from trafficlens.sources.workspace import scratch_path


def _counts(relation: str, *keys: str, where: str = "true", tail: str = "") -> str:
    listed = ", ".join(keys)
    return (
        f'SELECT {listed}, count(*) AS "count" FROM {relation} WHERE {where} '
        f"GROUP BY {listed} {tail}"
    )


def _top(k: int, *keys: str) -> str:
    return f'ORDER BY "count" DESC, {", ".join(keys)} LIMIT {k}'


def _shares(relation: str, key: str, extra: str = "") -> str:
    return f"""SELECT *, round(100.0::DOUBLE * "count" / sum("count") OVER (), 6) AS share_pct{extra}
      FROM ({_counts(relation, key)})"""


# -- orderings and top-k ------------------------------------------------------------


@query("g02_by_count", _counts("access", "endpoint"))
def endpoints_by_count(spark, d):
    return by_count(count_by(tables.access(spark, d), "endpoint"), "endpoint")


@query("g03_by_key", _counts("enriched", "day_of_week", "hour_of_day"))
def weekday_hours(spark, d):
    counts = count_by(tables.enriched(spark, d), "day_of_week", "hour_of_day")
    return counts.orderBy("day_of_week", "hour_of_day")


@query("g04_mixed_order", _counts("access", "source", "status_code"))
def mixed_order(spark, d):
    counts = count_by(tables.access(spark, d), "source", "status_code")
    return counts.orderBy(F.asc("source"), F.desc("count"))


@query(
    "g05_top_clients_by_bytes",
    """SELECT ip, CAST(sum(bytes) AS BIGINT) AS bytes FROM access GROUP BY ip
      ORDER BY bytes DESC, ip LIMIT 15""",
)
def top_clients_by_bytes(spark, d):
    totals = tables.access(spark, d).groupBy("ip").agg(F.sum("bytes").alias("bytes"))
    return top_k(totals, 15, "bytes", "ip")


@query(
    "g06_category_order",
    f"""SELECT *, CAST(coalesce(list_position(['low', 'medium', 'fatal'], error_severity), 0) AS BIGINT)
        AS place
      FROM ({_counts("enriched", "error_severity")})""",
)
def category_order(spark, d):
    place = rq.rank_in(F.col("error_severity"), fixed.ERROR_SEVERITY_ORDER).alias("place")
    return count_by(tables.enriched(spark, d), "error_severity").select("*", place).orderBy("place")


# -- request reports ----------------------------------------------------------------


def _report(name: str, build, relation: str, sql: str) -> None:
    query(name, sql)(lambda spark, d: build(getattr(tables, relation)(spark, d)))


_report(
    "h01_status_codes", reports.status_codes, "access",
    _counts("access", "status_code", tail=_top(15, "status_code")),
)
_report("h02_status_classes", reports.status_classes, "access", _shares("access", "status_class"))
_report(
    "h03_bot_share", reports.bot_share, "access",
    _shares("access", "is_bot", ", CASE is_bot WHEN 0 THEN 'Human' ELSE 'Bot' END AS client"),
)
_report("h04_sources", reports.sources, "access", _counts("access", "source"))
_report(
    "h05_methods", reports.methods, "access",
    _counts("access", "method", where=f"method IN {fixed.HTTP_METHODS}"),
)
_report(
    "h06_top_clients", reports.top_clients, "access",
    _counts("access", "ip", tail=_top(10, "ip")),
)
_report(
    "h07_top_endpoints", reports.top_endpoints, "access",
    _counts("access", "endpoint", tail=_top(10, "endpoint")),
)
_report(
    "h08_top_error_clients", reports.top_error_clients, "access",
    _counts("access", "ip", where="is_error = 1", tail=_top(10, "ip")),
)
_report(
    "h09_requests_by_hour", reports.requests_by_hour, "enriched",
    _counts("enriched", "hour_of_day"),
)
_report(
    "h10_requests_by_weekday", reports.requests_by_weekday, "enriched",
    f"""SELECT *, ['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat'][day_of_week] AS day_name
      FROM ({_counts("enriched", "day_of_week")})""",
)
_HOURLY = """SELECT hour_of_day, count(*) AS total, CAST(sum(is_error) AS BIGINT) AS errors,
  round(sum(is_error)::DOUBLE / count(*), 6) AS error_rate FROM enriched GROUP BY hour_of_day"""
_report("h11_error_rate_by_hour", reports.error_rate_by_hour, "enriched", _HOURLY)
_report(
    "h12_off_hours_share", reports.off_hours_share, "enriched",
    _shares(
        "enriched", "is_off_hours",
        ", CASE is_off_hours WHEN 0 THEN 'Business Hours (8–22)' ELSE 'Off Hours' END AS period",
    ),
)
_report(
    "h13_error_severities", reports.error_severities, "enriched",
    _counts("enriched", "error_severity", where="error_severity <> 'none'"),
)
_report(
    "h14_errors_by_source", reports.errors_by_source, "access",
    """SELECT source, count(*) FILTER (is_error = 0) AS normal,
      count(*) FILTER (is_error = 1) AS error FROM access GROUP BY source""",
)

# -- window reports -----------------------------------------------------------------

_report(
    "h15_anomaly_types", reports.anomaly_types, "windows",
    _counts("windows", "anomaly_type", where="anomaly_type <> 'normal'"),
)
_report("h16_severities", reports.severities, "windows", _counts("windows", "severity"))


def _histogram(relation: str, column: str, bins: int) -> str:
    return f""", x AS (SELECT {column}::DOUBLE AS x FROM {relation} WHERE {column} IS NOT NULL),
      span AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS low,
        CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS high FROM x),
      bins AS (SELECT b::INTEGER AS bin, low + b * ((high - low) / {bins}) AS bin_start,
        CASE WHEN b = {bins - 1} THEN high ELSE low + (b + 1) * ((high - low) / {bins}) END AS bin_end
        FROM span, range({bins}) t(b))
      SELECT bin, round(bin_start, 6) AS bin_start, round(bin_end, 6) AS bin_end,
        (SELECT count(*) FROM x WHERE x >= bin_start AND (x < bin_end OR bin = {bins - 1}
          AND x <= bin_end)) AS "count" FROM bins"""


_report(
    "h17_score_histogram", reports.score_histogram, "windows",
    _histogram("windows", "severity_score", 40),
)
_report(
    "h18_request_count_histogram", reports.request_count_histogram, "windows",
    _histogram("windows", "request_count", 50),
)
_report(
    "h19_error_rate_histogram", reports.error_rate_histogram, "windows",
    _histogram("windows", "error_rate", 40),
)
_report(
    "h20_anomaly_by_severity", reports.anomaly_by_severity, "windows",
    """SELECT anomaly_type, count(*) FILTER (severity = 'low') AS low,
      count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'high') AS high
      FROM windows WHERE anomaly_type <> 'normal' GROUP BY anomaly_type""",
)

_FIGURES = """figures AS (SELECT count(*)::DOUBLE AS total_rows,
    count(*) FILTER (is_bot = 1)::DOUBLE AS bot_traffic,
    count(*) FILTER (is_error = 1)::DOUBLE AS error_rows,
    count(*) FILTER ("timestamp" IS NULL) AS null_timestamps FROM access),
  window_figures AS (SELECT count(*)::DOUBLE AS total_windows,
    count(*) FILTER (anomaly_type <> 'normal')::DOUBLE AS anomalous_windows,
    count(*) FILTER (severity = 'high')::DOUBLE AS high_severity_windows FROM windows)"""


@query(
    "h21_business_summary",
    f""", {_FIGURES}, long AS (
      SELECT unnest(['total_rows', 'bot_traffic', 'bot_pct', 'error_rows', 'error_pct']) AS figure,
        unnest([total_rows, bot_traffic, 100 * bot_traffic / total_rows, error_rows,
          100 * error_rows / total_rows]) AS value FROM figures
      UNION ALL SELECT unnest(['total_windows', 'anomalous_windows', 'anomalous_pct',
          'high_severity_windows', 'high_severity_pct']),
        unnest([total_windows, anomalous_windows, 100 * anomalous_windows / total_windows,
          high_severity_windows, 100 * high_severity_windows / total_windows]) FROM window_figures)
      SELECT figure, round(value, 6) AS value FROM long""",
)
def business_summary(spark, d):
    return reports.business_summary(tables.access(spark, d), tables.windows(spark, d))


_report("h22_anomaly_breakdown", reports.anomaly_breakdown, "windows",
        _counts("windows", "anomaly_type"))
_report(
    "h23_peak_error_hours", reports.peak_error_hours, "enriched",
    f"""SELECT hour_of_day, total, errors FROM ({_HOURLY})
      ORDER BY errors DESC, hour_of_day LIMIT 5""",
)


@query("h24_histogram", _histogram("events", "value", 40))
def value_histogram(spark, d):
    return histogram(tables.events(spark, d), "value", 40)


_report(
    "h25_anomaly_distribution", reports.anomaly_distribution, "windows",
    _counts("windows", "anomaly_type", "severity"),
)


@query("h26_class_counts", _counts("frame", "anomaly_type"))
def class_counts(spark, d):
    frame = model_frame(tables.windows(spark, d))
    return by_count(count_by(frame, "anomaly_type"), "anomaly_type")


# -- the shared profile: same reports, one scan of the log ----------------------------


@query(
    "h_request_profile",
    """SELECT source, status_code, method, is_bot, hour_of_day, day_of_week, count(*) AS requests,
      any_value(status_class) AS status_class, any_value(is_error) AS is_error,
      any_value(error_severity) AS error_severity, any_value(is_off_hours) AS is_off_hours
      FROM enriched GROUP BY source, status_code, method, is_bot, hour_of_day, day_of_week""",
)
def profile(spark, d):
    return request_profile(tables.enriched(spark, d))


@query("h_profile_error_rate_by_hour", _HOURLY)
def profile_error_rate(spark, d):
    return reports.error_rate_by_hour(request_profile(tables.enriched(spark, d)))


@query(
    "h_client_totals",
    """SELECT ip, count(*) AS requests, CAST(sum(is_error) AS BIGINT) AS errors
      FROM access GROUP BY ip""",
)
def client_totals(spark, d):
    return reports.client_totals(tables.access(spark, d))


# -- sinks --------------------------------------------------------------------------


@query("j10_csv_sink", _counts("windows", "anomaly_type", "severity"))
def csv_sink(spark, d):
    table = reports.anomaly_distribution(tables.windows(spark, d))
    path = write_csv(table, scratch_path(spark, "anomaly-distribution"))
    return spark.read.option("header", True).schema(table.schema).csv(path)


@query(
    "j11_run_stats",
    f""", {_FIGURES} SELECT total_rows::BIGINT AS total_rows, bot_traffic::BIGINT AS bot_traffic,
      round(100 * bot_traffic / total_rows, 1) AS bot_pct, error_rows::BIGINT AS error_rows,
      round(100 * error_rows / total_rows, 1) AS error_pct,
      null_timestamps, total_windows::BIGINT AS total_windows,
      anomalous_windows::BIGINT AS anomalous_windows,
      round(100 * anomalous_windows / total_windows, 1) AS anomalous_pct
      FROM figures, window_figures""",
)
def run_stats(spark, d):
    return reports.run_stats(tables.access(spark, d), tables.windows(spark, d))
