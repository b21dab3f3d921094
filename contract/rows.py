"""Queries over lines and requests: sources, parsing, scalar functions, filters."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from contract import tables
from contract.registry import query
from contract.sql import COMBINED, COMMON, SERVER, extracted
from trafficlens import fixed_values as fixed
from trafficlens.functions import requests as rq
from trafficlens.operators import clean, parse
from trafficlens.operators.ranking import count_by
from trafficlens.operators.windows import client_windows
from trafficlens.plans import reports
from trafficlens.plans.access import rejected_lines
from trafficlens.schema import null_violations
from trafficlens.sources.text import lines_per_file, read_lines
from trafficlens.sources.workspace import scratch_path

_RAW = ["ip", "timestamp_raw", "method", "endpoint", "status_raw", "bytes_raw"]


# -- sources ----------------------------------------------------------------------


@query("a01_text_source", "SELECT value FROM lines")
def text_source(spark, d):
    folder = scratch_path(spark, "lines")
    tables.lines(spark, d).select("value").write.text(folder)
    return read_lines(spark, folder)


@query(
    "a02_lines_per_file",
    "SELECT event_type AS folder, count(*) AS lines FROM server_lines GROUP BY ALL",
)
def file_counts(spark, d):
    """Lines per file, summed per folder because part-file names are random."""
    folder = scratch_path(spark, "server-lines")
    tables.server_lines(spark, d).write.partitionBy("event_type").text(folder)
    per_file = lines_per_file(spark, f"{folder}/*")
    name = F.regexp_extract("file", "event_type=([^/]+)/", 1)
    return per_file.groupBy(name.alias("folder")).agg(F.sum("lines").alias("lines"))


@query("a03_source_tag", "SELECT ip, source FROM access")
def source_tag(spark, d):
    common, combined = tables.by_source(spark, d)
    tagged = parse.parse_common(common).unionByName(parse.parse_combined(combined))
    return tagged.select("ip", "source")


# -- parsing ----------------------------------------------------------------------


@query(
    "b01_parse_common",
    f"""SELECT unnest({extracted(COMMON, _RAW)}), NULL::VARCHAR AS user_agent, 0 AS is_bot,
        'access_log' AS source FROM lines WHERE regexp_matches(value, '{COMMON}')""",
)
def parse_common(spark, d):
    """All lines: Combined lines are Common lines with more behind them."""
    return parse.parse_common(tables.lines(spark, d))


@query(
    "b02_parse_combined",
    f"""SELECT * EXCLUDE (referrer), 'web_server_log' AS source,
        CASE WHEN regexp_matches(lower(user_agent), '{"|".join(fixed.BOT_KEYWORDS)}')
          THEN 1 ELSE 0 END AS is_bot
        FROM (SELECT unnest({extracted(COMBINED, [*_RAW, "referrer", "user_agent"])})
        FROM lines WHERE regexp_matches(value, '{COMBINED}'))""",
)
def parse_combined(spark, d):
    return parse.parse_combined(tables.lines(spark, d))


_SERVER_FIELDS = ["timestamp", "log_level", "thread", "component", "message"]


@query(
    "b03_parse_server",
    "SELECT "
    + ", ".join(
        f"""regexp_extract(value, '{SERVER}', {i}) AS "{n}" """
        for i, n in enumerate(_SERVER_FIELDS, 1)
    )
    + ", value AS raw_log FROM server_lines",
)
def parse_server(spark, d):
    return parse.parse_server(tables.server_lines(spark, d).select("value"))


@query(
    "b04_server_fields",
    f"""SELECT CASE WHEN ts <> '' THEN strptime(replace(ts, ',', '.'), '%Y-%m-%d %H:%M:%S.%g') END
          AS "timestamp", log_level, 'yarn' AS system, component, message,
        nullif(regexp_extract(txt, '{fixed.EXCEPTION_PATTERN}', 1), '') AS exception_type,
        CASE WHEN ts = '' THEN value END AS stack_trace,
        nullif(regexp_extract(txt, '{fixed.CONTAINER_PATTERN}', 1), '') AS container_id,
        nullif(regexp_extract(txt, '{fixed.ATTEMPT_PATTERN}', 1), '') AS attempt_id
      FROM (SELECT *, CASE WHEN message <> '' THEN message ELSE value END AS txt
        FROM (SELECT value, unnest({extracted(SERVER, ["ts", *_SERVER_FIELDS[1:]])})
          FROM server_lines))""",
)
def server_fields(spark, d):
    parsed = parse.parse_server(tables.server_lines(spark, d).select("value"))
    return parse.server_fields(parsed)


@query("b05_wellformed_lines", "SELECT source, count(*) AS n FROM access GROUP BY ALL")
def wellformed(spark, d):
    return count_by(tables.access(spark, d), "source").withColumnRenamed("count", "n")


@query(
    "b06_rejected_lines",
    f"""SELECT value, source FROM lines WHERE NOT regexp_matches(value,
        CASE WHEN source = 'access_log' THEN '{COMMON}' ELSE '{COMBINED}' END)""",
)
def rejected(spark, d):
    return rejected_lines(*tables.by_source(spark, d))


# -- scalar functions ---------------------------------------------------------------


def _raw_rows(spark, d):
    common, combined = tables.by_source(spark, d)
    return parse.parse_common(common).unionByName(parse.parse_combined(combined))


@query(
    "c01_zoned_timestamp",
    """SELECT timestamp_raw, strptime(left(timestamp_raw, 20), '%d/%b/%Y:%H:%M:%S') AS "timestamp"
      FROM raw_rows""",
)
def zoned_timestamp(spark, d):
    raw = F.col("timestamp_raw")
    return _raw_rows(spark, d).select(raw, rq.zoned_timestamp(raw).alias("timestamp"))


@query(
    "c02_bytes",
    """SELECT bytes_raw, CASE WHEN bytes_raw = '-' THEN 0 ELSE CAST(bytes_raw AS BIGINT) END AS bytes
      FROM raw_rows""",
)
def byte_counts(spark, d):
    raw = F.col("bytes_raw")
    return _raw_rows(spark, d).select(raw, rq.byte_count(raw).alias("bytes"))


def _column_query(name, *columns, relation="access"):
    quoted = ", ".join(f'"{c}"' for c in columns)

    @query(name, f"SELECT {quoted} FROM {relation}")
    def select(spark, d):
        return getattr(tables, relation)(spark, d).select(*columns)


_column_query("c03_is_error", "status_code", "is_error")
_column_query("c04_status_class", "status_code", "status_class")
_column_query("c05_is_bot", "user_agent", "is_bot")


@query(
    "c06_status_code",
    "SELECT status_raw, CAST(status_raw AS INTEGER) AS status_code FROM raw_rows",
)
def status_code(spark, d):
    raw = F.col("status_raw")
    return _raw_rows(spark, d).select(raw, rq.status_number(raw).alias("status_code"))


@query(
    "c07_missing_user_agent",
    "SELECT source, count(*) AS n, count(user_agent) AS known FROM access GROUP BY ALL",
)
def missing_user_agent(spark, d):
    return (
        tables.access(spark, d)
        .groupBy("source")
        .agg(F.count("*").alias("n"), F.count("user_agent").alias("known"))
    )


_column_query(
    "c08_access_columns",
    "timestamp", "ip", "method", "endpoint", "status_code", "bytes", "user_agent", "is_bot",
    "is_error", "status_class", "source",
)
_column_query("c09_error_severity", "status_code", "error_severity", relation="enriched")
_column_query("c10_hour_of_day", "timestamp", "hour_of_day", relation="enriched")
_column_query("c11_day_of_week", "timestamp", "day_of_week", relation="enriched")
_column_query("c12_off_hours", "hour_of_day", "is_off_hours", relation="enriched")


@query(
    "c13_day_name",
    """SELECT day_of_week, CASE day_of_week WHEN 1 THEN 'Sun' WHEN 2 THEN 'Mon' WHEN 3 THEN 'Tue'
      WHEN 4 THEN 'Wed' WHEN 5 THEN 'Thu' WHEN 6 THEN 'Fri' ELSE 'Sat' END AS day_name FROM enriched""",
)
def day_name(spark, d):
    day = F.col("day_of_week")
    return tables.enriched(spark, d).select(day, rq.lookup(day, fixed.DAY_NAMES).alias("day_name"))


@query(
    "c14_flag_labels",
    """SELECT is_bot, is_off_hours, CASE is_bot WHEN 0 THEN 'Human' ELSE 'Bot' END AS client,
      CASE is_off_hours WHEN 0 THEN 'Business Hours (8–22)' ELSE 'Off Hours' END AS period
      FROM enriched""",
)
def flag_labels(spark, d):
    return tables.enriched(spark, d).select(
        "is_bot",
        "is_off_hours",
        rq.lookup(F.col("is_bot"), fixed.BOT_LABELS).alias("client"),
        rq.lookup(F.col("is_off_hours"), fixed.OFF_HOURS_LABELS).alias("period"),
    )


# -- filters ------------------------------------------------------------------------


@query("d01_bot_rows", "SELECT ip, user_agent, endpoint FROM access WHERE is_bot = 1")
def bot_rows(spark, d):
    bots = tables.access(spark, d).filter(F.col("is_bot") == 1)
    return bots.select("ip", "user_agent", "endpoint")


@query("d01_error_rows", "SELECT ip, status_code, endpoint FROM access WHERE is_error = 1")
def error_rows(spark, d):
    errors = tables.access(spark, d).filter(F.col("is_error") == 1)
    return errors.select("ip", "status_code", "endpoint")


@query(
    "d02_null_timestamps",
    f"""SELECT value FROM server_lines WHERE regexp_extract(value, '{SERVER}', 1) = ''""",
)
def null_timestamps(spark, d):
    """Server-log lines without a readable time."""
    parsed = parse.parse_server(tables.server_lines(spark, d).select("value"))
    when = rq.zoned_timestamp(F.col("timestamp"), fixed.SERVER_TIME_FORMAT)
    return parsed.filter(when.isNull()).select(F.col("raw_log").alias("value"))


@query(
    "d03_known_methods",
    """SELECT method, count(*) AS "count" FROM access WHERE method IN ('GET', 'POST', 'PUT',
      'DELETE', 'HEAD', 'OPTIONS', 'PATCH', 'CONNECT', 'TRACE', 'PROPFIND') GROUP BY ALL""",
)
def known_methods(spark, d):
    return reports.methods(tables.access(spark, d))


@query(
    "d04_rated_errors",
    "SELECT ip, status_code, error_severity FROM enriched WHERE error_severity <> 'none'",
)
def rated_errors(spark, d):
    rated = tables.enriched(spark, d).filter(F.col("error_severity") != "none")
    return rated.select("ip", "status_code", "error_severity")


@query(
    "d04_unusual_windows",
    "SELECT ip, window_start, anomaly_type FROM windows WHERE anomaly_type <> 'normal'",
)
def unusual_windows(spark, d):
    unusual = tables.windows(spark, d).filter(F.col("anomaly_type") != "normal")
    return unusual.select("ip", "window_start", "anomaly_type")


@query(
    "d05_high_severity",
    """SELECT ip, window_start, round(severity_score, 6) AS severity_score, 'high' AS severity
      FROM windows WHERE severity_score >= 0.3""",
)
def high_severity(spark, d):
    """Score bands lowered: no day window here reaches the default 0.7."""
    bands = replace(tables.DAY_LIMITS, high_score=0.3, medium_score=0.1)
    windows = client_windows(tables.enriched(spark, d), bands, tables.DAY)
    severe = windows.filter(F.col("severity") == "high")
    return severe.select("ip", "window_start", "severity_score", "severity")


@query("d06_known_user_agents", "SELECT user_agent FROM access WHERE user_agent IS NOT NULL")
def known_user_agents(spark, d):
    return tables.access(spark, d).dropna(subset=["user_agent"]).select("user_agent")


# -- quality ------------------------------------------------------------------------


@query(
    "e08_quality",
    """SELECT count(*) AS total_rows, count(*) FILTER (is_bot = 1) AS bot_traffic,
      count(*) FILTER (is_error = 1) AS error_rows,
      count(*) FILTER ("timestamp" IS NULL) AS null_timestamps,
      round(100.0::DOUBLE * count(*) FILTER (is_bot = 1) / count(*), 6) AS bot_pct,
      round(100.0::DOUBLE * count(*) FILTER (is_error = 1) / count(*), 6) AS error_pct,
      round(100.0::DOUBLE * count(*) FILTER ("timestamp" IS NULL) / count(*), 6)
        AS null_timestamp_pct FROM access""",
)
def quality(spark, d):
    return clean.quality(tables.access(spark, d))


@query("g01_union", "SELECT source, ip, endpoint, status_code FROM access")
def union(spark, d):
    return tables.access(spark, d).select("source", "ip", "endpoint", "status_code")


_DECLARED = [
    ("timestamp", "timestamp", 0), ("ip", "string", 0), ("method", "string", 0),
    ("endpoint", "string", 0), ("status_code", "int", 0), ("bytes", "bigint", 1),
    ("user_agent", "string", 1), ("is_bot", "int", 0), ("is_error", "int", 0),
    ("status_class", "string", 0), ("source", "string", 0),
]


@query(
    "j12_schema_conformance",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS declared_type, '{t}' AS actual_type,
        {n} AS null_allowed, count(*) FILTER ("{c}" IS NULL) AS nulls,
        CASE WHEN {n} = 0 THEN count(*) FILTER ("{c}" IS NULL) ELSE 0 END AS violations FROM access"""
        for c, t, n in _DECLARED
    ),
)
def schema_conformance(spark, d):
    return null_violations(tables.access(spark, d))
