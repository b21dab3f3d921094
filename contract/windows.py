"""Queries over client windows: aggregation, rules, sliding and streaming variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract import tables
from contract.registry import query
from contract.sql import MEASURES, ruled, window_counts
from trafficlens.operators import windows as ops
from trafficlens.operators.clean import clean
from trafficlens.operators.enrich import enrich
from trafficlens.operators.parse import parse_common
from trafficlens.plans.access import access_rows
from trafficlens.sources.sinks import cut
from trafficlens.sources.text import stream_lines
from trafficlens.sources.workspace import scratch_path
from trafficlens.streaming import windows as streaming


@query(
    "e01_minute_windows",
    f"SELECT ip, window_start, window_end, {MEASURES} FROM minute_counts",
)
def minute_windows(spark, d):
    return ops.window_counts(tables.enriched(spark, d))


@query("e01_day_windows", f"SELECT ip, window_start, window_end, {MEASURES} FROM day_counts")
def day_windows(spark, d):
    return ops.window_counts(tables.enriched(spark, d), tables.DAY)


@query(
    "e01_endpoint_windows",
    """SELECT endpoint, day_start AS window_start, count(*) AS request_count,
      round(avg(is_error), 6) AS error_rate FROM enriched GROUP BY endpoint, day_start""",
)
def endpoint_windows(spark, d):
    """The same operator keyed by another column."""
    counts = ops.window_counts(tables.enriched(spark, d), tables.DAY, key="endpoint")
    return counts.select("endpoint", "window_start", "request_count", "error_rate")


def _measure(name, *columns):
    shown = ", ".join(
        f"round({c}, 6) AS {c}" if c in ("avg_bytes", "error_rate") else c for c in columns
    )

    @query(name, f"SELECT ip, window_start, {shown} FROM day_counts")
    def select(spark, d):
        counts = ops.window_counts(tables.enriched(spark, d), tables.DAY)
        return counts.select("ip", "window_start", *columns)


_measure("e02_request_count", "request_count")
_measure("e03_flag_sums", "error_count", "bot_requests", "off_hours_requests")
_measure("e04_avg_bytes", "avg_bytes")
_measure("e05_unique_endpoints", "unique_endpoints")
_measure("e06_severity_counts", "fatal_count", "medium_count", "low_count")
_measure("e07_error_rate", "error_rate")


_SLIDING = """SELECT *, time_bucket(INTERVAL 6 HOUR, "timestamp", TIMESTAMP '1970-01-01')
    - to_hours(6 * step) AS slide_start FROM enriched, (SELECT unnest([0, 1, 2, 3]) AS step)"""


@query("e05_approximate_endpoints", "SELECT ip, window_start, unique_endpoints FROM day_counts")
def approximate_endpoints(spark, d):
    """By sketches, which hold as few endpoints as a day has here exactly."""
    counts = ops.window_counts(tables.enriched(spark, d), tables.DAY, approximate=0.02)
    return counts.select("ip", "window_start", "unique_endpoints")


@query(
    "e05_merged_sketches",
    f""", slid AS ({_SLIDING}), sliding AS ({window_counts("1 DAY", "slide_start", "slid")})
      SELECT ip, window_start, {MEASURES} FROM sliding""",
)
def merged_sketches(spark, d):
    """Sliding days from sketches stored by hour, without going back to the requests."""
    hours = cut(ops.pane_sketches(tables.enriched(spark, d), "1 hour"), scratch_path(spark, "sketches"))
    return ops.from_sketches(hours, tables.DAY, "6 hours").drop("window_end")


@query("f01_anomaly_type", "SELECT ip, window_start, anomaly_type FROM windows")
def anomaly_type(spark, d):
    return tables.windows(spark, d).select("ip", "window_start", "anomaly_type")


@query(
    "f02_severity_score",
    "SELECT ip, window_start, round(severity_score, 6) AS severity_score FROM windows",
)
def severity_score(spark, d):
    return tables.windows(spark, d).select("ip", "window_start", "severity_score")


@query("f03_severity", "SELECT ip, window_start, severity FROM windows")
def severity(spark, d):
    return tables.windows(spark, d).select("ip", "window_start", "severity")


@query(
    "f04_client_windows",
    f"""SELECT ip, window_start, window_end, {MEASURES}, anomaly_type,
      round(severity_score, 6) AS severity_score, severity FROM minute_windows""",
)
def client_windows(spark, d):
    """One-minute windows under the default limits."""
    return ops.client_windows(tables.enriched(spark, d))


@query(
    "k03_sliding_windows",
    f""", slid AS ({_SLIDING}), sliding AS ({window_counts("1 DAY", "slide_start", "slid")}),
      labelled AS ({ruled("sliding", 5, 0.3, 3)})
      SELECT ip, window_start, window_end, {MEASURES}, anomaly_type,
        round(severity_score, 6) AS severity_score, severity FROM labelled""",
)
def sliding_windows(spark, d):
    return ops.client_windows(tables.enriched(spark, d), tables.DAY_LIMITS, tables.DAY, "6 hours")


def _log_folders(spark, d):
    """The two logs as text folders."""
    folders = []
    for name, lines in zip(("common", "combined"), tables.by_source(spark, d), strict=True):
        folders.append(scratch_path(spark, name))
        lines.write.text(folders[-1])
    return folders


@query(
    "k01_stream_windows",
    f"""SELECT ip, window_start, window_end, {MEASURES}, anomaly_type,
        round(severity_score, 6) AS severity_score, severity FROM windows
      WHERE window_end <= (SELECT min(latest) FROM (SELECT max("timestamp") AS latest
        FROM access GROUP BY source)) - INTERVAL 10 MINUTE""",
)
def stream_windows(spark, d):
    """The window job on text folders; windows still open at the end are not emitted."""
    common, combined = _log_folders(spark, d)
    arriving = access_rows(stream_lines(spark, common), stream_lines(spark, combined))
    windows = streaming.stream_client_windows(enrich(arriving), tables.DAY_LIMITS, duration="1 day")
    out = scratch_path(spark, "stream-windows")
    streaming.start(windows, out, scratch_path(spark, "checkpoint"), once=True).awaitTermination()
    return spark.read.schema(windows.schema).parquet(out)


@query(
    "k02_late_rows",
    "SELECT count(*) AS late_rows FROM enriched WHERE day(day_start) <= 10",
)
def late_rows(spark, d):
    """The logs delivered in three batches of four files, newest days first.

    The last batch is behind the watermark.
    """
    folder = scratch_path(spark, "late")
    arriving = _newest_first(spark, d, folder, files=4)
    notes, checkpoint = scratch_path(spark, "late-rows"), scratch_path(spark, "checkpoint")
    streaming.note_late_rows(
        arriving, notes, checkpoint, duration="1 day", once=True
    ).awaitTermination()
    return streaming.late_row_notes(spark, notes).agg(F.sum("late_rows").alias("late_rows"))


def _newest_first(spark, d, folder, files):
    """The stream of all lines, in three parts by day, that many files a batch."""
    lines = tables.lines(spark, d).select("value")
    day = F.regexp_extract("value", r"\[(\d{2})/", 1).try_cast("int")
    newest, oldest = day > 20, day <= 10
    rest = ~F.coalesce(newest | oldest, F.lit(False))
    for name, wanted in (("1", newest), ("2", rest), ("3", oldest)):
        lines.filter(wanted).repartition(files).write.text(f"{folder}/batch={name}")
    return enrich(clean(parse_common(stream_lines(spark, folder, max_files_per_trigger=files))))


@query(
    "k02_dropped_rows",
    """SELECT (SELECT count("timestamp") FROM enriched) AS rows_read, count(*) AS dropped, true AS told_by_state
      FROM enriched WHERE day(day_start) <= 10""",
)
def dropped_rows(spark, d):
    """What the window job itself dropped of the same delivery, from its own books."""
    arriving = streaming.observed(_newest_first(spark, d, scratch_path(spark, "late"), files=4))
    windows = streaming.stream_client_windows(arriving, tables.DAY_LIMITS, duration="1 day")
    out, checkpoint, ledger = (scratch_path(spark, n) for n in ("stream-windows", "checkpoint", "ledger"))
    streaming.run_counted(windows, out, checkpoint, ledger)
    told = streaming.read_ledger(spark, ledger).agg((F.sum("state_rows_dropped") > 0).alias("told_by_state"))
    return streaming.dropped_rows(spark, out, checkpoint, ledger).select(
        "rows_read", "dropped", F.lit(bool(told.first()[0])).alias("told_by_state")
    )
