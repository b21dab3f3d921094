"""Report tables.

Request reports take access rows, enriched rows or the request profile
(``operators.enrich.request_profile``); with the profile they read a few thousand
rows instead of the log. Window reports take client windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens import fixed_values as fixed
from trafficlens.functions import requests as rq
from trafficlens.operators.clean import quality
from trafficlens.operators.histogram import histogram, histograms
from trafficlens.operators.ranking import (
    by_count,
    count_by,
    percent,
    top_k,
    weight,
    with_share,
)

# -- requests -------------------------------------------------------------------


def status_codes(requests: DataFrame, k: int = 15) -> DataFrame:
    return top_k(count_by(requests, "status_code"), k, "count", "status_code")


def status_classes(requests: DataFrame) -> DataFrame:
    return with_share(count_by(requests, "status_class"))


def bot_share(requests: DataFrame) -> DataFrame:
    return with_share(count_by(requests, "is_bot")).withColumn(
        "client", rq.lookup(F.col("is_bot"), fixed.BOT_LABELS)
    )


def sources(requests: DataFrame) -> DataFrame:
    return count_by(requests, "source")


def methods(requests: DataFrame) -> DataFrame:
    """Known verbs only; the filter runs before the aggregation."""
    known = requests.filter(F.col("method").isin(*fixed.HTTP_METHODS))
    return by_count(count_by(known, "method"), "method")


def top_clients(access: DataFrame, k: int = 10) -> DataFrame:
    return top_k(count_by(access, "ip"), k, "count", "ip")


def top_endpoints(access: DataFrame, k: int = 10) -> DataFrame:
    return top_k(count_by(access, "endpoint"), k, "count", "endpoint")


def top_error_clients(access: DataFrame, k: int = 10) -> DataFrame:
    return top_clients(access.filter(F.col("is_error") == 1), k)


def client_totals(access: DataFrame) -> DataFrame:
    """Requests and errors per client: one shuffle for both client rankings."""
    return access.groupBy("ip").agg(
        F.count("*").alias("requests"), F.sum("is_error").alias("errors")
    )


def rank_clients(totals: DataFrame, by: str = "requests", k: int = 10) -> DataFrame:
    """Top clients from ``client_totals``; clients without any do not appear."""
    counted = totals.select("ip", F.col(by).alias("count")).filter(F.col("count") > 0)
    return top_k(counted, k, "count", "ip")


def requests_by_hour(requests: DataFrame) -> DataFrame:
    return count_by(requests, "hour_of_day").orderBy("hour_of_day")


def requests_by_weekday(requests: DataFrame) -> DataFrame:
    named = count_by(requests, "day_of_week").withColumn(
        "day_name", rq.lookup(F.col("day_of_week"), fixed.DAY_NAMES)
    )
    return named.orderBy("day_of_week")


def hourly_errors(requests: DataFrame) -> DataFrame:
    n = weight(requests)
    return (
        requests.groupBy("hour_of_day")
        .agg(
            F.sum(n).cast("bigint").alias("total"),
            F.sum(n * F.col("is_error")).cast("bigint").alias("errors"),
        )
        .withColumn("error_rate", F.col("errors") / F.col("total"))
    )


def error_rate_by_hour(requests: DataFrame) -> DataFrame:
    return hourly_errors(requests).orderBy("hour_of_day")


def peak_error_hours(requests: DataFrame, k: int = 5) -> DataFrame:
    return top_k(hourly_errors(requests), k, "errors", "hour_of_day").drop("error_rate")


def off_hours_share(requests: DataFrame) -> DataFrame:
    return with_share(count_by(requests, "is_off_hours")).withColumn(
        "period", rq.lookup(F.col("is_off_hours"), fixed.OFF_HOURS_LABELS)
    )


def error_severities(requests: DataFrame) -> DataFrame:
    """Error severities from low to fatal, requests without one left out."""
    rated = requests.filter(F.col("error_severity") != "none")
    return count_by(rated, "error_severity").orderBy(
        rq.rank_in(F.col("error_severity"), fixed.ERROR_SEVERITY_ORDER)
    )


def errors_by_source(requests: DataFrame) -> DataFrame:
    """Normal and error requests of each source side by side."""
    pivoted = (
        requests.withColumn("_n", weight(requests))
        .groupBy("source")
        .pivot("is_error", [0, 1])
        .agg(F.sum("_n").cast("bigint"))
    )
    return pivoted.select(
        "source",
        F.coalesce("0", F.lit(0)).cast("bigint").alias("normal"),
        F.coalesce("1", F.lit(0)).cast("bigint").alias("error"),
    )


# -- client windows --------------------------------------------------------------


def anomaly_types(windows: DataFrame) -> DataFrame:
    unusual = windows.filter(F.col("anomaly_type") != "normal")
    return by_count(count_windows(unusual, "anomaly_type"), "anomaly_type")


def count_windows(windows: DataFrame, *keys: str) -> DataFrame:
    return windows.groupBy(*keys).agg(F.count("*").alias("count"))


def severities(windows: DataFrame) -> DataFrame:
    return count_windows(windows, "severity").orderBy(
        rq.rank_in(F.col("severity"), fixed.SEVERITY_ORDER)
    )


WINDOW_BINS = {"severity_score": 40, "request_count": 50, "error_rate": 40}


def window_histograms(windows: DataFrame) -> DataFrame:
    """All three histograms of the windows with the name of their column, from one scan."""
    return histograms(windows, WINDOW_BINS)


def one_histogram(found: DataFrame, column: str) -> DataFrame:
    """The histogram of one column out of ``window_histograms``."""
    return found.filter(F.col("column") == column).drop("column").orderBy("bin")


def score_histogram(windows: DataFrame, bins: int = WINDOW_BINS["severity_score"]) -> DataFrame:
    return histogram(windows, "severity_score", bins)


def request_count_histogram(windows: DataFrame, bins: int = WINDOW_BINS["request_count"]) -> DataFrame:
    return histogram(windows, "request_count", bins)


def error_rate_histogram(windows: DataFrame, bins: int = WINDOW_BINS["error_rate"]) -> DataFrame:
    return histogram(windows, "error_rate", bins)


def anomaly_by_severity(windows: DataFrame) -> DataFrame:
    """Unusual windows: one row per type, one column per severity."""
    unusual = windows.filter(F.col("anomaly_type") != "normal")
    return (
        unusual.groupBy("anomaly_type")
        .pivot("severity", list(fixed.SEVERITY_ORDER))
        .agg(F.count(F.lit(1)))
        .fillna(0, subset=list(fixed.SEVERITY_ORDER))
    )


def anomaly_breakdown(windows: DataFrame) -> DataFrame:
    return by_count(count_windows(windows, "anomaly_type"), "anomaly_type")


def anomaly_distribution(windows: DataFrame) -> DataFrame:
    """Windows per anomaly type and severity, largest first."""
    return by_count(
        count_windows(windows, "anomaly_type", "severity"), "anomaly_type", "severity"
    )


def window_summary(windows: DataFrame) -> DataFrame:
    counts = windows.agg(
        F.count("*").alias("total_windows"),
        F.count_if(F.col("anomaly_type") != "normal").alias("anomalous_windows"),
        F.count_if(F.col("severity") == "high").alias("high_severity_windows"),
    )
    total = F.col("total_windows")
    return counts.select(
        "*",
        percent(F.col("anomalous_windows"), total).alias("anomalous_pct"),
        percent(F.col("high_severity_windows"), total).alias("high_severity_pct"),
    )


# -- both ------------------------------------------------------------------------


def summary_figures(requests: DataFrame, windows: DataFrame) -> DataFrame:
    """(figure, value) rows of the request and the window summary, each from one pass."""

    def long_form(summary: DataFrame) -> DataFrame:
        figures = [
            F.struct(F.lit(name).alias("figure"), F.col(name).cast("double").alias("value"))
            for name in summary.columns
        ]
        return summary.select(F.inline(F.array(*figures)))

    return long_form(quality(requests)).unionByName(long_form(window_summary(windows)))


def business_summary(requests: DataFrame, windows: DataFrame) -> DataFrame:
    figures = summary_figures(requests, windows)
    return figures.filter(~F.col("figure").startswith("null_timestamp"))


def run_stats(requests: DataFrame, windows: DataFrame) -> DataFrame:
    """One row of run figures, percentages to one decimal."""

    def figure(name):
        return F.max(F.when(F.col("figure") == name, F.col("value")))

    def whole(name):
        return figure(name).cast("bigint").alias(name)

    def rounded(name):
        return F.round(figure(name), 1).alias(name)

    return summary_figures(requests, windows).agg(
        whole("total_rows"),
        whole("bot_traffic"),
        rounded("bot_pct"),
        whole("error_rows"),
        rounded("error_pct"),
        whole("null_timestamps"),
        whole("total_windows"),
        whole("anomalous_windows"),
        rounded("anomalous_pct"),
    )
