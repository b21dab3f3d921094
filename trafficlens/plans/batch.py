"""The whole batch run: logs in, tables, reports and models out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trafficlens.functions.rules import Thresholds
from trafficlens.operators.enrich import enrich, request_profile
from trafficlens.operators.windows import client_windows
from trafficlens.plans import reports, training
from trafficlens.plans.access import ROUTED, lines_of, routed_rows
from trafficlens.plans.server import read_typed_server
from trafficlens.schema import null_counters, violations
from trafficlens.sources.sinks import cut, write_csv
from trafficlens.sources.text import PathOrPaths, lines_per_file


@dataclass
class Tables:
    """What later steps read. All but ``requests`` and ``windows`` are small or rankable
    without another look at the log."""

    requests: DataFrame
    windows: DataFrame
    profile: DataFrame
    clients: DataFrame
    endpoints: DataFrame
    rejected: DataFrame
    histograms: DataFrame
    conformance: DataFrame


def build_tables(
    spark: SparkSession,
    common_path: PathOrPaths | None,
    combined_path: PathOrPaths | None,
    folder: str,
    limits: Thresholds = Thresholds(),
    duration: str = "1 minute",
    zone: str | None = None,
) -> Tables:
    """Read and parse the text once; everything else starts from the parquet copy.

    Enriched requests and rejected lines are written as they come, without a shuffle, to
    partitions of their own below ``requests``; nulls are counted on the way. Windows, profile
    and totals then read only the columns they need, and a lost executor costs the tasks
    it was running, not the parse.
    """
    every_line = enrich(routed_rows(*lines_of(spark, common_path, combined_path)), zone)
    passed = Observation("conformance")
    counted = every_line.observe(passed, *null_counters(among=F.col("accepted")))
    counted.write.partitionBy("accepted").parquet(f"{folder}/requests")
    stored = spark.read.schema(every_line.schema).parquet(f"{folder}/requests")
    requests = stored.filter("accepted").drop(*ROUTED)
    rejected = stored.filter("NOT accepted").select(F.col("rejected_line").alias("value"), "source")
    conformance = violations(spark, passed.get, requests.schema)
    windows = cut(client_windows(requests, limits, duration), f"{folder}/windows")
    profile = cut(request_profile(requests), f"{folder}/profile")
    clients = cut(reports.client_totals(requests), f"{folder}/clients")
    endpoints = cut(
        requests.groupBy("endpoint").agg(F.count("*").alias("requests")), f"{folder}/endpoints"
    )
    histograms = cut(reports.window_histograms(windows), f"{folder}/histograms")
    return Tables(requests, windows, profile, clients, endpoints, rejected, histograms, conformance)


def report_tables(tables: Tables) -> dict[str, DataFrame]:
    """All report tables by name."""
    p, w = tables.profile, tables.windows
    top_endpoints = reports.top_k(
        tables.endpoints.select("endpoint", F.col("requests").alias("count")),
        10,
        "count",
        "endpoint",
    )
    return {
        "status_codes": reports.status_codes(p),
        "status_classes": reports.status_classes(p),
        "bot_share": reports.bot_share(p),
        "sources": reports.sources(p),
        "methods": reports.methods(p),
        "top_clients": reports.rank_clients(tables.clients),
        "top_endpoints": top_endpoints,
        "top_error_clients": reports.rank_clients(tables.clients, by="errors"),
        "requests_by_hour": reports.requests_by_hour(p),
        "requests_by_weekday": reports.requests_by_weekday(p),
        "error_rate_by_hour": reports.error_rate_by_hour(p),
        "off_hours_share": reports.off_hours_share(p),
        "error_severities": reports.error_severities(p),
        "errors_by_source": reports.errors_by_source(p),
        "anomaly_types": reports.anomaly_types(w),
        "severities": reports.severities(w),
        "score_histogram": reports.one_histogram(tables.histograms, "severity_score"),
        "request_count_histogram": reports.one_histogram(tables.histograms, "request_count"),
        "error_rate_histogram": reports.one_histogram(tables.histograms, "error_rate"),
        "anomaly_by_severity": reports.anomaly_by_severity(w),
        "business_summary": reports.business_summary(p, w),
        "anomaly_breakdown": reports.anomaly_breakdown(w),
        "peak_error_hours": reports.peak_error_hours(p),
        "anomaly_distribution": reports.anomaly_distribution(w),
        "run_stats": reports.run_stats(p, w),
        "rejected_lines": reports.sources(tables.rejected),
        "conformance": tables.conformance,
    }


def run(
    spark: SparkSession,
    common_path: PathOrPaths | None,
    combined_path: PathOrPaths | None,
    folder: str,
    limits: Thresholds = Thresholds(),
    duration: str = "1 minute",
    zone: str | None = None,
    train: bool = True,
    parallelism: int = 1,
    server_path: PathOrPaths | None = None,
) -> tuple[Tables, training.Trained | None]:
    """Tables as parquet, reports as CSV and, with ``train``, models below ``folder``.

    Either access log may be None. With ``server_path`` the typed server-log rows and
    their lines per file are written too. Nothing that is in ``folder`` is replaced.
    """
    if server_path is not None:
        cut(read_typed_server(spark, server_path), f"{folder}/server")
        write_csv(lines_per_file(spark, server_path), f"{folder}/reports/server_lines_per_file")
    tables = build_tables(spark, common_path, combined_path, folder, limits, duration, zone)
    for name, table in report_tables(tables).items():
        write_csv(table, f"{folder}/reports/{name}")
    if not train:
        return tables, None
    trained = training.run_training(
        tables.windows, save_to=f"{folder}/models", parallelism=parallelism
    )
    write_csv(trained.metrics.coalesce(1), f"{folder}/reports/model_metrics")
    write_csv(trained.kmeans_scores.coalesce(1), f"{folder}/reports/kmeans_scores")
    write_csv(trained.confusion.coalesce(1), f"{folder}/reports/confusion_matrices")
    write_csv(trained.classes.coalesce(1), f"{folder}/reports/class_metrics")
    write_csv(trained.composition.coalesce(1), f"{folder}/reports/cluster_composition")
    return tables, trained
