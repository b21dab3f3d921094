"""Batch run from the command line: ``python -m trafficlens``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from trafficlens.plans import batch


def main(arguments: list[str] | None = None) -> None:
    options = argparse.ArgumentParser(prog="trafficlens", description=__doc__)
    options.add_argument("--common", nargs="+", help="Common-format log paths")
    options.add_argument("--combined", nargs="+", help="Combined-format log paths")
    options.add_argument("--server", nargs="+", help="server-log paths")
    options.add_argument("--out", required=True, help="folder for tables, reports and models")
    options.add_argument("--window", default="1 minute", help="window length")
    options.add_argument("--zone", default="UTC", help="zone in which hours and days are read")
    options.add_argument("--no-models", action="store_true", help="stop after the reports")
    options.add_argument("--parallelism", type=int, default=1, help="model fits at a time")
    chosen = options.parse_args(arguments)
    if not (chosen.common or chosen.combined):
        options.error("name logs with --common, --combined or both")
    spark = SparkSession.builder.appName("trafficlens").getOrCreate()
    tables, trained = batch.run(
        spark,
        chosen.common,
        chosen.combined,
        chosen.out,
        duration=chosen.window,
        zone=chosen.zone,
        train=not chosen.no_models,
        parallelism=chosen.parallelism,
        server_path=chosen.server,
    )
    batch.report_tables(tables)["business_summary"].show(truncate=False)
    if trained is not None:
        trained.metrics.show(truncate=False)


if __name__ == "__main__":
    main()
