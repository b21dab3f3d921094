"""Application-server logs, many files at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trafficlens.operators.parse import parse_server, server_fields
from trafficlens.sources.text import PathOrPaths, read_lines


def read_server(spark: SparkSession, path: PathOrPaths) -> DataFrame:
    """String fields and raw text of every line below ``path``."""
    return parse_server(read_lines(spark, path))


def read_typed_server(
    spark: SparkSession, path: PathOrPaths, system: str = "yarn"
) -> DataFrame:
    """The declared server-log columns of every line below ``path``."""
    return server_fields(read_server(spark, path), system)
