"""Output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Header, no index. For report-sized frames; ordered frames keep their order.

    Like every named target, what is there already is only replaced on request.
    """
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Parquet, for frames that grow with the log."""
    df.write.mode(mode).parquet(path)
    return path


def cut(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as parquet and read it back: later steps start from the files."""
    spark: SparkSession = df.sparkSession
    return spark.read.schema(df.schema).parquet(write_table(df, path))
