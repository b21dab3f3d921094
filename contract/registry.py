"""Collects queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contract.sql import TABLES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use every table of ``contract.sql``."""

    def register(build: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: comparable(build(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = TABLES + sql
        return build

    return register


def _six_digits(x):
    """Half away from zero on the binary value, which is how the SQL side rounds."""
    return F.signum(x) * F.floor(F.abs(x) * 1e6 + 0.5) / 1e6


def comparable(df: DataFrame) -> DataFrame:
    """Zone-less timestamps and doubles to six digits, as the SQL side has them."""
    shown = []
    for f in df.schema.fields:
        kind, column = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind == "timestamp":
            column = column.cast("timestamp_ntz")
        elif kind == "double":
            column = _six_digits(column)
        shown.append(column.alias(f.name))
    return df.select(*shown)
