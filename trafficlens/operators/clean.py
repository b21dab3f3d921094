"""Typed access rows and their quality counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.functions import requests as rq
from trafficlens.operators.ranking import percent, weight, weight_column
from trafficlens.schema import ACCESS_SCHEMA


def clean(parsed: DataFrame, *carried: str) -> DataFrame:
    """Cast the raw strings of well-formed lines and add the status columns.

    Runs after the malformed lines are gone, and every cast is a ``try_`` one, so
    a bad value becomes null instead of failing the job, with ANSI mode on or off.
    Columns that are ``carried`` come through as they are.
    """
    typed = parsed.withColumn("status_code", rq.status_number(F.col("status_raw")))
    status = F.col("status_code")
    return typed.select(
        # the one-element explode keeps later tests of the time from parsing it again
        F.explode(F.array(rq.zoned_timestamp(F.col("timestamp_raw")))).alias("timestamp"),
        "ip",
        "method",
        "endpoint",
        status,
        rq.byte_count(F.col("bytes_raw")).alias("bytes"),
        "user_agent",
        "is_bot",
        rq.error_flag(status).alias("is_error"),
        rq.status_class(status).alias("status_class"),
        "source",
        *carried,
    )


def merge(*cleaned: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """All rows of all sources, matched by column name; duplicates stay."""
    return reduce(DataFrame.unionByName, cleaned).select(*ACCESS_SCHEMA.names, *carried)


def quality(access: DataFrame) -> DataFrame:
    """Row, bot, error and null-timestamp counts with percentages, in one pass.

    Takes access rows or a request profile.
    """
    n = weight(access)
    # a profile has no time of a single row, but the hour of all of them
    clock = F.col("hour_of_day") if weight_column(access) else F.col("timestamp")

    def rows_where(condition):
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0)).cast("bigint")

    counts = access.agg(
        F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("total_rows"),
        rows_where(F.col("is_bot") == 1).alias("bot_traffic"),
        rows_where(F.col("is_error") == 1).alias("error_rows"),
        rows_where(clock.isNull()).alias("null_timestamps"),
    )
    total = F.col("total_rows")
    return counts.select(
        "*",
        percent(F.col("bot_traffic"), total).alias("bot_pct"),
        percent(F.col("error_rows"), total).alias("error_pct"),
        percent(F.col("null_timestamps"), total).alias("null_timestamp_pct"),
    )
