"""Request-level features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens import fixed_values as fixed
from trafficlens.functions import requests as rq
from trafficlens.operators.ranking import WEIGHT


def enrich(access: DataFrame, zone: str | None = None) -> DataFrame:
    """Add error severity, hour, weekday and the off-hours flag.

    Hours and days are read in ``zone``, or in the session time zone when None.
    """
    clock = rq.local_time(F.col("timestamp"), zone)
    return access.select(
        "*",
        rq.error_severity(F.col("status_code")).alias("error_severity"),
        F.hour(clock).alias("hour_of_day"),
        F.dayofweek(clock).alias("day_of_week"),
        rq.off_hours_flag(F.hour(clock)).alias("is_off_hours"),
    )


def request_profile(enriched: DataFrame) -> DataFrame:
    """Request counts over the low-cardinality columns.

    One scan feeds all request reports: they sum the ``requests`` column of this
    table instead of reading the rows again. Methods outside the known verbs are
    folded into null and the columns that follow from the status or the hour are
    rebuilt after the aggregation, which bounds the key space by sources x
    statuses x verbs x 2 x 24 x 7 whatever the size of the log.
    """
    verb = F.when(F.col("method").isin(*fixed.HTTP_METHODS), F.col("method"))
    keys = ["source", "status_code", "method", "is_bot", "hour_of_day", "day_of_week"]
    counts = (
        enriched.withColumn("method", verb)
        .groupBy(*keys)
        .agg(F.count("*").alias("requests", metadata=WEIGHT))
    )
    status = F.col("status_code")
    return counts.select(
        "*",
        rq.status_class(status).alias("status_class"),
        rq.error_flag(status).alias("is_error"),
        rq.error_severity(status).alias("error_severity"),
        rq.off_hours_flag(F.col("hour_of_day")).alias("is_off_hours"),
    )
