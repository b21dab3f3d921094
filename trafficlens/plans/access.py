"""Raw lines of both log formats to one table of access rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens import fixed_values as fixed
from trafficlens.operators import clean, parse
from trafficlens.schema import check_schema
from trafficlens.sources.text import PathOrPaths, read_lines


def access_rows(
    common_lines: DataFrame | None = None, combined_lines: DataFrame | None = None
) -> DataFrame:
    """Access rows of one or both formats."""
    parsed = []
    if common_lines is not None:
        parsed.append(parse.parse_common(common_lines))
    if combined_lines is not None:
        parsed.append(parse.parse_combined(combined_lines))
    if not parsed:
        raise ValueError("no lines of either format")
    return check_schema(clean.merge(*map(clean.clean, parsed)))


def rejected_lines(
    common_lines: DataFrame | None = None, combined_lines: DataFrame | None = None
) -> DataFrame:
    """(value, source) of every line that is not in ``access_rows``."""
    rejected = [
        parse.quarantine(lines.select("value"), fmt).withColumn("source", F.lit(source))
        for lines, fmt, source in (
            (common_lines, parse.COMMON, fixed.ACCESS_SOURCE),
            (combined_lines, parse.COMBINED, fixed.WEB_SERVER_SOURCE),
        )
        if lines is not None
    ]
    return reduce(DataFrame.unionByName, rejected)


ROUTED = ("accepted", "rejected_line")


def routed_rows(
    common_lines: DataFrame | None = None, combined_lines: DataFrame | None = None
) -> DataFrame:
    """Every line of one or both formats once: access rows with ``accepted`` and, for the
    lines that are none, ``rejected_line`` and nulls."""
    routed = []
    if common_lines is not None:
        routed.append(parse.as_common(parse.route(common_lines, parse.COMMON)))
    if combined_lines is not None:
        routed.append(parse.as_combined(parse.route(combined_lines, parse.COMBINED)))
    if not routed:
        raise ValueError("no lines of either format")
    return clean.merge(*(clean.clean(rows, *ROUTED) for rows in routed), carried=ROUTED)


def lines_of(
    spark: SparkSession, common_path: PathOrPaths | None, combined_path: PathOrPaths | None
) -> tuple[DataFrame | None, DataFrame | None]:
    return tuple(
        read_lines(spark, path) if path else None for path in (common_path, combined_path)
    )


def read_access(
    spark: SparkSession,
    common_path: PathOrPaths | None = None,
    combined_path: PathOrPaths | None = None,
) -> DataFrame:
    return access_rows(*lines_of(spark, common_path, combined_path))
