"""Counting, shares, ordering and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# metadata of the column that says how many rows a pre-aggregated row stands for
WEIGHT = {"rows_per_row": True}


def weight_column(df: DataFrame) -> str | None:
    """The column that its maker declared as the weight; no name makes a column one."""
    declared = [f.name for f in df.schema.fields if f.metadata == WEIGHT]
    return declared[0] if declared else None


def weight(df: DataFrame) -> Column:
    """How many rows one row stands for: 1, or the count of a pre-aggregated profile."""
    name = weight_column(df)
    return F.col(name) if name else F.lit(1)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, null for an empty whole."""
    return F.try_divide(100.0 * part, whole)


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(weight(df)).cast("bigint").alias("count"))


def with_share(counts: DataFrame) -> DataFrame:
    """Percentage of the total, for count tables with a handful of classes.

    The total is taken over the already aggregated rows, so the single-partition
    window sees one row per class, never the input.
    """
    everything = Window.partitionBy(F.lit(0))
    return counts.withColumn(
        "share_pct", percent(F.col("count"), F.sum("count").over(everything))
    )


def by_count(counts: DataFrame, *ties: str) -> DataFrame:
    """Largest first; equal counts in key order so that the order is repeatable."""
    return counts.orderBy(F.desc("count"), *[F.asc(c) for c in ties])


def top_k(df: DataFrame, k: int, by: str, *ties: str) -> DataFrame:
    """The k largest by ``by``: each task keeps k rows, only those meet."""
    return df.orderBy(F.desc(by), *[F.asc(c) for c in ties]).limit(k)
