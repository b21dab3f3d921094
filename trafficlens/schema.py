"""Declared row shapes and the conformance check against them."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACCESS_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("ip", T.StringType(), False),
    T.StructField("method", T.StringType(), False),
    T.StructField("endpoint", T.StringType(), False),
    T.StructField("status_code", T.IntegerType(), False),
    T.StructField("bytes", T.LongType(), True),
    T.StructField("user_agent", T.StringType(), True),
    T.StructField("is_bot", T.IntegerType(), False),
    T.StructField("is_error", T.IntegerType(), False),
    T.StructField("status_class", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
])

# fixed values: column names, types and nullability
SERVER_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("log_level", T.StringType(), False),
    T.StructField("system", T.StringType(), False),
    T.StructField("component", T.StringType(), True),
    T.StructField("message", T.StringType(), False),
    T.StructField("exception_type", T.StringType(), True),
    T.StructField("stack_trace", T.StringType(), True),
    T.StructField("container_id", T.StringType(), True),
    T.StructField("attempt_id", T.StringType(), True),
])


def check_schema(
    df: DataFrame, expected: T.StructType = ACCESS_SCHEMA, strict: bool = False
) -> DataFrame:
    """Return ``df`` unchanged if it has the declared columns.

    A missing column raises, an extra one warns. ``strict`` also compares types
    and rejects extra columns.
    """
    actual = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in expected.fields if f.name not in actual]
    extra = [name for name in actual if name not in expected.names]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if extra and strict:
        raise ValueError(f"unexpected columns: {extra}")
    if extra:
        warnings.warn(f"unexpected extra columns: {extra}", stacklevel=2)
    if strict:
        wrong = {
            f.name: (f.dataType.simpleString(), actual[f.name].simpleString())
            for f in expected.fields
            if f.dataType != actual[f.name]
        }
        if wrong:
            raise ValueError(f"wrong types (declared, actual): {wrong}")
    return df


def null_counters(expected: T.StructType = ACCESS_SCHEMA, among: Column | None = None) -> list[Column]:
    """Counts of nulls, named like the declared columns, to be taken along while rows pass."""
    rows = F.lit(True) if among is None else among
    return [F.count_if(rows & F.col(f.name).isNull()).alias(f.name) for f in expected.fields]


def violations(
    spark: SparkSession, nulls: dict[str, int], actual: T.StructType, expected: T.StructType = ACCESS_SCHEMA
) -> DataFrame:
    """What ``null_violations`` gives, from counts taken earlier."""
    rows = [
        (
            f.name,
            f.dataType.simpleString(),
            actual[f.name].dataType.simpleString(),
            int(f.nullable),
            nulls[f.name],
            0 if f.nullable else nulls[f.name],
        )
        for f in expected.fields
    ]
    names = "column string, declared_type string, actual_type string, null_allowed int, nulls long, violations long"
    return spark.createDataFrame(rows, names)


def null_violations(df: DataFrame, expected: T.StructType = ACCESS_SCHEMA) -> DataFrame:
    """One row per declared column, with its null count, from a single pass."""
    check_schema(df, expected)
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    counters = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("declared_type"),
            F.lit(actual[f.name]).alias("actual_type"),
            F.lit(int(f.nullable)).alias("null_allowed"),
            F.count_if(F.col(f.name).isNull()).alias("nulls"),
        )
        for f in expected.fields
    ]
    rows = df.agg(F.array(*counters).alias("rows")).select(F.inline("rows"))
    return rows.withColumn(
        "violations", F.when(F.col("null_allowed") == 0, F.col("nulls")).otherwise(0)
    )
