"""Small helpers around DataFrames that the operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trafficlens.shipping import ship_package
from trafficlens.sources.workspace import scratch_path


_TEMPORARY: ContextVar[str | None] = ContextVar("temporary", default=None)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors.

    Inside ``temporary`` the table goes when the block ends, unless it is to ``keep``
    because a result that is yet to be computed reads it.
    """
    path = scratch_path(df.sparkSession, name) if keep else temporary_path(df, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def temporary_path(df: DataFrame, name: str) -> str:
    """A fresh path that goes with the enclosing ``temporary`` block, if there is one."""
    root = _TEMPORARY.get()
    return scratch_path(df.sparkSession, name) if root is None else f"{root}/{name}-{uuid.uuid4().hex}"


@contextmanager
def temporary(df: DataFrame):
    """Remove the tables stored in this block when it ends; blocks may be nested."""
    spark = df.sparkSession
    root = scratch_path(spark, "temporary")
    token = _TEMPORARY.set(root)
    try:
        yield
    finally:
        _TEMPORARY.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_batches(
    df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """``mapInArrow`` with the package at hand in the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(task, schema)


def with_fields(df: DataFrame, **kinds: str) -> StructType:
    """The schema of ``df`` with more fields behind."""
    schema = StructType(list(df.schema.fields))
    for name, kind in kinds.items():
        schema = schema.add(name, kind)
    return schema


def crc_fold(column: str, folds: int = 4):
    """crc32 of the value as text, modulo ``folds``; null for a null value."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds
