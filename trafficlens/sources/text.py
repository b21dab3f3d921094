"""Line-oriented input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PathOrPaths = str | list[str]


def read_lines(spark: SparkSession, path: PathOrPaths) -> DataFrame:
    """One row per line of a file, list of files, folder or glob."""
    return spark.read.text(path)


def stream_lines(
    spark: SparkSession, folder: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """The same rows from a folder that keeps receiving files."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(folder)


def lines_per_file(spark: SparkSession, path: PathOrPaths) -> DataFrame:
    """(file, lines) for every file under ``path``, empty files included, in one job.

    Empty files have no rows to count; their names come from the file listing that
    the reader holds anyway.
    """
    lines = spark.read.text(path)
    listed = spark.createDataFrame(
        [(name,) for name in lines.inputFiles()], "file string"
    ).withColumn("n", F.lit(0))
    read = lines.select(F.col("_metadata.file_path").alias("file"), F.lit(1).alias("n"))
    # the two spell local paths with one and with three slashes
    name = F.regexp_replace("file", "^file:/+", "file:/").alias("file")
    return read.unionByName(listed).groupBy(name).agg(F.sum("n").alias("lines"))
