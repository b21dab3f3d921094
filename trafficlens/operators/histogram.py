"""Equal-width histograms computed on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """``bins`` rows of (bin, bin_start, bin_end, count) over [min, max]; see ``histograms``."""
    return histograms(df, {column: bins}).drop("column")


def histograms(df: DataFrame, bins: dict[str, int]) -> DataFrame:
    """(column, bin, bin_start, bin_end, count) of several columns, from one pass over ``df``.

    Bins are half open, the last one is closed; null and NaN are left out. A
    constant column is widened by 0.5 on both sides and an empty one spans [0, 1].
    The pass counts equal values, inside each task first; bounds and bins are then
    found from these counts, so the result is exact and the input is read once.
    """
    name, x = F.col("column"), F.col("x")
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in bins]
    )
    values = (
        df.select(F.inline(pairs))
        .filter(x.isNotNull() & ~F.isnan(x))
        .groupBy("column", "x")
        .agg(F.count("*").alias("n"))
    )
    low, high = F.col("low"), F.col("high")
    asked = df.sparkSession.createDataFrame(list(bins.items()), "column string, bins int")
    # the counts are taken along, so that both uses of ``values`` share one exchange
    found = values.groupBy("column").agg(
        F.min(x).alias("low"), F.max(x).alias("high"), F.sum("n").alias("total")
    )
    empty = F.col("total").isNull()
    # a row for each column that was asked for
    bounds = F.broadcast(
        asked.join(found, "column", "left").select(
            "column",
            "bins",
            F.when(empty, 0.0).when(low == high, low - 0.5).otherwise(low).alias("low"),
            F.when(empty, 1.0).when(low == high, high + 0.5).otherwise(high).alias("high"),
        )
    )

    def edge(i):
        return F.when(i == F.col("bins"), high).otherwise(low + i * ((high - low) / F.col("bins")))

    guess = F.least(F.floor((x - low) / (high - low) * F.col("bins")), F.col("bins") - 1)
    # the division may land one bin off; the edges decide
    settled = (
        F.when(x < edge(F.col("guess")), F.col("guess") - 1)
        .when((F.col("guess") < F.col("bins") - 1) & (x >= edge(F.col("guess") + 1)), F.col("guess") + 1)
        .otherwise(F.col("guess"))
    )
    counts = (
        values.join(bounds, "column")
        .withColumn("guess", guess)
        .groupBy("column", settled.cast("int").alias("bin"))
        .agg(F.sum("n").alias("filled"))
    )
    all_bins = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    return all_bins.join(counts, ["column", "bin"], "left").select(
        name,
        "bin",
        edge(F.col("bin")).alias("bin_start"),
        edge(F.col("bin") + 1).alias("bin_end"),
        F.coalesce("filled", F.lit(0)).alias("count"),
    )
