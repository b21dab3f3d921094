"""Train / validation / test split."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens import fixed_values as fixed

WINDOW_KEY = ("ip", "window_start")


def hash_fraction(*keys: str) -> Column:
    """Number in [0, 1) that depends on the key values only.

    The same row gets the same number on every run, layout and engine, also when
    a lost task is computed again.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))


def hash_split(
    df: DataFrame,
    keys: tuple[str, ...],
    weights: Mapping[str, float] = fixed.SPLIT_WEIGHTS,
) -> DataFrame:
    """Add a ``split`` column with the given shares; no shuffle and no sort."""
    total = sum(weights.values())
    names = list(weights)
    upper, chosen = 0.0, F
    for name in names[:-1]:
        upper += weights[name] / total
        chosen = chosen.when(F.col("_fraction") < round(upper, 12), name)
    return (
        df.withColumn("_fraction", hash_fraction(*keys))
        .withColumn("split", chosen.otherwise(names[-1]))
        .drop("_fraction")
    )


def window_split(
    windows: DataFrame, weights: Mapping[str, float] = fixed.SPLIT_WEIGHTS
) -> DataFrame:
    """Split client windows by client and start second."""
    keyed = windows.withColumn("_second", F.unix_seconds("window_start"))
    return hash_split(keyed, ("ip", "_second"), weights).drop("_second")


def random_split(
    df: DataFrame, seed: int = fixed.SEED
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two-step 60/20/20 ``randomSplit``, for comparison with earlier runs.

    Depends on how the rows are laid out in partitions; prefer ``hash_split``.
    """
    rest, test = df.randomSplit([0.8, 0.2], seed=seed)
    train, validation = rest.randomSplit([0.75, 0.25], seed=seed)
    return train, validation, test
