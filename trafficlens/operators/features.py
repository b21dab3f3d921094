"""From client windows to scaled feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens import fixed_values as fixed
from trafficlens.functions.rules import capped
from trafficlens.operators.ranking import count_by

LABEL_TEXT = "anomaly_type"
LABEL = "label"
RAW_FEATURES = "raw_features"
FEATURES = "features"


def model_frame(
    windows: DataFrame, features: Sequence[str] = fixed.NUMERIC_FEATURES
) -> DataFrame:
    """The numeric features, label, severity and key of each window.

    Null features become 0 and the error rate is cut at 1.
    """
    frame = windows.select(
        *features, LABEL_TEXT, "severity", "severity_score", "ip", "window_start", "window_end"
    ).fillna(0, subset=list(features))
    if "error_rate" in features:
        frame = frame.withColumn("error_rate", capped(F.col("error_rate")))
    return frame


def feature_stages(features: Sequence[str] = fixed.NUMERIC_FEATURES) -> Pipeline:
    """Label index, vector assembly and z-score, to be fitted on the training rows.

    The label is computed from these same features by the window rules, so scores
    of models trained on all of them say how well the rules are re-derived; pass a
    subset to leave the rule inputs out.
    """
    index = StringIndexer(
        inputCol=LABEL_TEXT,
        outputCol=LABEL,
        handleInvalid="keep",
        stringOrderType="frequencyDesc",
    )
    assemble = VectorAssembler(
        inputCols=list(features), outputCol=RAW_FEATURES, handleInvalid="error"
    )
    scale = StandardScaler(
        inputCol=RAW_FEATURES, outputCol=FEATURES, withMean=True, withStd=True
    )
    return Pipeline(stages=[index, assemble, scale])


def feature_stats(
    frame: DataFrame, features: Sequence[str] = fixed.NUMERIC_FEATURES
) -> DataFrame:
    """(feature, mean, sample standard deviation), all features in one pass."""
    stats = [
        F.struct(
            F.lit(name).alias("feature"),
            F.avg(F.col(name).cast("double")).alias("mean"),
            F.stddev_samp(F.col(name).cast("double")).alias("std"),
        )
        for name in features
    ]
    return frame.agg(F.array(*stats).alias("rows")).select(F.inline("rows"))


def label_ranks(frame: DataFrame, column: str = LABEL_TEXT) -> DataFrame:
    """(label text, index): most frequent first, equal counts alphabetically.

    The ordering window runs over one row per label.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("count"), F.asc(column))
    return count_by(frame, column).select(
        column, "count", (F.row_number().over(order) - 1).alias("label_index")
    )


def label_table(stages_model, spark) -> DataFrame:
    """(label_index, anomaly_type) as learned by the fitted label index."""
    names = stages_model.stages[0].labels
    return spark.createDataFrame(
        list(enumerate(names)), f"label_index int, {LABEL_TEXT} string"
    )
