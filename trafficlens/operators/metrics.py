"""Model quality from (label, prediction) counts.

One aggregation over the predictions gives the confusion counts; every other
figure is arithmetic on those few rows.
"""

from __future__ import annotations

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ratio(part, whole):
    return F.when(whole > 0, part / whole).otherwise(0.0)


def confusion(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    return predictions.groupBy(
        F.col(label).alias("label"), F.col(prediction).alias("prediction")
    ).agg(F.count("*").alias("count"))


def class_metrics(counts: DataFrame, *groups: str) -> DataFrame:
    """TP, FP, FN, precision, recall and F1 of every class seen as label or prediction.

    ``groups`` are further columns of ``counts`` that tell models apart.
    """
    n, hit = F.col("count"), F.col("label") == F.col("prediction")
    none = F.lit(0).cast("bigint")

    def part(cls, tp, fp, fn):
        return F.struct(cls.alias("class"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))

    as_label = part(F.col("label"), F.when(hit, n).otherwise(0), none, F.when(hit, 0).otherwise(n))
    as_prediction = part(F.col("prediction"), none, F.when(hit, 0).otherwise(n), none)
    tallies = (
        counts.select(*groups, F.inline(F.array(as_label, as_prediction)))
        .groupBy(*groups, "class")
        .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rated = tallies.select(
        "*", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall")
    )
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", _ratio(2 * p * r, p + r))


def weighted_metrics(counts: DataFrame, *groups: str) -> DataFrame:
    """Accuracy, and F1, precision and recall weighted by class size; one row per group."""
    support = F.col("tp") + F.col("fn")
    total = F.sum(support)

    def weighted(name):
        return F.try_divide(F.sum(support * F.col(name)), total)

    return class_metrics(counts, *groups).groupBy(*groups).agg(
        F.try_divide(F.sum("tp").cast("double"), total).alias("accuracy"),
        weighted("f1").alias("f1"),
        weighted("precision").alias("precision"),
        weighted("recall").alias("recall"),
    )


def baseline_metrics(labelled: DataFrame, label: str = "label") -> DataFrame:
    """The rules judged against their own labels: 1 everywhere, a sanity check."""
    return weighted_metrics(confusion(labelled, label, label))


def cluster_composition(
    predictions: DataFrame, cluster: str = "prediction", label: str = "anomaly_type"
) -> DataFrame:
    return predictions.groupBy(
        F.col(cluster).alias("cluster"), F.col(label).alias("label")
    ).agg(F.count("*").alias("count"))


def purity(composition: DataFrame) -> DataFrame:
    """Share of rows that carry their cluster's most common label; one row."""
    return (
        composition.groupBy("cluster")
        .agg(F.max("count").alias("majority"), F.sum("count").alias("size"))
        .agg(F.try_divide(F.sum("majority").cast("double"), F.sum("size")).alias("purity"))
    )


def silhouette(
    predictions: DataFrame, features: str = "features", prediction: str = "prediction"
) -> float:
    """Mean silhouette with squared Euclidean distance. Runs a job."""
    return ClusteringEvaluator(
        featuresCol=features,
        predictionCol=prediction,
        metricName="silhouette",
        distanceMeasure="squaredEuclidean",
    ).evaluate(predictions)
