"""Model training on client windows: hold-out selection, evaluation, saving."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from itertools import product
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens import fixed_values as fixed
from trafficlens.operators import knn, metrics
from trafficlens.operators.features import (
    FEATURES,
    LABEL,
    LABEL_TEXT,
    feature_stages,
    model_frame,
)
from trafficlens.operators.split import window_split
from trafficlens.sources.workspace import scratch_path

Params = dict[str, Any]


@dataclass
class Selection:
    """Outcome of a hold-out search: the winner and the score of every candidate."""

    model: Any
    params: Params
    score: float
    tried: list[tuple[Params, float, Any]] = field(default_factory=list)

    def table(self, spark: SparkSession, extra: Callable[[Any], Params] | None = None) -> DataFrame:
        """One row per candidate: its parameters, score and whether it won."""
        rows = [
            {**params, **(extra(model) if extra else {}), "score": score}
            | {"chosen": params == self.params}
            for params, score, model in self.tried
        ]
        return spark.createDataFrame(rows)


def grid(**choices: Sequence[Any]) -> list[Params]:
    """All combinations, the first name varying slowest."""
    return [dict(zip(choices, values, strict=True)) for values in product(*choices.values())]


def select_best(
    candidates: Sequence[Params],
    fit: Callable[[Params], Any],
    score: Callable[[Any], float],
    parallelism: int = 1,
) -> Selection:
    """Fit every candidate and keep the best score; the earliest wins a tie.

    ``parallelism`` fits that many at a time, so that small fits share the cluster.
    """
    spark = SparkSession.getActiveSession()

    def run(params: Params) -> tuple[Params, float, Any]:
        model = fit(params)
        return params, score(model), model

    if parallelism > 1:
        with ThreadPoolExecutor(parallelism) as pool:
            tried = list(pool.map(inheritable_thread_target(spark)(run), candidates))
    else:
        tried = [run(params) for params in candidates]
    params, best, model = max(tried, key=lambda outcome: outcome[1])
    return Selection(model, params, best, tried)


def _f1_on(validation: DataFrame) -> Callable[[Any], float]:
    judge = MulticlassClassificationEvaluator(
        labelCol=LABEL, predictionCol="prediction", metricName="f1"
    )
    return lambda model: judge.evaluate(model.transform(validation))


def train_logistic(
    train: DataFrame,
    validation: DataFrame,
    candidates: Sequence[Params] | None = None,
    max_iter: int = fixed.LR_MAX_ITER,
    parallelism: int = 1,
) -> Selection:
    """Multinomial logistic regression, best of the grid by validation F1.

    For one fixed setting pass a single candidate.
    """
    base = LogisticRegression(
        featuresCol=FEATURES,
        labelCol=LABEL,
        family="multinomial",
        standardization=False,
        maxIter=max_iter,
    )
    if candidates is None:
        candidates = grid(regParam=fixed.LR_REG_PARAMS, elasticNetParam=fixed.LR_ELASTIC_NET)
    return select_best(
        candidates,
        lambda params: base.copy().setParams(**params).fit(train),
        _f1_on(validation),
        parallelism,
    )


def train_forest(
    train: DataFrame,
    validation: DataFrame,
    candidates: Sequence[Params] | None = None,
    seed: int = fixed.SEED,
    parallelism: int = 1,
) -> Selection:
    base = RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, seed=seed)
    if candidates is None:
        candidates = grid(numTrees=fixed.FOREST_TREES, maxDepth=fixed.FOREST_DEPTHS)
    return select_best(
        candidates,
        lambda params: base.copy().setParams(**params).fit(train),
        _f1_on(validation),
        parallelism,
    )


def train_kmeans(
    train: DataFrame,
    validation: DataFrame,
    ks: Sequence[int] = fixed.KMEANS_K,
    max_iter: int = fixed.KMEANS_MAX_ITER,
    seed: int = fixed.SEED,
    parallelism: int = 1,
) -> Selection:
    """k-means for each k, best by validation silhouette."""
    base = KMeans(
        featuresCol=FEATURES,
        predictionCol="prediction",
        initMode="k-means||",
        maxIter=max_iter,
        seed=seed,
    )
    return select_best(
        grid(k=ks),
        lambda params: base.copy().setParams(**params).fit(train),
        lambda model: metrics.silhouette(model.transform(validation), FEATURES),
        parallelism,
    )


def before_last_update(sweep: Selection, train: DataFrame, parallelism: int = 1) -> dict[int, Any]:
    """For each fitted k the model whose centres the fit's ``trainingCost`` belongs to.

    Spark keeps the centres after the last update only, so the same fit runs again with one
    iteration less.
    """

    def again(model):
        fit = KMeans(
            featuresCol=model.getFeaturesCol(),
            predictionCol=model.getPredictionCol(),
            k=model.getK(),
            initMode=model.getInitMode(),
            initSteps=model.getInitSteps(),
            tol=model.getTol(),
            seed=model.getSeed(),
            maxIter=model.summary.numIter - 1,
        )
        return model.getK(), fit.fit(train)

    with ThreadPoolExecutor(parallelism) as pool:
        spark = train.sparkSession
        return dict(pool.map(inheritable_thread_target(spark)(again), [model for _, _, model in sweep.tried]))


def squared_distance_sums(sweep: Selection, rows: DataFrame) -> dict[int, float]:
    """For each fitted k the squared distances of ``rows`` to the nearest centre, summed.

    One pass over the rows for all k. The fit's own ``trainingCost`` belongs to the centres
    before the last update, so it is greater when a fit stops at its iteration limit.
    """
    x = vector_to_array(F.col(FEATURES))

    def squared(centre):
        differences = F.zip_with(x, F.array(*[F.lit(float(v)) for v in centre]), lambda a, b: a - b)
        return F.aggregate(differences, F.lit(0.0), lambda total, v: total + v * v)

    sums = [
        F.sum(F.array_min(F.array(*map(squared, model.clusterCenters())))).alias(str(params["k"]))
        for params, _, model in sweep.tried
    ]
    found = rows.agg(*sums).first()
    return {params["k"]: found[str(params["k"])] or 0.0 for params, _, _ in sweep.tried}


def kmeans_scores(sweep: Selection, train: DataFrame) -> DataFrame:
    """(k, silhouette, wssse) per fitted k; the error is that of the returned centres on ``train``."""
    errors = squared_distance_sums(sweep, train)
    rows = [(params["k"], score, errors[params["k"]]) for params, score, _ in sweep.tried]
    return train.sparkSession.createDataFrame(rows, "k int, silhouette double, wssse double")


def _knn_votes(train: DataFrame, asked: DataFrame, ks: Sequence[int], id_column: str, *kept: str) -> DataFrame:
    """(k, kept columns, label, prediction) of every asked row for every k, from one search."""

    def flat(df, *more):
        return df.select(id_column, *more, LABEL, vector_to_array(FEATURES).alias(FEATURES))

    voted = knn.classify(flat(train), flat(asked, *kept), ks, id_column=id_column, label=LABEL)
    votes = [
        F.struct(F.lit(k).alias("k"), F.col(f"prediction_{k}").alias("prediction")) for k in ks
    ]
    return voted.select(*kept, LABEL, F.inline(F.array(*votes)))


def _best_k(counts: DataFrame, ks: Sequence[int]) -> Selection:
    by_k = {row["k"]: row["f1"] for row in metrics.weighted_metrics(counts, "k").collect()}
    tried = [({"k": k}, by_k.get(k, 0.0), k) for k in ks]
    params, best, k = max(tried, key=lambda outcome: outcome[1])
    return Selection(k, params, best, tried)


def select_knn(
    train: DataFrame,
    validation: DataFrame,
    ks: Sequence[int] = fixed.KNN_GRID,
    id_column: str = "id",
) -> Selection:
    """Best k by validation F1; one neighbour search serves the whole grid.

    The chosen "model" is k itself: use it with ``knn.classify``.
    """
    counts = _knn_votes(train, validation, ks, id_column).groupBy("k", LABEL, "prediction")
    return _best_k(counts.agg(F.count("*").alias("count")), ks)


def knn_candidate(
    train: DataFrame, validation: DataFrame, test: DataFrame, ks: Sequence[int] = fixed.KNN_GRID
) -> tuple[Selection, DataFrame]:
    """k chosen on the validation windows and its confusion counts on the test windows.

    Both splits are searched together. Windows are told apart by client and start.
    """
    own = F.xxhash64("ip", "window_start").alias("id")
    asked = validation.unionByName(test).select("*", own)
    votes = _knn_votes(train.select("*", own), asked, ks, "id", "split")
    counts = votes.groupBy("k", "split", LABEL, "prediction").agg(F.count("*").alias("count"))
    counts = train.sparkSession.createDataFrame(counts.collect(), counts.schema)
    chosen = _best_k(counts.filter("split = 'validation'").drop("split"), ks)
    return chosen, counts.filter((F.col("split") == "test") & (F.col("k") == chosen.model)).drop("split", "k")


@dataclass
class Trained:
    stages: PipelineModel
    logistic: Selection
    forest: Selection
    kmeans: Selection
    neighbours: Selection | None
    label_names: list[str]
    metrics: DataFrame
    kmeans_scores: DataFrame
    baseline: DataFrame
    confusion: DataFrame
    classes: DataFrame
    composition: DataFrame


def prepare(windows: DataFrame, features: Sequence[str] = fixed.NUMERIC_FEATURES):
    """(fitted feature stages, frame with vectors, label and split), fitted on train only.

    Give it windows that are stored: fitting and transforming read them three times.
    """
    frame = window_split(model_frame(windows, features))
    stages = feature_stages(features).fit(frame.filter(F.col("split") == "train"))
    scaled = stages.transform(frame)
    return stages, scaled.select(
        "ip", "window_start", "split", LABEL_TEXT, LABEL, FEATURES
    )


def part(frame: DataFrame, split: str) -> DataFrame:
    return frame.filter(F.col("split") == split)


def supervised_metrics(name: str, counts: DataFrame) -> DataFrame:
    """The summary row of a classifier from its confusion counts."""
    scores = metrics.weighted_metrics(counts)
    nothing = F.lit(None).cast("double")
    return scores.select(
        F.lit(name).alias("model"),
        "accuracy",
        "f1",
        "precision",
        "recall",
        nothing.alias("silhouette"),
        nothing.alias("purity"),
    )


def cluster_metrics(name: str, model: Any, test: DataFrame) -> DataFrame:
    grouped = model.transform(test)
    nothing = F.lit(None).cast("double")
    return metrics.purity(metrics.cluster_composition(grouped)).select(
        F.lit(name).alias("model"),
        nothing.alias("accuracy"),
        nothing.alias("f1"),
        nothing.alias("precision"),
        nothing.alias("recall"),
        F.lit(metrics.silhouette(grouped)).alias("silhouette"),
        "purity",
    )


def run_training(
    windows: DataFrame,
    save_to: str | None = None,
    features: Sequence[str] = fixed.NUMERIC_FEATURES,
    logistic_grid: Sequence[Params] | None = None,
    forest_grid: Sequence[Params] | None = None,
    ks: Sequence[int] = fixed.KMEANS_K,
    parallelism: int = 1,
    knn_ks: Sequence[int] = fixed.KNN_GRID,
) -> Trained:
    """Fit, select, evaluate and, with ``save_to``, save all models.

    Nearest neighbours are a candidate like the others, unless ``knn_ks`` is empty; there is
    nothing of them to save, their model is k and the training rows.

    The scaled frame is written once, one folder for each split: the hundreds of small
    jobs of an iterative fit start from the files of their split instead of carrying the
    plan of the windows, and so does the recovery of a lost executor.
    """
    spark = windows.sparkSession
    stages, scaled = prepare(windows, features)
    path = scratch_path(spark, "scaled-windows")
    scaled.write.partitionBy("split").parquet(path)
    scaled = spark.read.schema(scaled.schema).parquet(path)
    train, validation, test = (part(scaled, s) for s in ("train", "validation", "test"))
    logistic = train_logistic(train, validation, logistic_grid, parallelism=parallelism)
    forest = train_forest(train, validation, forest_grid, parallelism=parallelism)
    kmeans = train_kmeans(train, validation, ks, parallelism=parallelism)
    cluster_name = f"K-Means (k={kmeans.params['k']})"
    named = {
        "Logistic Regression": metrics.confusion(logistic.model.transform(test)),
        "Random Forest": metrics.confusion(forest.model.transform(test)),
    }
    neighbours = None
    if knn_ks:
        neighbours, counts = knn_candidate(train, validation, test, knn_ks)
        named[f"Nearest Neighbours (k={neighbours.model})"] = counts.select(LABEL, "prediction", "count")
    # a handful of rows each: kept as values, so that looking at them scores nothing again
    named = {name: spark.createDataFrame(df.collect(), df.schema) for name, df in named.items()}
    summaries = [supervised_metrics(name, counts) for name, counts in named.items()]
    summary = reduce(DataFrame.unionByName, [*summaries, cluster_metrics(cluster_name, kmeans.model, test)])
    confusion = reduce(
        DataFrame.unionByName, [counts.withColumn("model", F.lit(name)) for name, counts in named.items()]
    )
    summary, composition, baseline = (
        spark.createDataFrame(df.collect(), df.schema)
        for df in (
            summary,
            metrics.cluster_composition(kmeans.model.transform(test)),
            metrics.baseline_metrics(test),
        )
    )
    trained = Trained(
        stages=stages,
        logistic=logistic,
        forest=forest,
        kmeans=kmeans,
        neighbours=neighbours,
        label_names=list(stages.stages[0].labels),
        metrics=summary,
        kmeans_scores=kmeans_scores(kmeans, train),
        baseline=baseline,
        confusion=confusion,
        classes=metrics.class_metrics(confusion, "model"),
        composition=composition,
    )
    if save_to is not None:
        save_models(trained, save_to)
    return trained


def save_models(trained: Trained, folder: str) -> dict[str, str]:
    """Write the four models below ``folder``, replacing earlier ones."""
    named = {
        "feature_stages": trained.stages,
        "logistic_regression": trained.logistic.model,
        "random_forest": trained.forest.model,
        "kmeans": trained.kmeans.model,
    }
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in named}
    for name, model in named.items():
        model.write().overwrite().save(paths[name])
    return paths
