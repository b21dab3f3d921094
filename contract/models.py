"""Queries for features, models, selection and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    LogisticRegressionModel,
    RandomForestClassificationModel,
)
from pyspark.ml.clustering import KMeansModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contract import tables
from contract.registry import query
from contract.sql import FEATURES, rounded
from trafficlens import fixed_values as fixed
from trafficlens.operators import features as ft
from trafficlens.operators import knn, metrics, split
from trafficlens.plans import training
from trafficlens.sources.sinks import cut
from trafficlens.sources.workspace import scratch_path

_ROUNDED = ", ".join(
    f"round({c}, 6) AS {c}" if c in ("avg_bytes", "error_rate") else c for c in FEATURES
)


def _frame(spark, d):
    return ft.model_frame(tables.windows(spark, d))


def _unpacked(df, vector, *others):
    values = vector_to_array(vector)
    return df.select(*others, *[values[i].alias(c) for i, c in enumerate(FEATURES)])


# -- features -----------------------------------------------------------------------


@query(
    "c15_feature_projection",
    f"""SELECT {_ROUNDED}, anomaly_type, severity, round(severity_score, 6) AS severity_score,
      ip, window_start, window_end FROM frame""",
)
def feature_projection(spark, d):
    return _frame(spark, d)


@query(
    "c16_null_fill",
    """SELECT event_id, coalesce(value, 0) AS value, coalesce(known, 0) AS known FROM
      (SELECT event_id, round(value, 6) AS value,
        CASE WHEN event_type <> 'error' THEN user_id END AS known FROM events)""",
)
def null_fill(spark, d):
    known = F.when(F.col("event_type") != "error", F.col("user_id")).alias("known")
    columns = tables.events(spark, d).select("event_id", "value", known)
    return columns.fillna(0, subset=["value", "known"])


@query(
    "c17_rate_cap",
    """SELECT event_id, round(CASE WHEN value / 50 > 1 THEN 1 ELSE value / 50 END, 6) AS rate
      FROM events""",
)
def rate_cap(spark, d):
    rate = ft.capped(F.col("value") / 50)
    return tables.events(spark, d).select("event_id", rate.alias("rate"))


_STATS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS std FROM {{0}}"
    for c in FEATURES
)


@query(
    "e09_feature_stats",
    f"SELECT feature, {rounded('mean', 'std')} FROM ({_STATS.format('frame')})",
)
def feature_stats(spark, d):
    return ft.feature_stats(_frame(spark, d))


_RANKED = """SELECT anomaly_type, count(*) AS "count",
  CAST(row_number() OVER (ORDER BY count(*) DESC, anomaly_type) - 1 AS INTEGER) AS label_index
  FROM {0} GROUP BY anomaly_type"""


@query("i01_label_ranks", _RANKED.format("frame"))
def label_ranks(spark, d):
    return ft.label_ranks(_frame(spark, d))


@query(
    "i01_label_index",
    f"""SELECT anomaly_type, label_index::DOUBLE AS label, "count" AS n
      FROM ({_RANKED.format("frame")})""",
)
def label_index(spark, d):
    frame = _frame(spark, d).select("anomaly_type")
    indexer = StringIndexer(inputCol="anomaly_type", outputCol="label", handleInvalid="keep")
    labelled = indexer.fit(frame).transform(frame)
    return labelled.groupBy("anomaly_type", "label").agg(F.count("*").alias("n"))


@query(
    "i02_vector_assembly",
    "SELECT ip, window_start, "
    + ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in FEATURES)
    + " FROM frame",
)
def vector_assembly(spark, d):
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="vector", handleInvalid="skip")
    return _unpacked(assemble.transform(_frame(spark, d)), "vector", "ip", "window_start")


_SCALED = ", ".join(
    f"round(CASE WHEN s.{c}_std > 0 THEN (f.{c} - s.{c}_mean) / s.{c}_std ELSE 0 END, 6) AS {c}"
    for c in FEATURES
)
_MOMENTS = ", ".join(f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std" for c in FEATURES)


@query(
    "i03_z_scores",
    f"""SELECT ip, window_start, {_SCALED} FROM frame f,
      (SELECT {_MOMENTS} FROM frame) s""",
)
def z_scores(spark, d):
    """Scaled by the moments of the whole frame."""
    frame = _frame(spark, d)
    fitted = ft.feature_stages().fit(frame)
    return _unpacked(fitted.transform(frame), "features", "ip", "window_start")


@query(
    "i04_feature_stages",
    f"""SELECT f.split, f.ip, f.window_start, r.label_index::DOUBLE AS label, {_SCALED}
      FROM split_frame f JOIN ({_RANKED.format("split_frame WHERE split = 'train'")}) r
        USING (anomaly_type),
      (SELECT {_MOMENTS} FROM split_frame WHERE split = 'train') s""",
)
def feature_stages(spark, d):
    """Fitted on the training rows, applied to all three splits."""
    _, scaled = training.prepare(_stored_windows(spark, d))
    return _unpacked(scaled, "features", "split", "ip", "window_start", "label")


@query("i05_hash_split", "SELECT ip, window_start, split FROM split_frame")
def hash_split(spark, d):
    return split.window_split(_frame(spark, d)).select("ip", "window_start", "split")


@query(
    "i05_random_split_total",
    "SELECT count(*) AS n FROM frame",
)
def random_split(spark, d):
    """Sizes depend on the layout; together the three parts are the whole frame."""
    train, validation, test = split.random_split(_frame(spark, d))
    return train.unionByName(validation).unionByName(test).agg(F.count("*").alias("n"))


@query(
    "i06_label_mapping",
    f"""SELECT label_index, anomaly_type
      FROM ({_RANKED.format("split_frame WHERE split = 'train'")})""",
)
def label_mapping(spark, d):
    stages, _ = training.prepare(_stored_windows(spark, d))
    return ft.label_table(stages, spark)


# -- models -------------------------------------------------------------------------


def _stored_windows(spark, d):
    return cut(tables.windows(spark, d), scratch_path(spark, "windows"))


def _splits(spark, d):
    """Scaled splits, written once because the fits read them many times."""
    _, scaled = training.prepare(_stored_windows(spark, d))
    scaled = cut(scaled, scratch_path(spark, "scaled"))
    return [training.part(scaled, s) for s in ("train", "validation", "test")]


_SUPPORTS = """SELECT anomaly_type, count(*) AS support FROM split_frame
  WHERE split = 'test' AND anomaly_type IN (SELECT anomaly_type FROM split_frame WHERE split = 'train')
  GROUP BY anomaly_type"""


@query(
    "i07_logistic_fixed",
    f"""SELECT anomaly_type, support, true AS in_range, true AS beats_majority FROM ({_SUPPORTS})""",
)
def logistic_fixed(spark, d):
    """Test windows of each class, whether its scores are possible, and whether the model is
    right more often than the most common class would be."""
    stages, scaled = training.prepare(_stored_windows(spark, d))
    scaled = cut(scaled, scratch_path(spark, "scaled"))
    train, validation, test = (training.part(scaled, s) for s in ("train", "validation", "test"))
    fixed_point = [{"regParam": 0.01, "elasticNetParam": 0.0}]
    model = training.train_logistic(train, validation, fixed_point).model
    classes = metrics.class_metrics(metrics.confusion(model.transform(test)))
    support = (F.col("tp") + F.col("fn")).alias("support")
    every = Window.partitionBy()
    rated = classes.select(
        F.col("class").alias("label_index"),
        support,
        (F.least("precision", "recall", "f1") >= 0) & (F.greatest("precision", "recall", "f1") <= 1),
        F.sum("tp").over(every) >= F.max(support).over(every),
    ).toDF("label_index", "support", "in_range", "beats_majority")
    return rated.join(ft.label_table(stages, spark), "label_index").filter("support > 0").select(
        "anomaly_type", "support", "in_range", "beats_majority"
    )


def _consistent(selection, spark):
    """Parameters of every candidate, and whether exactly the first of the best was chosen."""
    best = max(score for _, score, _ in selection.tried)
    first = next(params for params, score, _ in selection.tried if score == best)
    rows = [
        {**params, "possible": -1.0 <= score <= 1.0, "as_scored": (params == selection.params) == (params == first)}
        for params, score, _ in selection.tried
    ]
    return spark.createDataFrame(rows)


@query(
    "i08_logistic_grid",
    """SELECT unnest([0.001, 0.001, 0.01, 0.01, 0.1, 0.1])::DOUBLE AS "regParam",
      unnest([0.0, 0.5, 0.0, 0.5, 0.0, 0.5])::DOUBLE AS "elasticNetParam", true AS possible, true AS as_scored""",
)
def logistic_grid(spark, d):
    train, validation, _ = _splits(spark, d)
    return _consistent(training.train_logistic(train, validation, parallelism=4), spark)


_FOREST_GRID = """unnest([50, 50, 100, 100])::BIGINT AS "numTrees", unnest([5, 10, 5, 10])::BIGINT AS "maxDepth\""""


@query("i09_forest_grid", f"SELECT {_FOREST_GRID}, true AS possible, true AS as_scored")
def forest_grid(spark, d):
    train, validation, _ = _splits(spark, d)
    return _consistent(training.train_forest(train, validation, parallelism=4), spark)


@query("i10_knn", "SELECT vec_id, label, prediction AS prediction_5 FROM knn")
def knn_others(spark, d):
    """Every vector classified by its five nearest others."""
    return _voted(spark, d).select("vec_id", "label", "prediction_5")


def _voted(spark, d):
    points = tables.embeddings(spark, d)
    return knn.classify_others(
        points, ks=(fixed.KNN_K,), id_column="vec_id", features="embedding", label="label"
    )


@query(
    "i10_knn_approximate",
    """SELECT (SELECT count(*) FROM embeddings) AS searched, true AS reported, true AS reached,
      true AS cells_left_out""",
)
def knn_approximate(spark, d):
    """An approximate search set to 95 % against the exact one over the whole table."""
    points = tables.embeddings(spark, d)
    names = {"id_column": "vec_id", "features": "embedding", "label": "label"}
    exact = knn.nearest_vectors(points, points, fixed.KNN_K, **names)
    found, how = knn.nearest_with_report(points, points, fixed.KNN_K, recall=0.95, **names)
    ids = F.transform("neighbours", lambda n: n["id"])
    both = exact.select("features", ids.alias("all")).join(found.select("features", ids.alias("some")), "features")
    hits, all_ = F.sum(F.size(F.array_intersect("all", "some"))), F.sum(F.size("all"))
    return both.agg(F.count("*").alias("searched"), (hits >= 0.9 * all_).alias("reached")).select(
        "searched",
        F.lit(how.recall >= 0.95).alias("reported"),
        "reached",
        F.lit(how.probes < how.cells).alias("cells_left_out"),
    )


@query("i10_knn_grid", "SELECT unnest([3, 5, 11])::BIGINT AS k, true AS possible, true AS as_scored")
def knn_grid(spark, d):
    """k chosen on the validation windows."""
    key = F.xxhash64("ip", "window_start").alias("id")
    train, validation, _ = _splits(spark, d)
    return _consistent(training.select_knn(train.select("*", key), validation.select("*", key)), spark)


@query(
    "i11_holdout_selection",
    f"""SELECT {_FOREST_GRID}, n AS rows, true AS same_score FROM
      (SELECT count(*) AS n FROM split_frame WHERE split = 'validation')""",
)
def holdout_selection(spark, d):
    """Every candidate's hold-out score against the same score from our own counts."""
    train, validation, _ = _splits(spark, d)
    chosen = training.train_forest(train, validation, parallelism=4)
    counts = [
        metrics.confusion(model.transform(validation)).withColumn("candidate", F.lit(i))
        for i, (_, _, model) in enumerate(chosen.tried)
    ]
    counts = reduce(DataFrame.unionByName, counts)
    scored = metrics.weighted_metrics(counts, "candidate").join(
        counts.groupBy("candidate").agg(F.sum("count").alias("rows")), "candidate"
    )
    given = [{**params, "candidate": i, "score": score} for i, (params, score, _) in enumerate(chosen.tried)]
    return scored.join(spark.createDataFrame(given), "candidate").select(
        "numTrees", "maxDepth", "rows", (F.abs(F.col("f1") - F.col("score")) < 1e-9).alias("same_score")
    )


@query(
    "i12_kmeans_sweep",
    """SELECT unnest([3, 4, 5, 6, 7, 8])::BIGINT AS k, n AS rows, true AS possible, true AS as_scored
      FROM (SELECT count(*) AS n FROM split_frame WHERE split = 'validation')""",
)
def kmeans_sweep(spark, d):
    """Validation windows that each k puts into one of its clusters, and how k was chosen."""
    train, validation, _ = _splits(spark, d)
    sweep = training.train_kmeans(train, validation, parallelism=4)
    placed = [
        model.transform(validation).agg(
            F.lit(params["k"]).cast("long").alias("k"), F.count_if(F.col("prediction") < params["k"]).alias("rows")
        )
        for params, _, model in sweep.tried
    ]
    return reduce(DataFrame.unionByName, placed).join(_consistent(sweep, spark), "k")


@query(
    "i13_wssse",
    """SELECT unnest([3, 4, 5, 6, 7, 8])::INTEGER AS k, n AS rows, true AS same_cost, true AS not_above,
      true AS near_if_settled
      FROM (SELECT count(*) AS n FROM split_frame WHERE split = 'train')""",
)
def wssse(spark, d):
    """For each k the training cost against the squared distances to the centres it belongs to, and
    the error of the returned centres against that cost.

    Spark reports the cost of the centres before the last update; for these it has to be the same.
    An update never makes the sum of squares greater. When the fit settled, no centre moved
    by more than the tolerance t, so no distance changed by more: the sums differ by at
    most 2 t sqrt(rows * cost) + rows * t * t.
    """
    train, validation, _ = _splits(spark, d)
    sweep = training.train_kmeans(train, validation, parallelism=4)
    before = training.before_last_update(sweep, train, parallelism=4)
    errors, rows = training.squared_distance_sums(sweep, train), train.count()
    compared = []
    for params, _, model in sweep.tried:
        k, cost, moved = params["k"], model.summary.trainingCost, model.getTol()
        settled = model.summary.numIter < model.getMaxIter()
        allowed = 2 * moved * (rows * cost) ** 0.5 + rows * moved**2
        compared.append(
            _recomputed(train, k, before[k], cost).select(
                "*",
                F.lit(errors[k] <= cost * (1 + 1e-9)).alias("not_above"),
                F.lit(not settled or cost - errors[k] <= allowed + 1e-9 * cost).alias("near_if_settled"),
            )
        )
    return reduce(DataFrame.unionByName, compared)


def _recomputed(train, k, model, cost):
    x = vector_to_array("features")
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    centre = F.element_at(centres, F.col("prediction") + 1)
    squares = F.transform(F.zip_with(x, centre, lambda a, b: a - b), lambda v: v * v)
    distance = F.aggregate(squares, F.lit(0.0), lambda total, v: total + v)
    found = model.transform(train).agg(F.count("*").alias("rows"), F.sum(distance).alias("recomputed"))
    return found.select(
        F.lit(k).alias("k"),
        "rows",
        (F.abs(F.col("recomputed") - cost) <= 1e-9 * F.lit(cost)).alias("same_cost"),
    )


@query(
    "i14_saved_models",
    """SELECT unnest(['logistic_regression', 'random_forest', 'kmeans']) AS model,
      n AS rows, 0::BIGINT AS different FROM (SELECT count(*) AS n FROM frame)""",
)
def saved_models(spark, d):
    """Predictions of the reloaded models against the ones in memory."""
    windows = _stored_windows(spark, d)
    folder = scratch_path(spark, "models")
    trained = training.run_training(windows, save_to=folder, parallelism=4)
    stages = PipelineModel.load(f"{folder}/feature_stages")
    frame = stages.transform(ft.model_frame(windows))
    loaded = {
        "logistic_regression": (LogisticRegressionModel, trained.logistic.model),
        "random_forest": (RandomForestClassificationModel, trained.forest.model),
        "kmeans": (KMeansModel, trained.kmeans.model),
    }
    compared = []
    for name, (kind, model) in loaded.items():
        again = kind.load(f"{folder}/{name}")
        both = again.transform(
            model.transform(frame).select("features", F.col("prediction").alias("first"))
        )
        compared.append(
            both.agg(
                F.lit(name).alias("model"),
                F.count("*").alias("rows"),
                F.count_if(F.col("first") != F.col("prediction")).alias("different"),
            )
        )
    return compared[0].unionByName(compared[1]).unionByName(compared[2])


_MODELS = "unnest(['Logistic Regression', 'Random Forest', 'Nearest Neighbours', 'K-Means'])"


@query(
    "i15_training",
    f"""SELECT {_MODELS} AS model, unnest([true, true, true, false]) AS supervised, true AS possible""",
)
def train_all(spark, d):
    """One row for each model of the run with the figures of its kind, all between 0 and 1."""
    summary = training.run_training(_stored_windows(spark, d), parallelism=4).metrics
    supervised, clusters = ("accuracy", "f1", "precision", "recall"), ("silhouette", "purity")
    own = F.when(F.col("accuracy").isNotNull(), F.array(*supervised)).otherwise(F.array(*clusters))
    none = F.when(F.col("accuracy").isNotNull(), F.coalesce(*clusters)).otherwise(F.coalesce(*supervised))
    return summary.select(
        F.regexp_replace("model", " [(]k=[0-9]+[)]", "").alias("model"),
        F.col("accuracy").isNotNull().alias("supervised"),
        (F.forall(own, lambda x: x.between(-1, 1)) & none.isNull()).alias("possible"),
    )


@query(
    "i15_tables",
    """SELECT unnest(['confusion', 'class_metrics', 'composition']) AS "table",
      unnest([3 * n, 3 * n, n]) AS rows FROM
      (SELECT count(*) AS n FROM split_frame WHERE split = 'test')""",
)
def training_tables(spark, d):
    """Test rows that each evaluation table of the training run accounts for."""
    trained = training.run_training(_stored_windows(spark, d), parallelism=4)
    counted = {
        "confusion": trained.confusion.agg(F.sum("count").alias("rows")),
        "class_metrics": trained.classes.agg(F.sum(F.col("tp") + F.col("fn")).alias("rows")),
        "composition": trained.composition.agg(F.sum("count").alias("rows")),
    }
    named = [df.select(F.lit(name).alias("table"), "rows") for name, df in counted.items()]
    return reduce(DataFrame.unionByName, named)


# -- evaluation: labels and kNN predictions of the embeddings -----------------------


def _predictions(spark, d):
    return _voted(spark, d).withColumnRenamed("prediction_5", "prediction")


@query(
    "j01_weighted_metrics",
    """SELECT round(sum(tp)::DOUBLE / sum(tp + fn), 6) AS accuracy,
      round(sum((tp + fn) * f1) / sum(tp + fn), 6) AS f1,
      round(sum((tp + fn) * "precision") / sum(tp + fn), 6) AS "precision",
      round(sum((tp + fn) * recall) / sum(tp + fn), 6) AS recall FROM classes""",
)
def weighted_metrics(spark, d):
    return metrics.weighted_metrics(metrics.confusion(_predictions(spark, d)))


@query(
    "j02_class_metrics",
    """SELECT class, tp, fp, fn, round("precision", 6) AS "precision", round(recall, 6) AS recall,
      round(f1, 6) AS f1 FROM classes""",
)
def class_metrics(spark, d):
    return metrics.class_metrics(metrics.confusion(_predictions(spark, d))).orderBy("class")


@query("j03_confusion_matrix", 'SELECT label, prediction, n AS "count" FROM confusion')
def confusion_matrix(spark, d):
    return metrics.confusion(_predictions(spark, d)).orderBy("label", "prediction")


@query(
    "j04_silhouette",
    """, cluster_means AS (SELECT vec_id, label, other_label, avg(distance * distance) AS mean
        FROM pairs GROUP BY ALL),
      sides AS (SELECT vec_id, max(mean) FILTER (other_label = label) AS own,
        min(mean) FILTER (other_label <> label) AS nearest FROM cluster_means GROUP BY vec_id)
      SELECT round(avg(coalesce((nearest - own) / greatest(nearest, own), 0)), 6) AS silhouette
      FROM sides""",
)
def silhouette(spark, d):
    """The labels taken as clusters."""
    points = tables.embeddings(spark, d).select(
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        F.col("label").alias("prediction"),
    )
    score = metrics.silhouette(points)
    return spark.range(1).select(F.lit(score).alias("silhouette"))


@query("j05_cluster_composition",
       'SELECT prediction AS cluster, label, n AS "count" FROM confusion')
def cluster_composition(spark, d):
    composition = metrics.cluster_composition(_predictions(spark, d), label="label")
    return composition.orderBy(F.asc("cluster"), F.desc("count"))


@query(
    "j06_purity",
    """SELECT round(sum(majority)::DOUBLE / sum(size), 6) AS purity FROM
      (SELECT max(n) AS majority, sum(n) AS size FROM confusion GROUP BY prediction)""",
)
def purity(spark, d):
    return metrics.purity(metrics.cluster_composition(_predictions(spark, d), label="label"))


@query(
    "j07_rule_baseline",
    """SELECT 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS f1, 1.0::DOUBLE AS "precision",
      1.0::DOUBLE AS recall FROM windows LIMIT 1""",
)
def rule_baseline(spark, d):
    return metrics.baseline_metrics(tables.windows(spark, d), "anomaly_type")


@query(
    "j08_model_summary",
    """SELECT unnest(['Logistic Regression', 'Random Forest', 'Nearest Neighbours']) AS model, n AS rows,
      true AS same_accuracy, true AS same_recall FROM
      (SELECT count(*) AS n FROM split_frame WHERE split = 'test')""",
)
def model_summary(spark, d):
    """The summary's figures against the confusion table of the same run."""
    trained = training.run_training(_stored_windows(spark, d), parallelism=4)
    right = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0))
    counted = trained.confusion.groupBy("model").agg(F.sum("count").alias("rows"), right.alias("right"))
    share = F.col("right") / F.col("rows")
    return counted.join(trained.metrics, "model").select(
        F.regexp_replace("model", " [(]k=[0-9]+[)]", "").alias("model"),
        "rows",
        (F.abs(F.col("accuracy") - share) < 1e-12).alias("same_accuracy"),
        # weighted by class size, recall is accuracy
        (F.abs(F.col("recall") - share) < 1e-12).alias("same_recall"),
    )


@query(
    "j09_kmeans_scores",
    """SELECT unnest([3, 4, 5, 6, 7, 8])::INTEGER AS k, true AS possible, true AS below_one_cluster""",
)
def kmeans_table(spark, d):
    """Silhouettes are possible, and every k leaves less error than one cluster would."""
    train, validation, _ = _splits(spark, d)
    scores = training.kmeans_scores(training.train_kmeans(train, validation, parallelism=4), train)
    spread = train.select(F.posexplode(vector_to_array("features"))).groupBy("pos").agg(
        (F.var_pop("col") * F.count("*")).alias("own")
    )
    whole = spread.agg(F.sum("own")).first()[0]
    return scores.select(
        "k", F.col("silhouette").between(-1, 1).alias("possible"), (F.col("wssse") < whole).alias("below_one_cluster")
    )
