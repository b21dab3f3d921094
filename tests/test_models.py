"""Features, splits, kNN, training and metrics."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from contract import tables
from trafficlens.operators import features as ft
from trafficlens.operators import knn, metrics, split
from trafficlens.plans import training

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def windows(spark):
    df = tables.windows(spark, SF_DIR).cache()
    yield df
    df.unpersist()


# -- k nearest neighbours -------------------------------------------------------------


def brute_force(train, query, k):
    """Neighbour ids by (distance, id)."""
    order = sorted((float(((np.array(v) - np.array(query)) ** 2).sum()), i) for i, v, _ in train)
    return [i for _, i in order[:k]]


def vectors(rng, kind, n, first_id):
    if kind == "grid":  # many equal distances and equal vectors
        points = rng.integers(0, 4, (n, 2)).astype(float)
    elif kind == "hot":  # a third of all rows are the same vector
        points = rng.normal(size=(n, 3))
        points[: n // 3] = 0.5
    elif kind == "clusters":
        points = rng.normal(size=(n, 3)) + 50 * rng.integers(0, 5, (n, 1))
    else:
        points = rng.normal(size=(n, 8)) * 1000
    return [(first_id + i, p.tolist(), int(l)) for i, (p, l) in
            enumerate(zip(points, rng.integers(0, 3, n)))]


@pytest.mark.parametrize("kind", ["grid", "hot", "clusters", "wide"])
@pytest.mark.parametrize("k", [1, 5])
def test_neighbours_against_brute_force(spark, kind, k):
    rng = np.random.default_rng(k)
    train, query = vectors(rng, kind, 150, 0), vectors(rng, kind, 60, 1000)
    shape = "id long, features array<double>, label int"
    found = knn.nearest_vectors(
        spark.createDataFrame(train, shape), spark.createDataFrame(query, shape), k,
        block_rows=16, max_pivots=9,
    )
    got = {tuple(r.features): [n.id for n in r.neighbours] for r in found.collect()}
    assert got == {tuple(v): brute_force(train, v, k) for _, v, _ in query}


def cells_met(index, asked):
    """(share of all cells that queries visit in both rounds, bins a query is sent to at most)."""
    first = knn._best(knn._met(index, knn.first_visits(index, asked)), index.k)
    visits = knn.first_visits(index, asked).unionByName(knn.second_visits(index, asked, first))
    sent = visits.select("qid", F.size("cells").alias("cells")).collect()
    queries, cells = asked.count(), len(index.cells.pivots)
    return sum(r.cells for r in sent) / queries / cells, max(Counter(r.qid for r in sent).values())


def test_clusters_are_pruned(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(60, 4)) * 100
    points = [(i, (centres[i % 60] + rng.normal(size=4)).tolist(), 0) for i in range(3000)]
    df = spark.createDataFrame(points, "id long, features array<double>, label int")
    index = knn.build_index(df, 5)
    share, _ = cells_met(index, knn._asked(index, df, "features"))
    index.close()
    assert share < 0.1


def test_random_vectors_are_sent_once_to_a_bin(spark):
    rng = np.random.default_rng(1)
    points = [(i, rng.normal(size=32).tolist(), 0) for i in range(600)]
    df = spark.createDataFrame(points, "id long, features array<double>, label int")
    index = knn.build_index(df, 5, block_rows=150)
    _, bins = cells_met(index, knn._asked(index, df, "features"))
    index.close()
    # every cell has to be visited, but in bins of 150 vectors; both rounds may meet a bin
    assert len(index.cells.pivots) > 20 and bins <= 2 * (600 / 150 + 2)


def test_bins_hold_what_they_should():
    rng = np.random.default_rng(2)
    pivots, members = rng.normal(size=(50, 3)), rng.integers(1, 90, 50)
    members[7] = 1000
    first, blocks = knn._laid_out(pivots, members, 100)
    assert blocks[7] == 10 and all(blocks[np.arange(50) != 7] == 1)
    held = Counter()
    for c in range(50):
        for b in range(first[c], first[c] + blocks[c]):
            held[b] += members[c] / blocks[c]
    assert max(held.values()) <= 100 and sorted(held) == list(range(len(held)))


def in_one_bin(train, asked, cell, k, kth=float("inf")):
    """{qid: [(squared, id)]} of one comparison, every query asking for every cell."""
    cells = [sorted(set(cell))] * len(asked)
    queries = {"qid": range(len(asked)), "features": list(asked), "kth": [kth] * len(asked), "cells": cells}
    vectors = {"id": [f"v{i:05}" for i in range(len(train))], "label": [None] * len(train), "features": list(train)}
    typed = pa.table({name: list(column) for name, column in queries.items()}), pa.table(vectors | {"cell": cell})
    found = {}
    for r in knn._best_in_bin(k)((0, 0), *typed).to_pylist():
        found.setdefault(r["qid"], []).append((r["squared"], r["id"]))
    return {qid: sorted(rows) for qid, rows in found.items()}


@pytest.mark.parametrize("tile, pairs", [(7, 1_000_000), (7, 40), (1024, 1_000_000)])
def test_tiles_of_a_bin_against_brute_force(monkeypatch, tile, pairs):
    monkeypatch.setattr(knn, "_TILE", tile)
    monkeypatch.setattr(knn, "_PAIRS_AT_ONCE", pairs)
    rng = np.random.default_rng(4)
    train, asked = (rng.integers(0, 5, (n, 2)).astype(float) for n in (200, 40))  # many equal distances
    cell = rng.integers(0, 9, 200).tolist()
    found = in_one_bin(train, asked, cell, 4)
    for i, q in enumerate(asked):
        all_ = sorted((((v - q) ** 2).sum(), f"v{j:05}") for j, v in enumerate(train))
        assert found[i] == all_[:4]


def test_a_bin_of_many_cells_is_compared_in_bounded_memory():
    rng = np.random.default_rng(6)
    train, asked, cells = rng.normal(size=(4096, 4)), rng.normal(size=(8192, 4)), np.arange(4096) % 128
    queries = pa.table({
        "qid": np.arange(8192), "features": list(asked), "kth": np.full(8192, np.inf),
        "cells": [np.arange(128, dtype="int32")] * 8192,
    })
    vectors = pa.table({
        "id": np.arange(4096), "label": np.zeros(4096, "int32"), "features": list(train), "cell": cells.astype("int32"),
    })
    tracemalloc.start()
    found = knn._best_in_bin(11)((0, 0), queries, vectors)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    # every cell has eleven candidates for each query: 11.5 million rows, of which few may be held at once
    assert found.num_rows == 8192 * 11 and peak < 200e6


def test_second_round_returns_nothing_beyond_the_first(spark):
    rng = np.random.default_rng(8)
    points = [(i, rng.normal(size=16).tolist(), 0) for i in range(500)]
    df = spark.createDataFrame(points, "id long, features array<double>, label int")
    index = knn.build_index(df, 5, block_rows=100)
    asked = knn._asked(index, df, "features")
    first = knn._best(knn._met(index, knn.first_visits(index, asked)), 5).localCheckpoint()
    kth = {r.qid: r.kth for r in first.groupBy("qid").agg(F.max("squared").alias("kth")).collect()}
    second = knn._met(index, knn.second_visits(index, asked, first)).collect()
    index.close()
    assert second and all(r.squared <= kth[r.qid] * (1 + 1e-9) for r in second)


@pytest.mark.parametrize("wanted", [0.5, 0.9, 1.0])
def test_approximate_search_reaches_its_recall(spark, wanted):
    rng = np.random.default_rng(5)
    points = [(i, rng.normal(size=6).tolist(), int(i % 3)) for i in range(900)]
    df = spark.createDataFrame(points, "id long, features array<double>, label int")
    exact = {tuple(r.features): {n.id for n in r.neighbours} for r in knn.nearest_vectors(df, df, 5).collect()}
    found, how = knn.nearest_with_report(df, df, 5, recall=wanted)
    rows = found.collect()
    hits = sum(len(exact[tuple(r.features)] & {n.id for n in r.neighbours}) for r in rows)
    assert len(rows) == 900 and how.recall >= wanted and how.sampled == 256
    assert hits >= (wanted - 0.05) * 5 * 900
    assert wanted == 1.0 or how.probes < 20


def test_recall_is_not_measured_on_pivots(spark, tmp_path, monkeypatch):
    # a pivot lies in the middle of its cell and finds more there than other queries do
    monkeypatch.setattr(knn, "scratch_path", lambda _, name: f"{tmp_path}/{name}")
    rng = np.random.default_rng(17)
    points = [(i, rng.normal(size=16).tolist(), 0) for i in range(2500)]
    df = spark.createDataFrame(points, "id long, features array<double>, label int")
    index = knn.build_index(df, 5)
    asked = knn._asked(index, df, "features")
    how = knn.probes_for(index, asked, 0.8, sample=len(index.cells.pivots))
    found, exact = (knn.search(index, asked, probes).select("qid", "id") for probes in (how.probes, None))
    assert how.sampled == 50 and how.probes < how.cells
    assert found.intersect(exact).count() >= (how.recall - 0.1) * 5 * 2500
    index.close()


def test_search_leaves_only_its_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(knn, "scratch_path", lambda _, name: f"{tmp_path}/{name}")
    df = spark.createDataFrame([(i, [float(i)], 0) for i in range(30)], "id long, features array<double>, label int")
    found = knn.nearest_vectors(df, df, 2)
    assert [p.name for p in tmp_path.iterdir()] == ["neighbours"]
    assert found.count() == 30


def test_fewer_rows_than_neighbours(spark):
    shape = "id long, features array<double>, label string"
    train = spark.createDataFrame([(1, [0.0], "a"), (2, [1.0], "b")], shape)
    asked = spark.createDataFrame([(7, [0.9], "b")], shape)
    assert knn.classify(train, asked, (5,)).first().prediction_5 == "a"  # a tie goes to the smaller
    assert knn.classify(train, asked, (1,)).first().prediction_1 == "b"


def test_others_leave_the_row_itself_out(spark):
    rng = np.random.default_rng(3)
    points = vectors(rng, "hot", 120, 0)
    df = spark.createDataFrame(points, "id long, features array<double>, label int")
    got = {r.id: r.prediction_5 for r in knn.classify_others(df, (3, 5), block_rows=16).collect()}
    labels = {i: l for i, _, l in points}
    for i, v, _ in points:
        near = brute_force([p for p in points if p[0] != i], v, 5)
        votes = Counter(labels[j] for j in near)
        assert got[i] == min(votes, key=lambda l: (-votes[l], l))


# -- features and splits ----------------------------------------------------------------


def test_hash_split_is_whole_disjoint_and_stable(windows):
    parts = split.window_split(windows)
    assert parts.count() == windows.count()
    again = split.window_split(windows.repartition(7))
    key = ["ip", "window_start", "split"]
    assert parts.select(key).exceptAll(again.select(key)).count() == 0
    shares = {r["split"]: r["count"] / windows.count() for r in parts.groupBy("split").count().collect()}
    assert shares["train"] == pytest.approx(0.6, abs=0.1)


def test_random_split_is_whole(windows):
    assert sum(p.count() for p in split.random_split(windows)) == windows.count()


def test_stages(spark, windows):
    frame = ft.model_frame(windows)
    fitted = ft.feature_stages().fit(frame)
    scaled = fitted.transform(frame)
    x = np.array([r[0] for r in scaled.select(vector_to_array("features")).collect()])
    assert np.allclose(x.mean(0), 0)
    spread = x.std(0, ddof=1)
    assert all(np.isclose(s, 1) or s == 0 for s in spread)
    ranks = {r.anomaly_type: r.label_index for r in ft.label_ranks(frame).collect()}
    names = ft.label_table(fitted, spark)
    assert ranks == {r.anomaly_type: r.label_index for r in names.collect()}


def test_null_features_are_filled_and_rate_is_cut(spark, windows):
    odd = windows.limit(1).withColumn("avg_bytes", F.lit(None).cast("double"))
    row = ft.model_frame(odd.withColumn("error_rate", F.lit(1.5))).first()
    assert row.avg_bytes == 0.0 and row.error_rate == 1.0


# -- metrics ----------------------------------------------------------------------------


def test_metrics_against_the_library_evaluator(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b)) for a, b in zip(rng.integers(0, 4, 300), rng.integers(0, 5, 300))]
    df = spark.createDataFrame(rows, "label double, prediction double")
    counts = metrics.confusion(df)
    assert counts.agg(F.sum("count")).first()[0] == 300
    ours = metrics.weighted_metrics(counts).first()
    judge = MulticlassClassificationEvaluator()
    for name, value in (("accuracy", ours.accuracy), ("f1", ours.f1),
                        ("weightedPrecision", ours.precision), ("weightedRecall", ours.recall)):
        assert judge.setMetricName(name).evaluate(df) == pytest.approx(value)
    assert ours.recall == pytest.approx(ours.accuracy)
    per_class = {r["class"]: r for r in metrics.class_metrics(counts).collect()}
    assert per_class[4.0].recall == 0.0 and per_class[4.0].f1 == 0.0
    assert sum(r.tp + r.fn for r in per_class.values()) == 300


def test_purity_and_baseline(spark):
    df = spark.createDataFrame([(0, "a"), (0, "a"), (0, "b"), (1, "b")], "prediction int, anomaly_type string")
    assert metrics.purity(metrics.cluster_composition(df)).first().purity == 0.75
    assert tuple(metrics.baseline_metrics(df, "anomaly_type").first()) == (1.0, 1.0, 1.0, 1.0)


def test_silhouette_of_two_far_clusters(spark):
    df = spark.createDataFrame([([0.0], 0), ([0.1], 0), ([9.0], 1), ([9.1], 1)], "v array<double>, prediction int")
    assert metrics.silhouette(df.withColumn("features", array_to_vector("v"))) > 0.99


# -- training ---------------------------------------------------------------------------


def test_select_best_keeps_the_first_of_equals():
    grid = training.grid(a=[1, 2], b=[3, 4])
    assert grid[:2] == [{"a": 1, "b": 3}, {"a": 1, "b": 4}]
    chosen = training.select_best(grid, lambda p: p, lambda m: float(m["a"]))
    assert chosen.params == {"a": 2, "b": 3} and len(chosen.tried) == 4


@pytest.mark.parametrize("max_iter", [1, 2, 30])
def test_training_cost_is_that_of_the_centres_before(spark, max_iter):
    rng = np.random.default_rng(9)
    points = spark.createDataFrame([(p.tolist(),) for p in rng.normal(size=(300, 3))], "x array<double>")
    train = points.select(array_to_vector("x").alias(ft.FEATURES)).cache()
    sweep = training.train_kmeans(train, train, (3, 5), max_iter=max_iter)
    before = training.before_last_update(sweep, train)
    own = training.Selection(None, {}, 0.0, [({"k": k}, 0.0, model) for k, model in before.items()])
    costs = training.squared_distance_sums(own, train)
    assert set(costs) == {3, 5}
    for params, _, model in sweep.tried:
        assert model.summary.trainingCost == pytest.approx(costs[params["k"]], rel=1e-9)
    train.unpersist()


def test_training_run(spark, windows, tmp_path):
    trained = training.run_training(
        windows,
        save_to=str(tmp_path),
        logistic_grid=training.grid(regParam=[0.01, 0.1]),
        forest_grid=[{"numTrees": 10, "maxDepth": 5}],
        ks=(3, 4),
        parallelism=2,
    )
    rows = {r.model.split()[0]: r for r in trained.metrics.collect()}
    assert set(rows) == {"Logistic", "Random", "Nearest", "K-Means"}
    assert trained.neighbours.model in (3, 5, 11)
    assert 0 <= rows["Logistic"].accuracy <= 1
    assert rows["Random"].recall == pytest.approx(rows["Random"].accuracy)
    assert 1 / len(trained.label_names) <= rows["K-Means"].purity <= 1
    assert {r.k for r in trained.kmeans_scores.collect()} == {3, 4}
    assert trained.baseline.first().f1 == 1.0
    assert {p.name for p in tmp_path.iterdir()} == {
        "feature_stages", "logistic_regression", "random_forest", "kmeans"
    }
