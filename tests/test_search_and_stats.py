"""Search, sampling and statistics against brute force in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoal.operators import assign, evaluate, kernel, sampling, search, stats
from shoal.operators.points import validate


def points(spark, x, labels=None):
    rows = [(i, [float(a) for a in r], int(labels[i]) if labels is not None else 0) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "point_id long, features array<double>, true_label int")


def queries(spark, q):
    return spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(q)], "qid long, q array<double>")


def test_nearest_of_six(spark):
    p = points(spark, [(2, 3), (5, 4), (9, 6), (4, 7), (8, 1), (7, 2)])
    r = search.nearest(p, queries(spark, [(6, 3)]), 2).first()
    assert r["point_id"] in (1, 5) and r["dist"] == pytest.approx(np.sqrt(2))
    assert r["point_id"] == 1  # ties go to the smaller id


def test_bound_is_strict_and_ball_is_not(spark):
    p = points(spark, [(0, 0), (10, 0), (20, 0)])
    assert search.knn(p, queries(spark, [(0, 0)]), 2, 5, bound=20.0).count() == 2
    assert search.ball(p, queries(spark, [(0, 0)]), 2, 20.0).count() == 3


@pytest.mark.parametrize("metric", ["euclidean", "pearson"])
def test_knn_against_brute_force(spark, metric):
    rng = np.random.default_rng(42)
    x, q = rng.uniform(0, 100, (300, 5)), rng.uniform(0, 100, (20, 5))
    got = search.knn(points(spark, x), queries(spark, q), 5, 4, metric).toPandas()
    d = kernel.distances(q, x, metric)
    for i in range(len(q)):
        mine = got[got.qid == i].sort_values("rank")
        assert np.allclose(np.sort(d[i])[:4], mine.dist, atol=1e-10)


def test_grid_ball_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x, q = rng.uniform(-30, 30, (400, 2)), rng.uniform(-30, 30, (60, 2))
    got = {(r["qid"], r["point_id"]) for r in search.ball_by_grid(points(spark, x), queries(spark, q), 4.0).collect()}
    d = kernel.distances(q, x, "euclidean")
    assert got == {(i, j) for i in range(60) for j in range(400) if d[i, j] <= 4.0}


def test_means(spark):
    p = points(spark, [(1, 2), (3, 4), (5, 6)])
    assert stats.centroid(p, 2).first()["mean"] == [3, 4]


def test_medoid_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 6))
    labels = np.arange(60) % 4
    got = {r["true_label"]: r["medoid_id"] for r in stats.pearson_medoids(points(spark, x, labels), 6).collect()}
    for k in range(4):
        own = np.flatnonzero(labels == k)
        assert got[k] == own[kernel.distances(x[own], x[own], "pearson").sum(axis=1).argmin()]


def test_standardize_inverts(spark):
    rng = np.random.default_rng(5)
    x = np.c_[rng.normal(3, 2, 50), np.full(50, 7.0)]
    p = points(spark, x)
    z = stats.standardize(p, 2)
    back = stats.destandardize(z, stats.moments(p, 2)).orderBy("point_id").toPandas()
    assert np.allclose(np.array(back.features.tolist()), x)


def test_sample_keeps_the_nearest(spark):
    x = np.c_[np.arange(20.0), np.zeros(20)]
    got = {r["point_id"] for r in sampling.keep_fraction(points(spark, x), 2, 2, 0.5).collect()}
    assert len(got) == 10 and got == set(range(5, 15))
    assert sampling.keep_fraction(points(spark, x), 2, 2, 1.0).count() == 20


def test_random_sample_does_not_depend_on_layout(spark):
    p = points(spark, np.arange(100.0)[:, None])
    a = {r["point_id"] for r in sampling.random_sample(p, 30, 1).collect()}
    assert a == {r["point_id"] for r in sampling.random_sample(p.repartition(7), 30, 1).collect()} and len(a) == 30


def test_silhouette_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(90, 3))
    p = points(spark, x, rng.integers(0, 4, 90))
    whole = {r["point_id"]: r["s"] for r in evaluate.silhouette_euclidean(p, "true_label").collect()}
    monkeypatch.setattr(evaluate, "BLOCK", 20)
    monkeypatch.setattr(evaluate, "STRIP", 7)
    blocks = {r["point_id"]: r["s"] for r in evaluate.silhouette_euclidean(p, "true_label").collect()}
    assert len(whole) == 90 and whole == pytest.approx(blocks, abs=1e-9)
    one = evaluate.silhouette_euclidean(p.withColumn("true_label", F.lit(1)), "true_label").collect()
    assert len(one) == 90 and all(r["s"] is None for r in one)
    assert evaluate.silhouette_euclidean(p.limit(0), "true_label").count() == 0


@pytest.mark.parametrize("metric", ["euclidean", "pearson"])
def test_silhouette_against_brute_force(spark, metric):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50, 4))
    labels = np.r_[np.zeros(20), np.ones(29), 2].astype(int)
    p = points(spark, x, labels)
    got = evaluate.silhouette_pearson(p, 4, "true_label") if metric == "pearson" else evaluate.silhouette_euclidean(p, "true_label")
    d = kernel.distances(x, x, metric)
    np.fill_diagonal(d, 0)
    for r in got.collect():
        i = r["point_id"]
        own = labels == labels[i]
        if own.sum() == 1:
            assert r["s"] == 0
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == k].mean() for k in set(labels) if k != labels[i])
        assert r["s"] == pytest.approx((b - a) / max(a, b), abs=1e-9)


def test_agreement_of_equal_partitions_is_one(spark):
    t = spark.createDataFrame([(0, 5), (0, 5), (1, 3), (1, 3), (2, 9)], "a int, b int")
    assert evaluate.adjusted_rand(t, "a", "b").first()["ari"] == pytest.approx(1)
    assert evaluate.normalized_mutual_information(t, "a", "b").first()["nmi"] == pytest.approx(1)
    assert evaluate.accuracy_greedy(t, "a", "b") == 1 and evaluate.accuracy_majority(t, "a", "b") == 1
    none = t.filter("a > 9")
    assert evaluate.adjusted_rand(none, "a", "b").first()["ari"] == 0


def test_assignment_in_code_and_in_numpy_agree(spark):
    rng = np.random.default_rng(2)
    x, reps = rng.normal(size=(200, 3)), rng.normal(size=(12, 3))
    labels = np.arange(12) % 4
    a = assign.nearest_rep(points(spark, x), reps, labels).orderBy("point_id").toPandas()
    want, dist = kernel.nearest_rep(x, reps, labels, "euclidean")
    assert (a.label == want).all() and np.allclose(a.dist, dist)
    p = assign.nearest_rep(points(spark, x), reps, labels, "pearson").orderBy("point_id").toPandas()
    assert (p.label == kernel.nearest_rep(x, reps, labels, "pearson")[0]).all()


def test_validation(spark):
    with pytest.raises(ValueError, match="cannot form"):
        validate(points(spark, [(1, 2)]), 2)
    with pytest.raises(ValueError, match="components"):
        validate(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "point_id long, features array<double>"), 1)
    with pytest.raises(ValueError, match="null"):
        validate(spark.createDataFrame([(0, [float("nan")])], "point_id long, features array<double>"), 1)


def test_outlier_rule_fills_up(spark):
    t = spark.createDataFrame([(0, 9), (1, 3), (2, 2), (3, 1)], "cluster_id int, size long")
    assert {r["cluster_id"] for r in sampling.eliminate_outliers(t, 3, 5).collect()} == {0, 1, 2}
    assert sampling.eliminate_outliers(t, 1, 5).select(F.count("*")).first()[0] == 1


def test_scattered_points_as_the_kernel_takes_them(spark):
    rng = np.random.default_rng(31)
    x = np.round(rng.normal(size=(60, 3)), 3)
    labels = np.arange(60) % 3
    x[labels == 2] = x[2]  # one point many times
    x[5] = x[2] + 1.0
    got = {}
    for r in sorted(sampling.scattered(points(spark, x, labels), "true_label", 3, 4).collect(), key=lambda r: r["place"]):
        got.setdefault(r["true_label"], []).append(r["point_id"])
    for label in range(3):
        own = np.flatnonzero(labels == label)
        assert got[label] == own[kernel.scattered(x[own], x[own].mean(axis=0), 4, "euclidean")].tolist()
    assert len(got[2]) == 2
