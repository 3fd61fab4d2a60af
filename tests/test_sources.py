"""Text formats round trip."""

import json

from shoal.plans.config import ScalableConfig
from shoal.sources import io


def test_points_and_labels(spark, tmp_path):
    (tmp_path / "data.csv").write_text("1.5,2\n\n3,4.25\n-1,0\n")
    (tmp_path / "labels.csv").write_text("0\n1\n1\n")
    got = [(r["point_id"], r["features"]) for r in io.read_points(spark, str(tmp_path / "data.csv")).orderBy("point_id").collect()]
    assert got == [(0, [1.5, 2.0]), (1, [3.0, 4.25]), (2, [-1.0, 0.0])]
    assert [r["true_label"] for r in io.read_labels(spark, str(tmp_path / "labels.csv")).orderBy("point_id").collect()] == [0, 1, 1]


def test_params(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"k": 4, "scalable": True, "metric": "pearson", "outlier_sample_fraction": 0.5}))
    (tmp_path / "b.json").write_text("{}")
    a, b = io.read_params(spark, str(tmp_path / "a.json")), io.read_params(spark, str(tmp_path / "b.json"))
    assert isinstance(a, ScalableConfig) and a.k == 4 and a.metric == "pearson" and a.keep_fraction == 0.5
    assert (b.k, b.c, b.alpha, b.metric) == (3, 5, 0.3, "euclidean")


def test_results(spark, tmp_path):
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "point_id long, label int")
    io.write_results(labels, 0.5, str(tmp_path / "r"))
    m = spark.read.json(str(tmp_path / "r/metrics")).first()
    assert (m["ari_vs_true"], m["n_clusters"], list(m["cluster_sizes"])) == (0.5, 2, [2, 1])
    assert spark.read.parquet(str(tmp_path / "r/labels")).count() == 3


def test_cluster_lines_keep_all_digits(spark):
    rows = [(0, 3, [0.1 + 0.2, 1e-17], [[1 / 3, 2.0], [5.0, 6.0]]), (1, 1, [1.0, 2.0], [])]
    df = spark.createDataFrame(rows, "cluster_id int, n_points long, mean array<double>, reps array<array<double>>")
    back = [tuple(r) for r in io.from_line(io.to_line(df)).orderBy("cluster_id").collect()]
    assert back == rows
