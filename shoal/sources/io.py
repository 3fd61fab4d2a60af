"""Text files of points, labels and parameters; results; the line format of cluster summaries."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.plans.config import ClusterConfig, ScalableConfig


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(point_id, line): the lines that are not blank, numbered from 0 in file order.

    Line order only exists in files, so lines are numbered within each partition of the read, and
    partitions are offset by the counts before them.
    """
    raw = spark.read.text(path).withColumn("m", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    placed = raw.select("value", F.shiftright("m", 33).alias("p"), "m")
    counts = placed.groupBy("p").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rn = F.row_number().over(Window.partitionBy("p").orderBy("m"))
    joined = placed.withColumn("rn", rn).join(F.broadcast(counts.select("p", before.alias("base"))), "p")  # a row per file split
    return joined.select((F.col("base") + F.col("rn") - 1).cast("long").alias("point_id"), F.trim("value").alias("line"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(point_id, features) of a headerless comma-separated file of any number of columns."""
    lines = numbered_lines(spark, path)
    return lines.select("point_id", F.transform(F.split("line", ","), lambda x: F.trim(x).cast("double")).alias("features"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(point_id, true_label) of a file with a whole number per line."""
    return numbered_lines(spark, path).select("point_id", F.col("line").cast("int").alias("true_label"))


def read_params(spark: SparkSession, path: str) -> ClusterConfig:
    """A parameter file; what it lacks is k 3, c 5, alpha 0.3, Euclidean, not scalable, no sample."""
    got = json.loads("\n".join(r["value"] for r in spark.read.text(path).limit(10_000).collect()))
    kind = ScalableConfig if got.get("scalable") else ClusterConfig
    return kind(
        k=int(got.get("k", 3)), c=int(got.get("c", 5)), alpha=float(got.get("alpha", 0.3)),
        metric=got.get("metric", "euclidean"), keep_fraction=float(got.get("outlier_sample_fraction", 0.0)),
    )


def write_points(points: DataFrame, path: str) -> None:
    """Headerless comma-separated values in the order of the ids, with 10 decimals."""
    line = F.array_join(F.transform("features", lambda x: F.format_number(x, "0.0000000000")), ",")
    points.orderBy("point_id").select(line.alias("value")).write.text(path)


def write_results(labels: DataFrame, ari: float, path: str) -> None:
    """Labels as Parquet under ``labels`` and one JSON row (ari_vs_true, n_clusters, cluster_sizes) under ``metrics``."""
    labels.select("point_id", "label").write.parquet(f"{path}/labels")
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    one = sizes.agg(F.lit(float(ari)).alias("ari_vs_true"), F.count("*").alias("n_clusters"), F.transform(F.array_sort(F.collect_list(F.struct("label", "n"))), lambda s: s["n"]).alias("cluster_sizes"))
    one.write.json(f"{path}/metrics")


def to_line(clusters: DataFrame) -> DataFrame:
    """``line``: id, n_points, n_reps, dimension, mean and representatives, separated by tabs, with all digits."""
    text = lambda v: F.transform(v, lambda x: x.cast("string"))
    fields = F.concat(
        F.array(F.col("cluster_id").cast("string"), F.col("n_points").cast("string"), F.size("reps").cast("string"), F.size("mean").cast("string")),
        text(F.col("mean")),
        text(F.flatten("reps")),
    )
    return clusters.select(F.array_join(fields, "\t").alias("line"))


def from_line(lines: DataFrame) -> DataFrame:
    """(cluster_id, n_points, mean, reps) of lines as ``to_line`` writes them."""
    f = F.split("line", "\t")
    numbers = F.transform(F.slice(f, 5, F.size(f)), lambda x: x.cast("double"))
    parsed = lines.select(
        f[0].cast("int").alias("cluster_id"), f[1].cast("long").alias("n_points"), f[2].cast("int").alias("m"), f[3].cast("int").alias("d"), numbers.alias("v")
    )
    rep: Column = F.transform(F.sequence(F.lit(1), F.col("m")), lambda i: F.slice("v", i * F.col("d") + 1, F.col("d")))
    reps = F.when(F.col("m") > 0, rep).otherwise(F.array().cast("array<array<double>>"))
    return parsed.select("cluster_id", "n_points", F.slice("v", 1, F.col("d")).alias("mean"), reps.alias("reps"))
