"""Centroids, medoids, standardisation, sizes and contingency tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions import vec


def mean_vector(d: int, v: str = "features") -> Column:
    """The coordinate-wise mean as one aggregate column per coordinate: partial sums, no exploded rows."""
    return F.array(*[F.avg(F.col(v)[i]) for i in range(d)])


def sum_vector(d: int, v: str = "features") -> Column:
    return F.array(*[F.sum(F.col(v)[i]) for i in range(d)])


def centroid(points: DataFrame, d: int) -> DataFrame:
    return points.agg(mean_vector(d).alias("mean"), F.count("*").alias("n"))


def centroids(points: DataFrame, d: int, label: str = "true_label") -> DataFrame:
    """(label, mean, n) per label; one shuffle of a row per task and label."""
    return points.groupBy(label).agg(mean_vector(d).alias("mean"), F.count("*").alias("n"))


def weighted_merge(summaries: DataFrame, d: int, group: str) -> DataFrame:
    """(group, mean, n): summaries (mean, n) merged, weighted by their sizes."""
    weighted = [F.sum(F.col("mean")[i] * F.col("n")) / F.sum("n") for i in range(d)]
    return summaries.groupBy(group).agg(F.array(*weighted).alias("mean"), F.sum("n").alias("n"))


def pearson_medoids(points: DataFrame, d: int, label: str = "true_label") -> DataFrame:
    """(label, medoid_id, total): the member with the least summed Pearson distance to all members of its label.

    With unit forms z the sum over members j of 1 - z_i.z_j is n - z_i.sum(z), so no pairs are made: a sum
    per label and one pass over the members.
    """
    unit = points.select("point_id", F.col(label), vec.center_normalize("features").alias("z"))
    sums = unit.groupBy(label).agg(sum_vector(d, "z").alias("zsum"), F.count("*").alias("n"))
    scored = unit.join(sums, label).withColumn("total", F.col("n") - vec.dot("z", "zsum"))
    best = scored.groupBy(label).agg(F.min(F.struct(F.round("total", 9).alias("total"), "point_id")).alias("b"))
    return best.select(label, F.col("b.point_id").alias("medoid_id"), F.col("b.total").alias("total"))


def moments(points: DataFrame, d: int) -> DataFrame:
    """One row: mean and population deviation per coordinate (below 1e-10: 1)."""
    dev = [F.when(F.stddev_pop(F.col("features")[i]) < vec.EPS, 1.0).otherwise(F.stddev_pop(F.col("features")[i])) for i in range(d)]
    return points.agg(mean_vector(d).alias("mu"), F.array(*dev).alias("sigma"))


def standardize(points: DataFrame, d: int) -> DataFrame:
    """Features with mean 0 and population deviation 1."""
    model = F.broadcast(moments(points, d))  # one row
    z = F.zip_with(vec.sub("features", "mu"), F.col("sigma"), lambda x, s: x / s)
    return points.crossJoin(model).withColumn("features", z).drop("mu", "sigma")


def destandardize(points: DataFrame, model: DataFrame) -> DataFrame:
    """The inverse of ``standardize`` for a one-row table of moments."""
    back = F.zip_with(F.zip_with(F.col("features"), F.col("sigma"), lambda x, s: x * s), F.col("mu"), lambda x, m: x + m)
    return points.crossJoin(F.broadcast(model)).withColumn("features", back).drop("mu", "sigma")  # one row


def cluster_sizes(labels: DataFrame, label: str = "label") -> DataFrame:
    return labels.groupBy(label).agg(F.count("*").alias("size"))


def sorted_sizes(labels: DataFrame, label: str = "label") -> DataFrame:
    """(rank, size): sizes from the largest; a row per cluster meets in one task."""
    sizes = cluster_sizes(labels, label)
    return sizes.select(F.row_number().over(Window.orderBy(F.desc("size"), label)).cast("long").alias("rank"), "size")


def cluster_statistics(labels: DataFrame, label: str = "label") -> DataFrame:
    """(label, size, pct, singleton)."""
    sizes = cluster_sizes(labels, label)
    whole = F.sum("size").over(Window.partitionBy())
    return sizes.select(label, "size", (F.col("size") * 100.0 / whole).alias("pct"), (F.col("size") == 1).alias("singleton"))


def contingency(labels: DataFrame, a: str, b: str) -> DataFrame:
    return labels.groupBy(a, b).agg(F.count("*").alias("n"))


def labels_from_membership(membership: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """(point_id, label): clusters numbered from 0 by their smallest point."""
    first = membership.groupBy(cluster).agg(F.min("point_id").alias("first"))
    ranked = first.select(cluster, (F.row_number().over(Window.orderBy("first")) - 1).cast("int").alias("label"))
    return membership.join(ranked, cluster).select("point_id", "label")
