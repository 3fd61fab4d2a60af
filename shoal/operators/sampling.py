"""Samples by nearness to a centroid or by hash, trimming, partitions and outlier rules."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions import vec
from shoal.operators.stats import centroid, mean_vector
from shoal.plans.config import kept_points
from shoal.runtime import durable


def by_nearness(points: DataFrame, d: int, metric: str = "euclidean") -> DataFrame:
    """``points`` with ``dist``, the distance to the centroid of all."""
    middle = centroid(points, d).select("mean")
    return points.crossJoin(F.broadcast(middle)).withColumn("dist", vec.distance("features", "mean", metric, d)).drop("mean")  # one row


def nearest_to_centroid(points: DataFrame, d: int, n: int, metric: str = "euclidean") -> DataFrame:
    """The ``n`` points nearest to the centroid, ties to the smaller id."""
    return by_nearness(points, d, metric).orderBy("dist", "point_id").limit(n)


def keep_fraction(points: DataFrame, d: int, k: int, fraction: float, metric: str = "euclidean") -> DataFrame:
    """The outlier-resistant sample: the given fraction nearest to the centroid, at least ``k``; all for 0 and 1."""
    n = points.count()
    kept = kept_points(n, k, fraction)
    return points if kept >= n else nearest_to_centroid(points, d, kept, metric)


def shuffled(seed: int) -> Column:
    """A key that puts ids in a random order; the MD5 of ``id:seed``, so that any engine gives the same order."""
    return F.md5(F.concat_ws(":", F.col("point_id").cast("string"), F.lit(str(seed))))


def random_sample(points: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` points (all, if fewer), the same for every layout of the input."""
    return points.withColumn("order_key", shuffled(seed)).orderBy("order_key", "point_id").limit(n)


def in_blocks(sample: DataFrame, order: list[str], size: int, parts: int) -> DataFrame:
    """``part``: blocks of size // parts rows in the given order, the last takes the rest; for a bounded sample."""
    width = max(1, size // parts)
    rn = F.row_number().over(Window.orderBy(*order)) - 1
    return sample.withColumn("part", F.least(F.floor(rn / width), F.lit(parts - 1)).cast("int"))


def trim_partitions(points: DataFrame, d: int, part: str, most: int, metric: str = "euclidean") -> DataFrame:
    """In partitions of more than ``most`` rows (if above 0), the ``most`` nearest to the partition's own mean."""
    means = points.groupBy(part).agg(mean_vector(d).alias("mean"), F.count("*").alias("rows"))
    near = points.join(means, part).withColumn("dist", vec.distance("features", "mean", metric, d)).drop("mean")
    if most <= 0:
        return near.drop("rows")
    rank = F.row_number().over(Window.partitionBy(part).orderBy("dist", "point_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank", "rows")


def trim_partitions_by_fraction(points: DataFrame, d: int, part: str, k: int, fraction: float, metric: str = "euclidean") -> DataFrame:
    """In every partition the fraction nearest to its mean, at least ``k``."""
    means = points.groupBy(part).agg(mean_vector(d).alias("mean"), F.count("*").alias("rows"))
    near = points.join(means, part).withColumn("dist", vec.distance("features", "mean", metric, d)).drop("mean")
    rank = F.row_number().over(Window.partitionBy(part).orderBy("dist", "point_id"))
    kept = F.greatest(F.lit(k).cast("long"), F.floor(F.col("rows") * fraction))
    return near.withColumn("rank", rank).filter(F.col("rank") <= kept).drop("rank", "rows")


def eliminate_outliers(clusters: DataFrame, k: int, threshold: int) -> DataFrame:
    """Clusters (cluster_id, size) above ``threshold``; where fewer than ``k`` are, the largest others fill up."""
    keep = F.col("size") > threshold
    rank = F.row_number().over(Window.orderBy(F.desc(keep), F.desc("size"), "cluster_id"))
    return clusters.withColumn("rank", rank).filter(keep | (F.col("rank") <= k)).drop("rank")


def stratified(points: DataFrame, label: str, n: int, seed: int = 42) -> DataFrame:
    """About ``n`` points, each label by its share and at least one, chosen by hash."""
    sizes = points.groupBy(label).agg(F.count("*").alias("rows"))
    whole = sizes.agg(F.sum("rows").alias("whole"))
    quota = sizes.crossJoin(F.broadcast(whole)).select(label, F.greatest(F.lit(1).cast("long"), F.ceil(F.col("rows") * F.lit(n) / F.col("whole"))).alias("quota"))  # one row
    rank = F.row_number().over(Window.partitionBy(label).orderBy(shuffled(seed), "point_id"))
    return points.withColumn("rank", rank).join(F.broadcast(quota), label).filter(F.col("rank") <= F.col("quota")).drop("rank", "quota")


def trim_partitions_random(points: DataFrame, part: str, most: int, seed: int = 42) -> DataFrame:
    """In partitions of more than ``most`` rows (if above 0), the ``most`` of the lowest hash."""
    if most <= 0:
        return points
    rank = F.row_number().over(Window.partitionBy(part).orderBy(shuffled(seed), "point_id"))
    return points.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def scattered(points: DataFrame, group: str, d: int, c: int) -> DataFrame:
    """(group, place, point_id, features): up to ``c`` scattered points of every group, of any size.

    The first is the farthest from the group's mean, the next always the farthest from those chosen; ties go to the
    smaller id, and of equal points one is taken. Each place is one pass and one aggregate that combines where the
    points lie, so no group meets in a task.
    """
    means = points.groupBy(group).agg(mean_vector(d).alias("mean"))
    rows = points.select(group, "point_id", "features").join(means, group).withColumn("far", vec.euclidean("features", "mean", d)).drop("mean")
    places = []
    for i in range(c):
        open_ = rows.filter("far > 0") if i else rows
        best = open_.groupBy(group).agg(F.min(F.struct((-F.round("far", 6)).alias("m"), "point_id", "features")).alias("b"))
        places.append(durable(best.select(group, F.lit(i).cast("long").alias("place"), F.col("b.point_id").alias("point_id"), F.col("b.features").alias("features")), "scattered"))
        step = vec.euclidean("features", "chosen", d)
        rows = rows.join(places[i].select(group, F.col("features").alias("chosen")), group)
        rows = rows.withColumn("far", F.least("far", step) if i else step).drop("chosen")
    return functools.reduce(DataFrame.unionByName, places)
