"""Sample, partition, cluster the parts, merge their representatives, label all points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.operators import kernel, sampling
from shoal.operators.points import validate
from shoal.plans.base import LOCAL_LIMIT, ClusterModel, fit, run_kernel
from shoal.plans.config import ClusterConfig, ScalableConfig, kept_points
from shoal.runtime import durable, ship

PARTIAL_SCHEMA = "part int, partial_id int, n_points long, mean array<double>, reps array<array<double>>, members array<long>"


def draw_sample(points: DataFrame, n: int, d: int, config: ScalableConfig) -> tuple[DataFrame, list[str], int]:
    """The sampled points, the order in which they were drawn, and their number."""
    s = config.points_sampled(n)
    if config.centroid_sampling:
        return sampling.nearest_to_centroid(points, d, s, config.metric), ["dist", "point_id"], s
    return sampling.random_sample(points, s, config.seed), ["order_key", "point_id"], s


def partial_clusters(parted: DataFrame, config: ClusterConfig, target: int) -> DataFrame:
    """(part, partial_id, n_points, mean, reps, members): every part merged down to ``target`` clusters, in parallel."""
    ship(parted.sparkSession)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        got = run_kernel(frame, config, min(target, len(frame)))
        got.insert(0, "part", np.int32(frame["part"].iloc[0]))
        return got.rename(columns={"cluster_id": "partial_id"})

    return parted.select("part", "point_id", "features").groupBy("part").applyInPandas(run, PARTIAL_SCHEMA)


def second_pass(partials: pd.DataFrame, config: ClusterConfig) -> pd.DataFrame:
    """Final clusters (cluster_id, n_points, mean, reps, partials, members) of all representatives of the partial clusters.

    A partial whose representatives fall in several clusters is a member of each of them.
    """
    partials = partials.sort_values(["part", "partial_id"], kind="stable").reset_index(drop=True)
    if len(partials) <= config.k:
        groups = [({i}, np.array(p.mean_), np.array(p.reps)) for i, p in enumerate(partials.rename(columns={"mean": "mean_"}).itertuples())]
    else:
        x = np.array([r for reps in partials["reps"] for r in reps], dtype=float)
        of = np.repeat(np.arange(len(partials)), [len(r) for r in partials["reps"]])
        result = kernel.agglomerate(x, config.k, config.c, config.alpha, config.metric, config.center, config.candidates)
        groups = [(set(of[c.members].tolist()), c.center, c.reps) for c in result.clusters]
    rows = []
    for owners, mean, reps in groups:
        members = sorted({int(m) for i in owners for m in partials["members"][i]})
        rows.append((members[0] if members else -1, len(members), np.asarray(mean).tolist(), [np.asarray(r).tolist() for r in reps], sorted(owners), members))
    rows.sort(key=lambda r: (r[0], r[4]))
    return pd.DataFrame(
        {
            "cluster_id": np.arange(len(rows), dtype=np.int32),
            "n_points": [r[1] for r in rows],
            "mean": [r[2] for r in rows],
            "reps": [r[3] for r in rows],
            "partials": [r[4] for r in rows],
            "members": [r[5] for r in rows],
        }
    )


FINAL_SCHEMA = "cluster_id int, n_points long, mean array<double>, reps array<array<double>>, partials array<int>, members array<long>"


def merge_partials(partials: DataFrame, config: ClusterConfig) -> DataFrame:
    """``second_pass`` in one task; its input is bounded by the sample, not by the points."""
    ship(partials.sparkSession)
    return partials.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(lambda f: second_pass(f.drop(columns="one"), config), FINAL_SCHEMA)


def fit_partials(points: DataFrame, config: ScalableConfig) -> DataFrame:
    """The partial clusters of the sample, those of one point left out."""
    n, d = validate(points, config.k)
    kept = kept_points(n, config.k, config.keep_fraction)
    if kept < n:
        # the points nearest to the centroid; their number is a share of all, so a threshold takes them, not a sort
        near = sampling.by_nearness(points, d, config.metric)
        limit = near.agg(F.percentile_approx("dist", kept / n, 1_000_000)).first()[0]
        points = near.filter(F.col("dist") <= limit).drop("dist")
        n = points.count()
    sample, order, s = draw_sample(points, n, d, config)
    parted = sampling.in_blocks(sample, order, s, config.n_partitions)
    target = max(config.k, s // config.n_partitions // config.reduce_factor)
    return partial_clusters(parted, config, target).filter("n_points > 1")


def fit_scalable(points: DataFrame, config: ScalableConfig) -> ClusterModel:
    """The whole pipeline; only the sample meets in few tasks, all points are labelled in one narrow pass."""
    partials = durable(fit_partials(points, config), "partials")
    finals = durable(merge_partials(partials, config), "finals")
    kept = sampling.eliminate_outliers(finals.withColumn("size", F.size("members")), config.k, config.outlier_threshold)
    rows = kept.orderBy("cluster_id").select("n_points", "mean", "reps").collect()  # at most k clusters
    clusters = points.sparkSession.createDataFrame(
        [(i, r["n_points"], r["mean"], r["reps"]) for i, r in enumerate(rows)], "cluster_id int, n_points long, mean array<double>, reps array<array<double>>"
    )
    model = ClusterModel(config, clusters, points)
    return ClusterModel(config, clusters, model.predict(points).select("point_id", "label"))


def fit_auto(points: DataFrame, k: int, c: int = 5, alpha: float = 0.3, scalable: bool = False, limit: int = LOCAL_LIMIT) -> ClusterModel:
    """The one form that chooses by size: the base form up to ``limit`` points, the scalable one beyond or on demand, by Euclidean distance."""
    config = ScalableConfig(k=k, c=c, alpha=alpha)
    if scalable or points.count() > limit:
        return fit_scalable(points, config)
    return fit(points, ClusterConfig(k=k, c=c, alpha=alpha), limit)
