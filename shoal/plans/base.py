"""Clustering of a bounded set of points in one task, and the model that all plans return."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.operators import assign, kernel, sampling, stats
from shoal.operators.points import validate
from shoal.plans.config import ClusterConfig, kept_points
from shoal.runtime import durable, ship

#: Points up to which the form that chooses by size takes the base form.
LOCAL_LIMIT = 5000


@dataclass(frozen=True)
class ClusterModel:
    """``clusters``: (cluster_id int, n_points long, mean, reps); bounded by k, so it is kept on the driver's side as a small table."""

    config: ClusterConfig
    clusters: DataFrame
    labels: DataFrame

    @property
    def representatives(self) -> DataFrame:
        """(label, rep_idx, rep)."""
        return self.clusters.select(F.col("cluster_id").alias("label"), F.posexplode("reps").alias("rep_idx", "rep"))

    def predict(self, points: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        reps, labels = assign.collect_reps(self.representatives)
        return assign.nearest_rep(points, reps, labels, self.config.metric, keep)


CLUSTER_SCHEMA = "cluster_id int, n_points long, mean array<double>, reps array<array<double>>, members array<long>"


def cluster_rows(ids: np.ndarray, result: kernel.Result) -> pd.DataFrame:
    """Clusters numbered from 0 by their smallest point."""
    order = sorted(result.clusters, key=lambda c: ids[c.members].min())
    return pd.DataFrame(
        {
            "cluster_id": np.arange(len(order), dtype=np.int32),
            "n_points": [len(c.members) for c in order],
            "mean": [c.center.tolist() for c in order],
            "reps": [c.reps.tolist() for c in order],
            "members": [np.sort(ids[c.members]).tolist() for c in order],
        }
    )


def run_kernel(frame: pd.DataFrame, config: ClusterConfig, k: int | None = None) -> pd.DataFrame:
    frame = frame.sort_values("point_id", kind="stable")
    x = np.array(frame["features"].tolist(), dtype=float)
    result = kernel.agglomerate(x, config.k if k is None else k, config.c, config.alpha, config.metric, config.center, config.candidates)
    return cluster_rows(frame["point_id"].to_numpy(), result)


def in_one_task(points: DataFrame, config: ClusterConfig) -> DataFrame:
    """Clusters of a bounded table, by the merge loop in one task."""
    ship(points.sparkSession)
    rows = points.select(F.lit(0).alias("one"), "point_id", "features")
    return rows.groupBy("one").applyInPandas(lambda f: run_kernel(f, config), CLUSTER_SCHEMA)


def fit(points: DataFrame, config: ClusterConfig, limit: int | None = None) -> ClusterModel:
    """The base form: all points (or the sample nearest to the centroid) merged down to k clusters.

    Labels are memberships; with a sample they are those of the nearest representative, for all points. The merge loop is one
    task, of memory linear and time quadratic in the points; with a ``limit``, more points than that are refused.
    """
    n, d = validate(points, config.k)
    kept = kept_points(n, config.k, config.keep_fraction)
    if limit is not None and kept > limit:
        raise ValueError(f"{kept} points are over the single-task limit of {limit}; use the scalable form")
    used = points if kept >= n else sampling.nearest_to_centroid(points, d, kept, config.metric)
    clusters = durable(in_one_task(used, config), "clusters")
    model = ClusterModel(config, clusters.drop("members"), clusters.select(F.explode("members").alias("point_id"), F.col("cluster_id").alias("label")))
    if kept >= n:
        return model
    return ClusterModel(config, model.clusters, model.predict(points).select("point_id", "label"))


def standardized_fit(points: DataFrame, config: ClusterConfig, fitted_by: Callable[[DataFrame, ClusterConfig], ClusterModel] = fit) -> ClusterModel:
    """A fit on z-scores, with centres and representatives turned back into the units of the input."""
    _, d = validate(points, config.k)
    model = durable(stats.moments(points, d), "moments")
    fitted = fitted_by(stats.standardize(points, d), config)
    back = lambda v: F.zip_with(F.zip_with(v, F.col("sigma"), lambda x, s: x * s), F.col("mu"), lambda x, m: x + m)
    clusters = fitted.clusters.crossJoin(F.broadcast(model)).select("cluster_id", "n_points", back(F.col("mean")).alias("mean"), F.transform("reps", back).alias("reps"))  # one row
    return ClusterModel(config, clusters, fitted.labels)
