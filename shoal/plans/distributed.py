"""Map, reduce and label: every split is clustered where it lies, the summaries are merged, all points are labelled."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.operators import kernel, sampling
from shoal.operators.points import validate
from shoal.plans.base import ClusterModel, run_kernel
from shoal.plans.config import ClusterConfig, kept_points
from shoal.plans.scalable import PARTIAL_SCHEMA
from shoal.runtime import durable, ship


def with_splits(points: DataFrame, splits: int) -> DataFrame:
    """``part`` by the id, so that results don't depend on how files are laid out."""
    return points.withColumn("part", F.pmod("point_id", F.lit(splits)).cast("int"))


def trimmed(parted: DataFrame, near: bool, most: int, d: int, metric: str, seed: int = 42) -> DataFrame:
    """Each split cut down to ``most`` points: those nearest to the split's own mean, or those of the lowest hash."""
    if near:
        return sampling.trim_partitions(parted, d, "part", most, metric)
    return sampling.trim_partitions_random(parted, "part", most, seed)


def map_split(frame: pd.DataFrame, config: ClusterConfig, target: int) -> pd.DataFrame:
    """One split merged down to ``target`` clusters; with a keep fraction, of the points nearest to its mean."""
    part = np.int32(frame["part"].iloc[0])
    keep = kept_points(len(frame), config.k, config.keep_fraction)
    if keep < len(frame):
        frame = frame.sort_values("point_id", kind="stable")
        x = np.array(frame["features"].tolist(), dtype=float)
        near = kernel.distances(x, x.mean(axis=0)[None, :], config.metric)[:, 0]
        frame = frame.iloc[np.sort(np.lexsort((frame["point_id"].to_numpy(), near))[:keep])]
    got = run_kernel(frame, config, min(target, len(frame)))
    got.insert(0, "part", part)
    return got.rename(columns={"cluster_id": "partial_id"})


def map_partials(parted: DataFrame, config: ClusterConfig, target: int, most: int, d: int, seed: int = 42) -> DataFrame:
    """Each split trimmed to ``most`` points (by nearness with a keep fraction) and merged down to ``target`` clusters."""
    ship(parted.sparkSession)
    rows = trimmed(parted, config.keep_fraction > 0, most, d, config.metric, seed).select("part", "point_id", "features")
    return rows.groupBy("part").applyInPandas(lambda f: map_split(f, config, target), PARTIAL_SCHEMA)


def merge_summaries(a: tuple, b: tuple, config: ClusterConfig) -> tuple[int, np.ndarray, np.ndarray]:
    """Two summaries (n, mean, reps) as one: weighted mean, scattered representatives of both moved towards it.

    Representatives are taken as they are, so each merge moves them once more; where both have fewer than c
    different ones, the two means join the candidates.
    """
    n = a[0] + b[0]
    mean = (np.asarray(a[1]) * a[0] + np.asarray(b[1]) * b[0]) / n
    reps = np.concatenate([np.asarray(a[2]), np.asarray(b[2])])
    pool = kernel.distinct_rows(reps)
    if len(pool) < config.c:
        pool = np.concatenate([np.asarray(a[1])[None, :], np.asarray(b[1])[None, :], reps])
    plain = pool[kernel.scattered(pool, mean, config.c, config.metric)]
    return n, mean, plain + config.alpha * (mean - plain)


def reduce_partials(partials: pd.DataFrame, config: ClusterConfig) -> pd.DataFrame:
    """(cluster_id, n_points, mean, reps, partials): partials joined by the majority of their representatives' labels."""
    partials = partials.sort_values(["part", "partial_id"], kind="stable").reset_index(drop=True)
    summaries = list(zip(partials["n_points"], [np.array(m) for m in partials["mean"]], [np.array(r.tolist() if hasattr(r, "tolist") else r) for r in map(np.stack, partials["reps"])], strict=True))
    if len(partials) <= config.k:
        groups = [[i] for i in range(len(partials))]
    else:
        x = np.concatenate([s[2] for s in summaries])
        of = np.repeat(np.arange(len(partials)), [len(s[2]) for s in summaries])
        keep = kept_points(len(x), config.k, config.keep_fraction)
        used = np.arange(len(x))
        if keep < len(x):
            near = kernel.distances(x, x.mean(axis=0)[None, :], config.metric)[:, 0]
            used = np.sort(np.lexsort((used, near))[:keep])
        result = kernel.agglomerate(x[used], config.k, config.c, config.alpha, config.metric, config.center, config.candidates)
        flat = np.concatenate([c.reps for c in result.clusters])
        owner = np.repeat(np.arange(len(result.clusters)), [len(c.reps) for c in result.clusters])
        label = kernel.nearest_rep(x, flat, owner, config.metric)[0] if keep < len(x) else result.labels(len(x))
        votes = np.zeros((len(partials), len(result.clusters)), dtype=int)
        np.add.at(votes, (of, label), 1)
        final = votes.argmax(axis=1)  # ties: the lowest label
        groups = [g for g in (np.flatnonzero(final == f).tolist() for f in range(len(result.clusters))) if g]
    rows = []
    for g in groups:
        joined = summaries[g[0]]
        for i in g[1:]:
            joined = merge_summaries(joined, summaries[i], config)
        rows.append((int(joined[0]), np.asarray(joined[1]).tolist(), [r.tolist() for r in np.asarray(joined[2])], g))
    return pd.DataFrame(
        {"cluster_id": np.arange(len(rows), dtype=np.int32), "n_points": [r[0] for r in rows], "mean": [r[1] for r in rows], "reps": [r[2] for r in rows], "partials": [r[3] for r in rows]}
    )


REDUCED_SCHEMA = "cluster_id int, n_points long, mean array<double>, reps array<array<double>>, partials array<int>"


def reduce_in_one_task(partials: DataFrame, config: ClusterConfig) -> DataFrame:
    """The reduce step; it meets a summary per partial cluster, never points."""
    ship(partials.sparkSession)
    rows = partials.select(F.lit(0).alias("one"), "part", "partial_id", "n_points", "mean", "reps")
    return rows.groupBy("one").applyInPandas(lambda f: reduce_partials(f.drop(columns="one"), config), REDUCED_SCHEMA)


def majority_vote(votes: DataFrame) -> DataFrame:
    """(partial_id, label): the commonest label of each partial's votes, ties to the lowest."""
    counts = votes.groupBy("partial_id", "label").agg(F.count("*").alias("n"))
    best = counts.groupBy("partial_id").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("label"))).alias("b"))
    return best.select("partial_id", F.col("b.label").alias("label"))


def fit_distributed(points: DataFrame, config: ClusterConfig, splits: int = 8, most: int = 1000, reduce_factor: int = 20) -> ClusterModel:
    """Splits mapped in parallel, their summaries reduced, all points labelled by the configured metric."""
    _, d = validate(points, config.k)
    target = max(config.k, most // reduce_factor)
    partials = durable(map_partials(with_splits(points, splits), config, target, most, d).drop("members"), "mapped")
    clusters = durable(reduce_in_one_task(partials, config).drop("partials"), "reduced")
    model = ClusterModel(config, clusters, points)
    return ClusterModel(config, clusters, model.predict(points).select("point_id", "label"))
