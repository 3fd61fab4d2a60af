"""Parameter sweeps: one job fits every setting side by side."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.operators import kernel, sampling
from shoal.operators.points import validate
from shoal.plans import distributed, scalable
from shoal.plans.base import run_kernel
from shoal.plans.config import ClusterConfig, ScalableConfig, kept_points
from shoal.runtime import durable, ship

SCHEMA = "setting int, alpha double, keep_fraction double, n long, n_clusters int, largest long, tau double"


def sweep(points: DataFrame, config: ClusterConfig, settings: list[tuple[float, float]]) -> DataFrame:
    """(setting, alpha, keep_fraction, n, n_clusters, largest, tau) per (alpha, keep_fraction), over a bounded set of points."""
    spark = points.sparkSession
    ship(spark)
    grid = spark.createDataFrame([(i, a, f) for i, (a, f) in enumerate(settings)], "setting int, alpha double, keep_fraction double")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = config.with_(alpha=float(frame["alpha"].iloc[0]), keep_fraction=float(frame["keep_fraction"].iloc[0]))
        frame = frame.sort_values("point_id", kind="stable")
        x = np.array(frame["features"].tolist(), dtype=float)
        keep = kept_points(len(x), own.k, own.keep_fraction)
        used = frame
        if keep < len(x):
            near = kernel.distances(x, x.mean(axis=0)[None, :], own.metric)[:, 0]
            used = frame.iloc[np.sort(np.lexsort((frame["point_id"].to_numpy(), near))[:keep])]
        got = run_kernel(used, own)
        if keep < len(x):
            reps = np.concatenate([np.array(r) for r in got["reps"]])
            owner = np.repeat(np.arange(len(got)), [len(r) for r in got["reps"]])
            sizes = np.bincount(kernel.nearest_rep(x, reps, owner, own.metric)[0], minlength=len(got))
        else:
            sizes = got["n_points"].to_numpy()
        sizes = np.sort(sizes)[::-1]
        return pd.DataFrame(
            [(int(frame["setting"].iloc[0]), float(frame["alpha"].iloc[0]), float(frame["keep_fraction"].iloc[0]), len(x), len(got), int(sizes[0]), float(sizes[:2].sum() / len(x)))],
            columns=["setting", "alpha", "keep_fraction", "n", "n_clusters", "largest", "tau"],
        )

    return points.select("point_id", "features").crossJoin(F.broadcast(grid)).repartition(len(settings), "setting").groupBy("setting").applyInPandas(run, SCHEMA)


GRID = "setting int, alpha double, keep_fraction double"
Step = Callable[[pd.DataFrame, float, float], pd.DataFrame]


def swept(points: DataFrame, parted: DataFrame, metric: str, settings: list[tuple[float, float]], map_step: Step, join_step: Step) -> DataFrame:
    """The table of ``sweep``, of settings that are fitted in parts and label all points.

    ``parted`` has (part, point_id, features, near): the bounded points of every part, for the settings with a keep
    fraction where ``near`` is true and for the others where it is false. A task maps one part under one setting, a
    task joins one setting's partial clusters, and one narrow pass over the points counts labels under all settings.
    """
    spark = points.sparkSession
    ship(spark)
    grid = spark.createDataFrame([(i, a, f) for i, (a, f) in enumerate(settings)], GRID)
    names = ["setting", "alpha", "keep_fraction"]

    def at(step: Step) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            own = frame.iloc[0][names].tolist()
            got = step(frame.drop(columns=names), float(own[1]), float(own[2])).reset_index(drop=True)
            return got.assign(setting=np.int32(own[0]), alpha=own[1], keep_fraction=own[2])

        return run

    rows = parted.join(F.broadcast(grid), F.col("near") == (F.col("keep_fraction") > 0)).select(*names, "part", "point_id", "features")  # a row per setting
    partials = durable(rows.groupBy(*names, "part").applyInPandas(at(map_step), f"{GRID}, {scalable.PARTIAL_SCHEMA}"), "swept")
    joined = partials.groupBy(*names).applyInPandas(at(join_step), f"{GRID}, cluster_id int, reps array<array<double>>")
    found = joined.select("setting", "cluster_id", "reps").collect()  # settings times clusters
    models = []
    for i in range(len(settings)):
        own = sorted((r["cluster_id"], r["reps"]) for r in found if r["setting"] == i)
        models.append((np.array([v for _, reps in own for v in reps], dtype=float), np.array([c for c, reps in own for _ in reps], dtype=np.int64), len(own)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(n, dtype=np.int64) for _, _, n in models]
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for i, (reps, label, n) in enumerate(models):
                if batch.num_rows and n:
                    seen[i] += np.bincount(kernel.nearest_rep(x, reps, label, metric)[0], minlength=n)
        setting = np.repeat(np.arange(len(seen), dtype=np.int32), [len(s) for s in seen])
        label = np.concatenate([np.arange(len(s), dtype=np.int32) for s in seen])
        yield pa.RecordBatch.from_arrays([pa.array(setting), pa.array(label), pa.array(np.concatenate(seen))], names=["setting", "label", "size"])

    sizes = points.select("features").mapInArrow(count, "setting int, label int, size long").groupBy("setting", "label").agg(F.sum("size").alias("size"))
    ranked = sizes.groupBy("setting").agg(F.sum("size").alias("n"), F.count("*").cast("int").alias("n_clusters"), F.sort_array(F.collect_list("size"), asc=False).alias("s"))
    out = ranked.withColumn("largest", F.col("s")[0]).withColumn("tau", F.try_divide(F.col("largest") + F.coalesce(F.get("s", 1), F.lit(0)), F.col("n")))
    return grid.join(out, "setting").select(*names, "n", "n_clusters", "largest", "tau")


def sweep_scalable(points: DataFrame, config: ScalableConfig, alphas: list[float]) -> DataFrame:
    """``sweep`` over alpha in the scalable form: one sample for all settings, labels for all points."""
    n, d = validate(points, config.k)
    sample, order, s = scalable.draw_sample(points, n, d, config)
    parted = durable(sampling.in_blocks(sample, order, s, config.n_partitions).select("part", "point_id", "features", F.lit(False).alias("near")), "sample")
    target = max(config.k, s // config.n_partitions // config.reduce_factor)

    def partials(frame: pd.DataFrame, alpha: float, _: float) -> pd.DataFrame:
        got = run_kernel(frame, config.with_(alpha=alpha), min(target, len(frame)))
        got.insert(0, "part", np.int32(frame["part"].iloc[0]))
        return got[got["n_points"] > 1].rename(columns={"cluster_id": "partial_id"})

    def finals(frame: pd.DataFrame, alpha: float, _: float) -> pd.DataFrame:
        got = scalable.second_pass(frame, config.with_(alpha=alpha))
        got = got.assign(large=got["n_points"] > config.outlier_threshold).sort_values(["large", "n_points", "cluster_id"], ascending=[False, False, True])
        got = got[got["large"] | (np.arange(len(got)) < config.k)].sort_values("cluster_id")
        return pd.DataFrame({"cluster_id": np.arange(len(got), dtype=np.int32), "reps": got["reps"].tolist()})

    return swept(points, parted, config.metric, [(a, 0.0) for a in alphas], partials, finals)


def sweep_distributed(points: DataFrame, config: ClusterConfig, fractions: list[float], splits: int = 8, most: int = 1000, reduce_factor: int = 20) -> DataFrame:
    """``sweep`` over the keep fraction in the distributed form: map and reduce for every setting, labels for all points."""
    _, d = validate(points, config.k)
    split = distributed.with_splits(points.select("point_id", "features"), splits)
    sides = [distributed.trimmed(split, near, most, d, config.metric).select("part", "point_id", "features", F.lit(near).alias("near")) for near in (False, True)]
    parted = durable(sides[0].unionByName(sides[1]), "splits")
    target = max(config.k, most // reduce_factor)
    own = lambda f: config.with_(keep_fraction=f)
    return swept(
        points, parted, config.metric, [(config.alpha, f) for f in fractions],
        lambda frame, _, f: distributed.map_split(frame, own(f), target),
        lambda frame, _, f: distributed.reduce_partials(frame, own(f))[["cluster_id", "reps"]],
    )
