"""Agreement, validity and concentration of labellings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions import vec
from shoal.operators import kernel
from shoal.operators.stats import contingency, mean_vector, sorted_sizes, sum_vector
from shoal.runtime import durable, ship


def pairs_of(n: Column) -> Column:
    return n * (n - 1) / 2.0


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``ari``: 1 for equal partitions; 0 without rows; 1 where no pair or no spread is possible."""
    cells = contingency(labels, a, b)
    both = cells.agg(F.sum(pairs_of(F.col("n"))).alias("both"), F.sum("n").alias("n"))
    left = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs_of(F.col("n"))).alias("left"))
    right = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs_of(F.col("n"))).alias("right"))
    one = both.crossJoin(left).crossJoin(right)  # one row each
    all_pairs = pairs_of(F.col("n"))
    expected = F.try_divide(F.col("left") * F.col("right"), all_pairs)
    top = (F.col("left") + F.col("right")) / 2.0
    ari = F.when(F.col("n").isNull(), 0.0).when(all_pairs == 0, 1.0).when(F.abs(top - expected) < 1e-15, 1.0).otherwise(F.try_divide(F.col("both") - expected, top - expected))
    return one.select(ari.alias("ari"))


def normalized_mutual_information(labels: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``nmi``, normalised by the mean of both entropies; 1 where both are 0."""
    cells = contingency(labels, a, b)
    whole = cells.agg(F.sum("n").alias("whole"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("na"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("nb"))
    p = F.col("n") / F.col("whole")
    mi = (
        cells.join(rows, a).join(cols, b).crossJoin(F.broadcast(whole))  # one row
        .agg(F.sum(p * F.log(F.col("n") * F.col("whole") / (F.col("na") * F.col("nb")))).alias("mi"))
    )
    entropy = lambda t, n, name: t.crossJoin(F.broadcast(whole)).agg((-F.sum(F.col(n) / F.col("whole") * F.log(F.col(n) / F.col("whole")))).alias(name))
    one = mi.crossJoin(entropy(rows, "na", "ha")).crossJoin(entropy(cols, "nb", "hb"))
    top = (F.col("ha") + F.col("hb")) / 2.0
    return one.select(F.when(top < 1e-15, 1.0).otherwise(F.try_divide(F.col("mi"), top)).alias("nmi"))


def cells_of(labels: DataFrame, truth: str, label: str) -> np.ndarray:
    """The contingency table of two bounded sets of labels (clusters by clusters) on the driver."""
    rows = contingency(labels, truth, label).collect()
    t, p = sorted({r[truth] for r in rows}), sorted({r[label] for r in rows})
    out = np.zeros((len(t), len(p)), dtype=np.int64)
    for r in rows:
        out[t.index(r[truth]), p.index(r[label])] = r["n"]
    return out


def accuracy_greedy(labels: DataFrame, truth: str, label: str) -> float:
    """Share of rows in cells chosen greedily: always the largest whose row and column are free."""
    m = cells_of(labels, truth, label)
    n, hit = m.sum(), 0
    m = m.copy()
    for _ in range(min(m.shape)):
        i, j = np.unravel_index(int(np.argmax(m)), m.shape)
        if m[i, j] < 0:
            break
        hit += m[i, j]
        m[i, :] = -1
        m[:, j] = -1
    return float(hit / n) if n else 0.0


def accuracy_majority(labels: DataFrame, truth: str, label: str) -> float:
    """Each true cluster in order takes its commonest label that is still free (ties: the lowest)."""
    m = cells_of(labels, truth, label)
    free, hit = np.ones(m.shape[1], bool), 0
    for row in m:
        if not free.any():
            break
        j = int(np.argmax(np.where(free, row, -1)))
        free[j] = False
        hit += row[j]
    return float(hit / m.sum()) if m.size else 0.0


def concentration(labels: DataFrame, label: str = "label") -> DataFrame:
    """One row (tau, monopolised): the share of the two largest clusters; monopolised from 0.9."""
    ranked = sorted_sizes(labels, label)
    tau = F.sum(F.when(F.col("rank") <= 2, F.col("size")).otherwise(0)) / F.sum("size")
    return ranked.agg(tau.alias("tau")).select("tau", (F.col("tau") >= 0.9).alias("monopolised"))


def silhouette_pearson(points: DataFrame, d: int, label: str) -> DataFrame:
    """(point_id, s): silhouette under Pearson distance, linear in the points.

    The mean distance of a point to a cluster is 1 - z.mean(z) over unit forms, so it needs the sum of each cluster only.
    """
    unit = points.select("point_id", F.col(label).alias("l"), vec.center_normalize("features").alias("z"))
    sums = unit.groupBy("l").agg(sum_vector(d, "z").alias("zs"), F.count("*").alias("n"))
    model = F.broadcast(sums.agg(F.collect_list(F.struct("l", "zs", "n")).alias("model")))  # a row per cluster
    both = unit.crossJoin(model)
    far = F.transform("model", lambda m: F.struct(m["l"].alias("l"), m["n"].alias("n"), (m["n"] - vec.dot(F.col("z"), m["zs"])).alias("s")))
    own = F.filter("far", lambda m: m["l"] == F.col("l"))[0]
    self_dist = 1.0 - vec.dot(F.col("z"), F.col("z"))
    scored = both.select("point_id", "l", "z", far.alias("far")).select(
        "point_id",
        own["n"].alias("n"),
        F.try_divide(own["s"] - self_dist, own["n"] - 1).alias("a"),
        F.array_min(F.transform(F.filter("far", lambda m: m["l"] != F.col("l")), lambda m: m["s"] / m["n"])).alias("b"),
    )
    return scored.select("point_id", F.when(F.col("n") <= 1, 0.0).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))).alias("s"))


#: Points of a block; a task holds two blocks, and the distances of STRIP points to one of them.
BLOCK, STRIP = 4096, 512


def silhouette_euclidean(points: DataFrame, label: str) -> DataFrame:
    """(point_id, s): silhouette of every point against all points.

    Quadratic by the nature of the measure: points are packed in blocks by hash of the id, every block meets
    every block, and a sum of distances per cluster leaves a task for each point. 0 for clusters of one point,
    null where there is one cluster only; take ``sampling.stratified`` first where all pairs are too many.
    """
    spark = points.sparkSession
    ship(spark)
    rows = points.select("point_id", F.col(label).alias("l"), "features")
    sizes = sorted(((r["l"], r["n"]) for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()), key=lambda r: (r[0] is not None, r[0]))  # a row per cluster
    if not sizes:
        return spark.createDataFrame([], rows.select("point_id", F.lit(0.0).alias("s")).schema)
    k, blocks = len(sizes), -(-sum(n for _, n in sizes) // BLOCK)
    codes = spark.createDataFrame([(v, i) for i, (v, _) in enumerate(sizes)], f"l {rows.schema['l'].dataType.simpleString()}, at int")
    coded = rows.alias("r").join(codes.alias("c"), F.col("r.l").eqNullSafe(F.col("c.l"))).select("point_id", "features", "at")
    packed = coded.groupBy(F.pmod(F.xxhash64("point_id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("point_id", "at", "features")).alias("p"))
    packed = durable(packed.select("block", F.col("p.point_id").alias("ids"), F.col("p.at").alias("at"), F.flatten("p.features").alias("x")), "blocks")
    asked = packed.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"), "block", "ids", "at", "x")
    pairs = asked.join(packed.select(F.col("block").alias("other"), F.col("at").alias("other_at"), F.col("x").alias("other_x")), "other")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                x, y = np.asarray(r.x).reshape(len(r.ids), -1), np.asarray(r.other_x).reshape(len(r.other_at), -1)
                hot = np.eye(k)[np.asarray(r.other_at)]
                sums = np.empty((len(x), k))
                for i in range(0, len(x), STRIP):
                    far = kernel.distances(x[i : i + STRIP], y, "euclidean")
                    if r.block == r.other:
                        far[np.arange(len(far)), np.arange(i, i + len(far))] = 0.0
                    sums[i : i + STRIP] = far @ hot
                yield pd.DataFrame({"block": np.int32(r.block), "place": np.arange(len(x), dtype=np.int32), "point_id": r.ids, "at": r.at, "sums": list(sums)})

    id_type = rows.schema["point_id"].dataType.simpleString()
    parts = pairs.mapInPandas(run, f"block int, place int, point_id {id_type}, at int, sums array<double>")
    n = F.array(*[F.lit(float(c)) for _, c in sizes])
    near = parts.groupBy("block", "place", "point_id", "at").agg(sum_vector(k, "sums").alias("sums")).withColumn("n", n)
    others = F.transform("sums", lambda s, i: F.when(i != F.col("at"), s / F.get(F.col("n"), i)))
    own = F.get(F.col("n"), F.col("at"))
    scored = near.select("point_id", own.alias("own"), F.try_divide(F.get(F.col("sums"), F.col("at")), own - 1).alias("a"), F.array_min(others).alias("b"))
    return scored.select("point_id", F.when(F.col("own") <= 1, 0.0).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))).alias("s"))


def scatter(points: DataFrame, d: int, label: str, metric: str) -> tuple[DataFrame, DataFrame]:
    """(label, center, n, sigma, w): centres, sizes, mean and summed squared distance to the centre; and the points with centres."""
    centers = points.groupBy(F.col(label).alias("l")).agg(mean_vector(d).alias("center"), F.count("*").alias("n"))
    near = points.withColumn("l", F.col(label)).join(centers, "l").withColumn("dist", vec.distance("features", "center", metric))
    spread = near.groupBy("l").agg(F.avg("dist").alias("sigma"), F.sum(F.col("dist") * F.col("dist")).alias("w"))
    return centers.join(spread, "l"), near


def davies_bouldin(points: DataFrame, d: int, label: str, metric: str = "pearson") -> DataFrame:
    """One row ``db``: mean over clusters of the worst ratio of spreads to the distance of centres; a row per cluster pair."""
    s, _ = scatter(points, d, label, metric)
    a = s.select(F.col("l").alias("i"), F.col("center").alias("ci"), F.col("sigma").alias("si"))
    b = s.select(F.col("l").alias("j"), F.col("center").alias("cj"), F.col("sigma").alias("sj"))
    worst = a.join(F.broadcast(b), F.col("i") != F.col("j")).groupBy("i").agg(F.max(F.try_divide(F.col("si") + F.col("sj"), vec.distance("ci", "cj", metric))).alias("r"))
    return worst.agg(F.avg("r").alias("db"))


def calinski_harabasz(points: DataFrame, d: int, label: str, metric: str = "euclidean") -> DataFrame:
    """One row ``ch``: between over within scatter of squared distances, each by its degrees of freedom."""
    s, _ = scatter(points, d, label, metric)
    middle = points.agg(mean_vector(d).alias("m"))
    both = s.crossJoin(F.broadcast(middle))  # one row
    g = vec.distance("center", "m", metric)
    one = both.agg(F.sum(F.col("n") * g * g).alias("between"), F.sum("w").alias("within"), F.sum("n").alias("n"), F.count("*").alias("k"))
    return one.select(F.try_divide(F.try_divide("between", F.col("k") - 1), F.try_divide("within", F.col("n") - F.col("k"))).alias("ch"))


def size_difference(labels: DataFrame, a: str, b: str) -> DataFrame:
    """One row (diff, n, close): summed difference of the sorted cluster sizes of two labellings; close up to 0.2 n."""
    x, y = sorted_sizes(labels, a).withColumnRenamed("size", "x"), sorted_sizes(labels, b).withColumnRenamed("size", "y")
    j = x.join(y, "rank", "full").select(F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
    return j.agg(F.sum(F.abs(F.col("x") - F.col("y"))).alias("diff"), F.sum("x").alias("n")).select("diff", "n", (F.col("diff") <= 0.2 * F.col("n")).alias("close"))


def metric_correlations(runs: DataFrame, names: list[str], tau: str = "tau", flag: str = "sc", cut: float = 0.2) -> DataFrame:
    """One row: correlation of each validity metric with tau, and sensitivity and specificity of flag < cut for tau >= 0.9."""
    bad, called = F.col(tau) >= 0.9, F.col(flag) < cut
    rate = lambda hit, of: F.try_divide(F.sum(F.when(hit, 1.0).otherwise(0.0)), F.sum(F.when(of, 1.0).otherwise(0.0)))
    return runs.agg(*[F.corr(n, tau).alias(f"corr_{n}") for n in names], rate(bad & called, bad).alias("sensitivity"), rate(~bad & ~called, ~bad).alias("specificity"))

