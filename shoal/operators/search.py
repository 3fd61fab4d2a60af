"""Nearest-neighbour, ball and closest-cluster search against a stated, bounded set of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions import vec

#: Bytes of queries that one pass broadcasts; more are dealt over several passes.
QUERY_BYTES = 32 << 20


def query_slices(queries: DataFrame, d: int) -> list[DataFrame]:
    """The queries (qid, q) in slices whose size was checked, each to be broadcast in its own pass."""
    n = queries.count()
    slices = max(1, -(-n * (8 * d + 32) // QUERY_BYTES))
    if slices == 1:
        return [queries]
    return [queries.filter(F.pmod(F.xxhash64("qid"), F.lit(slices)) == s) for s in range(slices)]


def scored(points: DataFrame, queries: DataFrame, d: int, metric: str, within: float | None = None, strict: bool = True) -> DataFrame:
    """(qid, point_id, dist) of every point and query, or of those within a bound."""
    out = None
    for part in query_slices(queries, d):
        near = points.crossJoin(F.broadcast(part)).select("qid", "point_id", vec.distance("features", "q", metric, d).alias("dist"))
        if within is not None:
            near = near.filter(F.col("dist") < within if strict else F.col("dist") <= within)
        out = near if out is None else out.unionByName(near)
    return out


def knn(points: DataFrame, queries: DataFrame, d: int, k: int, metric: str = "euclidean", bound: float | None = None) -> DataFrame:
    """(qid, rank, point_id, dist): up to ``k`` nearest per query, nearer than ``bound``; ties to the smaller id."""
    order = Window.partitionBy("qid").orderBy("dist", "point_id")
    ranked = scored(points, queries, d, metric, bound).withColumn("r", F.row_number().over(order))
    return ranked.filter(F.col("r") <= k).select("qid", F.col("r").cast("long").alias("rank"), "point_id", "dist")


def nearest(points: DataFrame, queries: DataFrame, d: int, metric: str = "euclidean") -> DataFrame:
    """(qid, point_id, dist): the nearest point per query, by partial minima only."""
    best = scored(points, queries, d, metric).groupBy("qid").agg(F.min(F.struct("dist", "point_id")).alias("b"))
    return best.select("qid", F.col("b.point_id").alias("point_id"), F.col("b.dist").alias("dist"))


def ball(points: DataFrame, queries: DataFrame, d: int, radius: float, metric: str = "euclidean") -> DataFrame:
    """(qid, point_id, dist): all points at most ``radius`` away."""
    return scored(points, queries, d, metric, radius, strict=False)


def ball_by_grid(points: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """``ball`` in the plane for any number of queries: an equi-join on cells as wide as the radius.

    A query meets its own and the eight cells around it, so nothing is broadcast and no pair is made twice.
    """
    cell = lambda c: [F.floor(F.col(c)[i] / radius).alias(f"g{i}") for i in (0, 1)]
    dealt = points.select("point_id", "features", *cell("features"))
    steps = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    asked = (
        queries.select("qid", "q", *[g.alias(f"b{i}") for i, g in enumerate(cell("q"))])
        .withColumn("s0", F.explode(steps))
        .withColumn("s1", F.explode(steps))
        .select("qid", "q", (F.col("b0") + F.col("s0")).alias("g0"), (F.col("b1") + F.col("s1")).alias("g1"))
    )
    near = dealt.join(asked, ["g0", "g1"]).select("qid", "point_id", vec.euclidean("features", "q", 2).alias("dist"))
    return near.filter(F.col("dist") <= radius)


def rep_pairs(reps: DataFrame, metric: str) -> DataFrame:
    """(a, b, dist) between clusters of a table of representatives (cluster_id, rep): k*c rows, so both sides are bounded."""
    left = reps.select(F.col("cluster_id").alias("a"), F.col("rep").alias("p"))
    right = reps.select(F.col("cluster_id").alias("b"), F.col("rep").alias("q"))
    pairs = left.join(F.broadcast(right), F.col("a") != F.col("b"))
    return pairs.groupBy("a", "b").agg(F.min(vec.distance("p", "q", metric)).alias("dist"))


def closest_clusters(reps: DataFrame, metric: str = "euclidean", threshold: float = vec.INF) -> DataFrame:
    """(cluster_id, closest, dist): for each cluster the nearest other one, nearer than ``threshold``; ties to the smaller id."""
    best = rep_pairs(reps, metric).filter(F.col("dist") < threshold).groupBy("a").agg(F.min(F.struct("dist", "b")).alias("m"))
    return best.select(F.col("a").alias("cluster_id"), F.col("m.b").alias("closest"), F.col("m.dist").alias("dist"))
