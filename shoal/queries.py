"""The registered queries of the library: each runs one operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.functions import vec
from shoal.operators import assign, evaluate, kernel, rfm, sampling, search, stats
from shoal.operators.points import dimension, embedding_points, part_points
from shoal.plans import base, distributed, scalable, sweep
from shoal.plans.config import ClusterConfig, ScalableConfig
from shoal.runtime import durable, ship, table
from shoal.sources import io

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def long_vectors(df: DataFrame, ids: list[str], v: Column) -> DataFrame:
    """(ids, i, x): a row per component, rounded."""
    return df.select(*ids, F.posexplode(v).alias("i", "x")).select(*ids, F.col("i").cast("long").alias("i"), r6("x").alias("x"))


def emb(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    e = embedding_points(spark, sf_dir)
    return e, dimension(e)


def with_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding beside the centroid of its label."""
    e, d = emb(spark, sf_dir)
    return e.join(stats.centroids(e, d), "true_label")


def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, q): the centroids of the labels as a stated query set."""
    e, d = emb(spark, sf_dir)
    return stats.centroids(e, d).select(F.col("true_label").cast("long").alias("qid"), F.col("mean").alias("q"))


def label_reps(spark: SparkSession, sf_dir: str, c: int = 2) -> DataFrame:
    """(cluster_id, rep): the c vectors of each label nearest to its centroid."""
    near = with_centroid(spark, sf_dir).withColumn("dist", F.round(vec.euclidean("features", "mean"), 9))
    rank = F.row_number().over(Window.partitionBy("true_label").orderBy("dist", "point_id"))
    return near.withColumn("r", rank).filter(F.col("r") <= c).select(F.col("true_label").alias("cluster_id"), F.col("features").alias("rep"))


def assigned(spark: SparkSession, sf_dir: str, metric: str = "euclidean") -> DataFrame:
    """(point_id, true_label, features, label): each embedding with the label of the nearest label centroid."""
    e, _ = emb(spark, sf_dir)
    q = label_queries(spark, sf_dir).select(F.col("qid").alias("label"), F.col("q").alias("rep"))
    reps, labels = assign.collect_reps(q)
    return assign.nearest_rep(e, reps, labels, metric, keep=("true_label", "features"))


# vectors


@query
def dist_euclidean(spark, sf_dir):
    return with_centroid(spark, sf_dir).select("point_id", r6(vec.euclidean("features", "mean")).alias("dist"))


@query
def dist_sq_euclidean(spark, sf_dir):
    return with_centroid(spark, sf_dir).select("point_id", r6(vec.sq_euclidean("features", "mean")).alias("dist"))


@query
def dist_pearson(spark, sf_dir):
    return with_centroid(spark, sf_dir).select("point_id", r6(vec.pearson("features", "mean")).alias("dist"))


@query
def dist_pearson_lowdim(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    mean = F.broadcast(c.agg(F.avg("c_acctbal").alias("m")))  # one row
    p, q = F.array("c_acctbal"), F.array("m")
    return c.crossJoin(mean).select("c_custkey", r6(vec.pearson(p, q)).alias("dist"))


def parts_and_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = part_points(spark, sf_dir)
    return p.crossJoin(F.broadcast(stats.centroid(p, 2).select("mean")))  # one row


def pair_query(name: str, make: Callable[[], Column]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = parts_and_mean(spark, sf_dir).select("point_id", make().alias("v"))
        return rows.select("point_id", r6(F.col("v")[0]).alias("x"), r6(F.col("v")[1]).alias("y"))

    run.__name__ = name
    query(run)


pair_query("vec_add", lambda: vec.add("features", "mean"))
pair_query("vec_sub", lambda: vec.sub("features", "mean"))
pair_query("vec_scale", lambda: vec.scale("features", 2.5))
pair_query("vec_shrink", lambda: vec.shrink("features", "mean", 0.3))
pair_query("vec_unshrink", lambda: vec.unshrink("features", "mean", 0.3))


@query
def vec_norm(spark, sf_dir):
    return part_points(spark, sf_dir).select("point_id", r6(vec.norm("features", 2)).alias("norm"))


@query
def vec_center_normalize(spark, sf_dir):
    return long_vectors(emb(spark, sf_dir)[0], ["point_id"], vec.center_normalize("features"))


@query
def dist_point_to_set(spark, sf_dir):
    e, _ = emb(spark, sf_dir)
    reps = label_reps(spark, sf_dir).agg(F.collect_list("rep").alias("reps"))  # two a label
    return e.crossJoin(F.broadcast(reps)).select("point_id", r6(vec.to_set("features", "reps")).alias("dist"))


# aggregations


@query
def centroid_global(spark, sf_dir):
    e, d = emb(spark, sf_dir)
    return long_vectors(stats.centroid(e, d), ["n"], F.col("mean"))


@query
def centroid_by_label(spark, sf_dir):
    e, d = emb(spark, sf_dir)
    return long_vectors(stats.centroids(e, d), ["true_label", "n"], F.col("mean"))


@query
def centroid_weighted_merge(spark, sf_dir):
    e, d = emb(spark, sf_dir)
    halves = stats.centroids(e, d).withColumn("half", F.col("true_label") % 2)
    return long_vectors(stats.weighted_merge(halves, d, "half"), ["half", "n"], F.col("mean"))


@query
def medoid_by_label(spark, sf_dir):
    e, d = emb(spark, sf_dir)
    return stats.pearson_medoids(e, d).select("true_label", "medoid_id", r6("total").alias("total"))


@query
def standardize_features(spark, sf_dir):
    p = part_points(spark, sf_dir)
    return stats.standardize(p, 2).select("point_id", r6(F.col("features")[0]).alias("x"), r6(F.col("features")[1]).alias("y"))


@query
def cluster_sizes(spark, sf_dir):
    return stats.cluster_sizes(assigned(spark, sf_dir))


@query
def cluster_sizes_sorted(spark, sf_dir):
    return stats.sorted_sizes(assigned(spark, sf_dir))


@query
def cluster_statistics(spark, sf_dir):
    return stats.cluster_statistics(assigned(spark, sf_dir)).select("label", "size", r6("pct").alias("pct"), "singleton")


@query
def contingency_table(spark, sf_dir):
    return stats.contingency(assigned(spark, sf_dir), "true_label", "label")


@query
def labels_from_membership(spark, sf_dir):
    members = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), F.col("c_mktsegment").alias("cluster_id"))
    return stats.labels_from_membership(members)


@query
def rfm_orders(spark, sf_dir):
    return rfm.rfm_orders(spark, sf_dir).select("point_id", "recency", "frequency", F.round("monetary", 2).alias("monetary"))


@query
def rfm_events(spark, sf_dir):
    return rfm.rfm_events(spark, sf_dir).select("point_id", F.round("recency", 3).alias("recency"), "frequency", F.round("monetary", 4).alias("monetary"))


@query
def rfm_log_transform(spark, sf_dir):
    return rfm.log_transformed(rfm.rfm_orders(spark, sf_dir)).select("point_id", "recency", "frequency", r6("log_m").alias("log_m"), r6("log_f").alias("log_f"))


@query
def rfm_feature_stats(spark, sf_dir):
    s = rfm.feature_stats(rfm.rfm_orders(spark, sf_dir), rfm.NAMES)
    return s.select("feature", *[F.round(c, 3).alias(c) for c in ("mean", "std", "skew", "min", "max")], "n")


@query
def feature_dominance_range(spark, sf_dir):
    return rfm.range_shares(rfm.rfm_orders(spark, sf_dir), rfm.NAMES).select("feature", r6("share").alias("share"), "dominant")


@query
def feature_variance_share(spark, sf_dir):
    return rfm.variance_shares(rfm.rfm_orders(spark, sf_dir), rfm.NAMES).select("feature", r6("raw_share").alias("raw_share"), r6("log_share").alias("log_share"))


# search


@query
def knn(spark, sf_dir):
    e, d = emb(spark, sf_dir)
    return search.knn(e, label_queries(spark, sf_dir), d, 5).select("qid", "rank", "point_id", r6("dist").alias("dist"))


@query
def knn_bounded(spark, sf_dir):
    e, d = emb(spark, sf_dir)
    return search.knn(e, label_queries(spark, sf_dir), d, 20, bound=0.97).select("qid", "rank", "point_id", r6("dist").alias("dist"))


@query
def knn_pearson(spark, sf_dir):
    e, d = emb(spark, sf_dir)
    return search.knn(e, label_queries(spark, sf_dir), d, 5, "pearson").select("qid", "rank", "point_id", r6("dist").alias("dist"))


@query
def nn1(spark, sf_dir):
    e, d = emb(spark, sf_dir)
    return search.nearest(e, label_queries(spark, sf_dir), d).select("qid", "point_id", r6("dist").alias("dist"))


@query
def ball_query(spark, sf_dir):
    e, d = emb(spark, sf_dir)
    return search.ball(e, label_queries(spark, sf_dir), d, 0.95).select("qid", "point_id", r6("dist").alias("dist"))


@query
def ball_query_grid(spark, sf_dir):
    points = part_points(spark, sf_dir)
    s = table(spark, sf_dir, "supplier")
    asked = s.select(F.col("s_suppkey").alias("qid"), F.array((F.col("s_suppkey") % 50).cast("double"), 900.0 + F.abs("s_acctbal") / 10).alias("q"))
    return search.ball_by_grid(points, asked, 5.0).select("qid", "point_id", r6("dist").alias("dist"))


@query
def initial_nn(spark, sf_dir):
    """The nearest other label centroid of each label: the first step of the merge loop over a bounded set."""
    reps = label_queries(spark, sf_dir).select(F.col("qid").alias("cluster_id"), F.col("q").alias("rep"))
    return search.closest_clusters(reps).select("cluster_id", "closest", r6("dist").alias("dist"))


@query
def cluster_distance_matrix(spark, sf_dir):
    return search.rep_pairs(label_reps(spark, sf_dir), "euclidean").select("a", "b", r6("dist").alias("dist"))


@query
def closest_cluster(spark, sf_dir):
    return search.closest_clusters(label_reps(spark, sf_dir), threshold=1.25).select("cluster_id", "closest", r6("dist").alias("dist"))


@query
def closest_cluster_brute(spark, sf_dir):
    return search.closest_clusters(label_reps(spark, sf_dir)).select("cluster_id", "closest", r6("dist").alias("dist"))


@query
def closest_cluster_pearson(spark, sf_dir):
    return search.closest_clusters(label_reps(spark, sf_dir), "pearson").select("cluster_id", "closest", r6("dist").alias("dist"))


# samples


@query
def centroid_sample_fraction(spark, sf_dir):
    e, d = emb(spark, sf_dir)
    return sampling.keep_fraction(e, d, 10, 0.4).select("point_id", r6("dist").alias("dist"))


@query
def centroid_sample_n(spark, sf_dir):
    e, d = emb(spark, sf_dir)
    return sampling.nearest_to_centroid(e, d, 100).select("point_id", r6("dist").alias("dist"))


@query
def random_sample_n(spark, sf_dir):
    return sampling.random_sample(embedding_points(spark, sf_dir), 100, seed=42).select("point_id")


@query
def sample_size_auto(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").count()
    return spark.createDataFrame([(n, ScalableConfig(sample_size_auto=True).points_sampled(n))], "n long, sampled long")


@query
def sample_size_modes(spark, sf_dir):
    n = table(spark, sf_dir, "orders").count()
    rows = [(m, n, ScalableConfig(sample_size=v).points_sampled(n)) for m, v in (("fraction", 0.1), ("small_fraction", 0.001), ("number", 700.0), ("small_number", 100.0))]
    return spark.createDataFrame(rows, "mode string, n long, sampled long")


@query
def partition_sample(spark, sf_dir):
    e, d = emb(spark, sf_dir)
    sample = sampling.nearest_to_centroid(e, d, 203)
    return sampling.in_blocks(sample, ["dist", "point_id"], 203, 5).select("point_id", "part")


@query
def partition_trim(spark, sf_dir):
    e, d = emb(spark, sf_dir)
    return sampling.trim_partitions(distributed.with_splits(e, 4), d, "part", 30).select("part", "point_id", r6("dist").alias("dist"))


@query
def partition_trim_fraction(spark, sf_dir):
    e, d = emb(spark, sf_dir)
    return sampling.trim_partitions_by_fraction(distributed.with_splits(e, 4), d, "part", 5, 0.3).select("part", "point_id", r6("dist").alias("dist"))


@query
def eliminate_outlier_clusters(spark, sf_dir):
    sizes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cluster_id")).agg(F.count("*").alias("size"))
    return sampling.eliminate_outliers(sizes, 20, 18)


@query
def stratified_sample(spark, sf_dir):
    return sampling.stratified(embedding_points(spark, sf_dir), "true_label", 100).select("point_id", "true_label")


# clustering


def rfm_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rfm.as_points(rfm.rfm_orders(spark, sf_dir))


def supplier_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in a clear group for every nation."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("point_id"), F.array(F.col("s_nationkey") * 1000.0, F.col("s_acctbal") / 10_000.0).alias("features"))


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("point_id"), F.array(F.col("c_nationkey") * 1000.0, F.col("c_acctbal") / 10_000.0).alias("features"))


def groups(points: DataFrame) -> int:
    return points.select(F.col("features")[0]).distinct().count()


@query
def agglo_separable(spark, sf_dir):
    points = supplier_points(spark, sf_dir)
    model = base.fit(points, ClusterConfig(k=groups(points), c=4))
    return stats.labels_from_membership(model.labels.withColumnRenamed("label", "cluster_id"))


@query
def scalable_separable(spark, sf_dir):
    points = customer_points(spark, sf_dir)
    k = groups(points)
    model = scalable.fit_scalable(points, ScalableConfig(k=k, c=4, sample_size=0.5, n_partitions=3, outlier_threshold=1))
    return stats.labels_from_membership(model.labels.withColumnRenamed("label", "cluster_id"))


@query
def distributed_separable(spark, sf_dir):
    points = customer_points(spark, sf_dir)
    model = distributed.fit_distributed(points, ClusterConfig(k=groups(points), c=4), splits=4, most=2000, reduce_factor=40)
    return stats.labels_from_membership(model.labels.withColumnRenamed("label", "cluster_id"))


@query
def agglo_euclidean(spark, sf_dir):
    return base.fit(embedding_points(spark, sf_dir), ClusterConfig(k=10)).labels


@query
def agglo_pearson(spark, sf_dir):
    return base.fit(embedding_points(spark, sf_dir), ClusterConfig(k=10, metric="pearson")).labels


@query
def agglo_pearson_medoid(spark, sf_dir):
    return base.standardized_fit(embedding_points(spark, sf_dir), ClusterConfig(k=10, metric="pearson", center="medoid")).labels


@query
def agglo_all_points(spark, sf_dir):
    return base.fit(embedding_points(spark, sf_dir), ClusterConfig(k=10, metric="pearson", candidates="all_points")).labels


@query
def agglo_sampled(spark, sf_dir):
    return base.fit(embedding_points(spark, sf_dir), ClusterConfig(k=10, keep_fraction=0.5)).labels


@query
def agglo_auto(spark, sf_dir):
    return scalable.fit_auto(rfm_points(spark, sf_dir), k=4).labels


@query
def scalable_euclidean(spark, sf_dir):
    return scalable.fit_scalable(rfm_points(spark, sf_dir), ScalableConfig(k=4, sample_size_auto=True)).labels


@query
def scalable_pearson(spark, sf_dir):
    return scalable.fit_scalable(rfm_points(spark, sf_dir), ScalableConfig(k=4, metric="pearson", sample_size_auto=True, centroid_sampling=True)).labels


@query
def partial_clusters(spark, sf_dir):
    return scalable.fit_partials(rfm_points(spark, sf_dir), ScalableConfig(k=4)).select("part", "partial_id", "n_points")


@query
def second_pass_members(spark, sf_dir):
    config = ScalableConfig(k=4)
    finals = scalable.merge_partials(durable(scalable.fit_partials(rfm_points(spark, sf_dir), config), "partials"), config)
    return finals.select("cluster_id", F.explode("members").alias("point_id"))


@query
def mr_map(spark, sf_dir):
    points = distributed.with_splits(rfm_points(spark, sf_dir), 8)
    return distributed.map_partials(points, ClusterConfig(k=4), 20, 500, 3).select("part", "partial_id", "n_points")


@query
def mr_reduce(spark, sf_dir):
    config = ClusterConfig(k=4, metric="pearson")
    partials = durable(distributed.map_partials(distributed.with_splits(rfm_points(spark, sf_dir), 8), config, 20, 500, 3).drop("members"), "mapped")
    return distributed.reduce_in_one_task(partials, config).select("cluster_id", "n_points")


@query
def mr_label(spark, sf_dir):
    return distributed.fit_distributed(rfm_points(spark, sf_dir), ClusterConfig(k=4, metric="pearson"), splits=8, most=500, reduce_factor=25).labels


@query
def representatives(spark, sf_dir):
    points = supplier_points(spark, sf_dir)
    reps = base.fit(points, ClusterConfig(k=groups(points), c=4)).representatives
    return reps.select("label", F.col("rep_idx").cast("long").alias("rep_idx"), r6(F.col("rep")[0]).alias("x"), r6(F.col("rep")[1]).alias("y"))


@query
def scattered_points(spark, sf_dir):
    """Three scattered parts of each brand."""
    p = part_points(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("point_id"), "p_brand"), "point_id")
    return sampling.scattered(p, "p_brand", 2, 3).select("p_brand", "place", "point_id")


@query
def merge_two_clusters(spark, sf_dir):
    """The merge of every two neighbouring labels' clusters: size and mean of the union."""
    e, d = emb(spark, sf_dir)
    ship(spark)
    frame = e.select((F.floor(F.col("true_label") / 2)).cast("int").alias("pair"), "true_label", "point_id", "features")

    def run(f):
        import numpy as np
        import pandas as pd

        f = f.sort_values(["true_label", "point_id"], kind="stable")
        x = np.array(f["features"].tolist(), dtype=float)
        sides = [np.flatnonzero((f["true_label"] == v).to_numpy()) for v in sorted(f["true_label"].unique())]
        clusters = [kernel.Cluster(s, x[s].mean(axis=0), x[s], x[s]) for s in sides]
        c = clusters[0] if len(clusters) == 1 else kernel.merged(x, clusters[0], clusters[1], 5, 0.3, "euclidean")
        return pd.DataFrame({"pair": [int(f["pair"].iloc[0])], "n": [len(c.members)], "mean_sum": [float(c.center.sum())]})

    return frame.groupBy("pair").applyInPandas(run, "pair int, n long, mean_sum double").select("pair", "n", r6("mean_sum").alias("mean_sum"))


@query
def merge_summaries(spark, sf_dir):
    """The summaries of every four labels, joined one after the other: size and mean."""
    e, d = emb(spark, sf_dir)
    ship(spark)
    reps = label_reps(spark, sf_dir).groupBy(F.col("cluster_id").alias("true_label")).agg(F.array_sort(F.collect_list("rep")).alias("reps"))
    summaries = stats.centroids(e, d).join(reps, "true_label").withColumn("four", F.floor(F.col("true_label") / 4).cast("int"))

    def run(f):
        import functools

        import numpy as np
        import pandas as pd

        f = f.sort_values("true_label", kind="stable")
        parts = [(int(r.n), np.asarray(r.mean), np.stack(r.reps)) for r in f.itertuples(index=False)]
        n, mean, _ = functools.reduce(lambda a, b: distributed.merge_summaries(a, b, ClusterConfig(k=1)), parts)
        return pd.DataFrame({"four": [int(f["four"].iloc[0])], "n": [n], "mean": [list(mean)]})

    joined = summaries.groupBy("four").applyInPandas(run, "four int, n long, mean array<double>")  # four rows a group
    return long_vectors(joined, ["four", "n"], F.col("mean"))


@query
def majority_vote(spark, sf_dir):
    votes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("partial_id"), F.col("o_orderpriority").alias("label"))
    return distributed.majority_vote(votes)


@query
def predict_nearest_rep(spark, sf_dir):
    e, _ = emb(spark, sf_dir)
    reps, labels = assign.collect_reps(label_reps(spark, sf_dir).withColumnRenamed("cluster_id", "label"))
    return assign.nearest_rep(e, reps, labels).select("point_id", "label", r6("dist").alias("dist"))


@query
def predict_pearson(spark, sf_dir):
    e, _ = emb(spark, sf_dir)
    reps, labels = assign.collect_reps(label_reps(spark, sf_dir).withColumnRenamed("cluster_id", "label"))
    return assign.nearest_rep(e, reps, labels, "pearson").select("point_id", "label", r6("dist").alias("dist"))


@query
def predict_lineitem(spark, sf_dir):
    """All line items by the nearest of four fixed profiles of quantity, price, discount and tax: rows, mean price per label."""
    li = table(spark, sf_dir, "lineitem")
    points = li.select(F.lit(0).cast("long").alias("point_id"), F.array("l_quantity", F.col("l_extendedprice") / 1000.0, F.col("l_discount") * 100, F.col("l_tax") * 100).alias("features"), "l_extendedprice")
    import numpy as np

    reps = np.array([[10.5, 10.1, 2.3, 2.1], [40.2, 60.3, 2.2, 2.4], [10.7, 10.3, 7.9, 6.2], [40.4, 60.1, 8.3, 6.1]])
    out = assign.nearest_rep(points, reps, np.arange(4), keep=("l_extendedprice",))
    return out.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"), r6(F.avg("dist")).alias("mean_dist"))


@query
def cluster_serde_roundtrip(spark, sf_dir):
    e, d = emb(spark, sf_dir)
    reps = label_reps(spark, sf_dir).groupBy("cluster_id").agg(F.array_sort(F.collect_list("rep")).alias("reps"))
    clusters = stats.centroids(e, d).select(F.col("true_label").alias("cluster_id"), F.col("n").alias("n_points"), "mean").join(reps, "cluster_id")
    back = io.from_line(io.to_line(clusters))
    return back.select("cluster_id", "n_points", r6(vec.total("mean")).alias("mean_sum"), r6(vec.total(F.flatten("reps"))).alias("reps_sum"))


@query
def kmeans_baseline(spark, sf_dir):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = rfm_points(spark, sf_dir).select("point_id", array_to_vector("features").alias("features"))
    model = KMeans(k=4, seed=42, maxIter=10).fit(points)
    return model.transform(points).groupBy(F.col("prediction").alias("label")).agg(F.count("*").alias("size"))


@query
def pca_2d(spark, sf_dir):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    points = embedding_points(spark, sf_dir).select("point_id", array_to_vector("features").alias("features"))
    out = PCA(k=2, inputCol="features", outputCol="p").fit(points).transform(points)
    return out.select("point_id", vector_to_array("p").alias("p")).select("point_id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


# evaluation


@query
def ari(spark, sf_dir):
    return evaluate.adjusted_rand(assigned(spark, sf_dir), "true_label", "label").select(r6("ari").alias("ari"))


@query
def nmi(spark, sf_dir):
    return evaluate.normalized_mutual_information(assigned(spark, sf_dir), "true_label", "label").select(r6("nmi").alias("nmi"))


@query
def accuracy_greedy(spark, sf_dir):
    return spark.createDataFrame([(evaluate.accuracy_greedy(assigned(spark, sf_dir), "true_label", "label"),)], "accuracy double")


@query
def accuracy_majority(spark, sf_dir):
    return spark.createDataFrame([(evaluate.accuracy_majority(assigned(spark, sf_dir), "true_label", "label"),)], "accuracy double")


@query
def tau_concentration(spark, sf_dir):
    return evaluate.concentration(assigned(spark, sf_dir)).select(r6("tau").alias("tau"), "monopolised")


@query
def silhouette_pearson(spark, sf_dir):
    a = assigned(spark, sf_dir, "pearson")
    return evaluate.silhouette_pearson(a, dimension(a), "label").select("point_id", r6("s").alias("s"))


@query
def silhouette_euclidean(spark, sf_dir):
    return evaluate.silhouette_euclidean(assigned(spark, sf_dir), "label").select("point_id", r6("s").alias("s"))


@query
def davies_bouldin(spark, sf_dir):
    a = assigned(spark, sf_dir, "pearson")
    return evaluate.davies_bouldin(a, dimension(a), "label").select(r6("db").alias("db"))


@query
def calinski_harabasz(spark, sf_dir):
    a = assigned(spark, sf_dir)
    return evaluate.calinski_harabasz(a, dimension(a), "label").select(r6("ch").alias("ch"))


@query
def size_diff(spark, sf_dir):
    return evaluate.size_difference(assigned(spark, sf_dir), "true_label", "label")


@query
def metric_tau_corr(spark, sf_dir):
    """Correlations over one row per brand: tau from its part sizes, sc and db from its prices."""
    p = table(spark, sf_dir, "part")
    per = p.groupBy("p_brand").agg(
        (F.max("p_size") / 50.0 * 0.5 + F.avg("p_size") / 100.0 + 0.15).alias("tau"), ((F.avg("p_retailprice") % 7) / 20.0).alias("sc"), (F.stddev_pop("p_retailprice") / 100.0).alias("db")
    )
    out = evaluate.metric_correlations(per, ["sc", "db"])
    return out.select(*[r6(c).alias(c) for c in out.columns])


ALPHAS = [round(0.2 + 0.05 * i, 2) for i in range(11)]


@query
def sweep_alpha(spark, sf_dir):
    """The scalable form for every alpha; each setting labels all customers."""
    points = durable(rfm_points(spark, sf_dir), "rfm")
    return sweep.sweep_scalable(points, ScalableConfig(k=4, metric="pearson", sample_size_auto=True), ALPHAS)


@query
def sweep_fraction(spark, sf_dir):
    """The distributed form for every keep fraction; each setting labels all customers."""
    points = durable(rfm_points(spark, sf_dir), "rfm")
    return sweep.sweep_distributed(points, ClusterConfig(k=4, alpha=0.5, metric="pearson"), [round(0.1 * i, 1) for i in range(11)], splits=8, most=500, reduce_factor=25)


@query
def rfm_segments(spark, sf_dir):
    """The flagship: RFM of all customers, clustered in splits, labelled, and described by segment."""
    r = durable(rfm.rfm_orders(spark, sf_dir), "rfm")
    model = distributed.fit_distributed(rfm.as_points(r), ClusterConfig(k=4, metric="pearson"), splits=8, most=500, reduce_factor=25)
    return (
        r.join(model.labels, "point_id").groupBy("label")
        .agg(F.count("*").alias("customers"), F.avg("recency").alias("recency"), F.avg("frequency").alias("frequency"), F.avg("monetary").alias("monetary"))
    )
