"""Point tables: (point_id long, features array<double>[, true_label]) from input tables, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.runtime import table


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("point_id"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").alias("true_label"))


def part_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("point_id"), F.array(F.col("p_size").cast("double"), "p_retailprice").alias("features"))


def dimension(points: DataFrame) -> int:
    """The common length of the vectors; an error if they differ, and 0 without rows."""
    r = points.agg(F.min(F.size("features")).alias("a"), F.max(F.size("features")).alias("b")).first()
    if r["a"] is None:
        return 0
    if r["a"] != r["b"]:
        raise ValueError(f"vectors have {r['a']} to {r['b']} components")
    return r["a"]


def validate(points: DataFrame, k: int) -> tuple[int, int]:
    """(rows, dimension) in one pass; an error for null, ragged or non-finite vectors, or fewer than ``k`` rows."""
    bad: Column = F.col("point_id").isNull() | F.col("features").isNull() | F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    r = points.agg(
        F.count("*").alias("n"), F.min(F.size("features")).alias("a"), F.max(F.size("features")).alias("b"), F.max(bad.cast("int")).alias("bad")
    ).first()
    if r["n"] < k:
        raise ValueError(f"{r['n']} points cannot form {k} clusters")
    if r["bad"]:
        raise ValueError("point_id and features must not be null, nan or infinite")
    if r["a"] != r["b"]:
        raise ValueError(f"vectors have {r['a']} to {r['b']} components")
    return r["n"], r["a"]
