"""Recency, frequency and monetary value per customer, and statistics of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.runtime import table

NAMES = ["recency", "frequency", "monetary"]


def rfm_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days since the last order (counted from the last of all), number of orders, their sum; one shuffle on the customer."""
    orders = table(spark, sf_dir, "orders")
    per = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"), F.count("*").alias("frequency"), F.sum("o_totalprice").alias("monetary"))
    newest = per.agg(F.max("last").alias("newest"))
    return per.crossJoin(F.broadcast(newest)).select(  # one row
        F.col("o_custkey").alias("point_id"),
        F.datediff("newest", "last").cast("double").alias("recency"),
        F.col("frequency").cast("double").alias("frequency"),
        "monetary",
    )


def rfm_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds since the last event, number of events, sum of their values per user."""
    events = table(spark, sf_dir, "events")
    per = events.groupBy("user_id").agg(F.max("ts").alias("last"), F.count("*").alias("frequency"), F.sum("value").alias("monetary"))
    newest = per.agg(F.max("last").alias("newest"))
    seconds = F.unix_micros(F.col("newest").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))
    return per.crossJoin(F.broadcast(newest)).select(  # one row
        F.col("user_id").alias("point_id"), (seconds / 1e6).alias("recency"), F.col("frequency").cast("double").alias("frequency"), "monetary"
    )


def as_points(rfm: DataFrame) -> DataFrame:
    return rfm.select("point_id", F.array(*NAMES).alias("features"))


def log_transformed(rfm: DataFrame) -> DataFrame:
    """The two baselines: log1p of monetary alone, and of frequency and monetary."""
    return rfm.select("point_id", "recency", "frequency", F.log1p("monetary").alias("log_m"), F.log1p("frequency").alias("log_f"))


def long_form(df: DataFrame, names: list[str]) -> DataFrame:
    """One row per feature and aggregate set of a single-row table with columns ``<feature>_<stat>``."""
    stats = sorted({c.rsplit("__", 1)[1] for c in df.columns})
    rows = [F.struct(F.lit(n).alias("feature"), *[F.col(f"{n}__{s}").alias(s) for s in stats]) for n in names]
    return df.select(F.inline(F.array(*rows)))


def feature_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """(feature, mean, std, skew, min, max, n) with population moments, all in one pass."""
    aggs: list[Column] = []
    for n in names:
        x = F.col(n)
        aggs += [F.avg(x).alias(f"{n}__m1"), F.avg(x * x).alias(f"{n}__m2"), F.avg(x * x * x).alias(f"{n}__m3"), F.min(x).alias(f"{n}__lo"), F.max(x).alias(f"{n}__hi"), F.count(x).alias(f"{n}__n")]
    m = long_form(df.agg(*aggs), names)
    var = F.col("m2") - F.col("m1") * F.col("m1")
    third = F.col("m3") - 3 * F.col("m1") * F.col("m2") + 2 * F.col("m1") * F.col("m1") * F.col("m1")
    return m.select("feature", F.col("m1").alias("mean"), F.sqrt(var).alias("std"), F.try_divide(third, F.pow(var, F.lit(1.5))).alias("skew"), F.col("lo").alias("min"), F.col("hi").alias("max"), "n")


def range_shares(df: DataFrame, names: list[str]) -> DataFrame:
    """(feature, share, dominant): the share of each feature's squared range; dominant above 0.99."""
    m = long_form(df.agg(*[(F.max(n) - F.min(n)).alias(f"{n}__r") for n in names]), names)
    whole = df.agg(*[(F.max(n) - F.min(n)).alias(n) for n in names]).select(sum((F.col(n) * F.col(n) for n in names[1:]), F.col(names[0]) * F.col(names[0])).alias("whole"))
    share = F.try_divide(F.col("r") * F.col("r"), F.col("whole"))
    return m.crossJoin(F.broadcast(whole)).select("feature", share.alias("share"), (share > 0.99).alias("dominant"))  # one row


def variance_shares(df: DataFrame, names: list[str]) -> DataFrame:
    """(feature, raw_share, log_share): share of the summed population variances, before and after log1p."""
    one = df.agg(*[F.var_pop(n).alias(f"v_{n}") for n in names], *[F.var_pop(F.log1p(n)).alias(f"l_{n}") for n in names])
    v = sum((F.col(f"v_{n}") for n in names[1:]), F.col(f"v_{names[0]}"))
    w = sum((F.col(f"l_{n}") for n in names[1:]), F.col(f"l_{names[0]}"))
    rows = [F.struct(F.lit(n).alias("feature"), F.try_divide(F.col(f"v_{n}"), v).alias("raw_share"), F.try_divide(F.col(f"l_{n}"), w).alias("log_share")) for n in names]
    return one.select(F.inline(F.array(*rows)))
