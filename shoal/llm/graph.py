"""Connected components of an edge list, all of it in distributed joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.runtime import durable, release

#: Rounds after which a graph that still changes is reported as an error; chains shrink by half or better each round.
MOST_ROUNDS = 60


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node of the edge list the smallest node that it reaches.

    Alternating stars: in a round each node first links its larger neighbours, then
    its smaller ones, to the smallest node around it. Minima are pre-aggregated
    before they are shuffled, so a node with very many links costs one row per task;
    each round is written to the shared folder. Self loops, repeated and null edges
    are ignored; an empty edge list gives an empty result.
    """
    pairs = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    pairs = durable(pairs, "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        # minima are written before they are joined: then both sides of a join are dealt for it alone, and
        # adaptive execution can split the edges of a node that has very many
        # every neighbour v > u of u, and u itself, to the smallest neighbour of u
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = durable(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct(), "large")
        # every smaller neighbour of u, and u itself, to the smallest of them
        small = durable(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        hung = large.join(small, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = durable(hung.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "stars")
        release(pairs, least, large, small)
        pairs = stars
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = now
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
