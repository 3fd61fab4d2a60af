"""The largest shard is the smallest possible, equal texts stay together, slots have no gaps."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from shoal.llm import sharding


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, filled = (low + high) // 2, 1, 0
        for s in sizes:
            if filled + s > mid:
                used, filled = used + 1, 0
            filled += s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("hot", [0, 400])
@pytest.mark.parametrize("bits", [2, 10])
def test_against_brute_force(spark, monkeypatch, hot, bits):
    monkeypatch.setattr(sharding, "SPLIT_BITS", bits)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    rng = random.Random(hot)
    texts = ["x" * rng.randrange(1, 60) + str(rng.randrange(300)) for _ in range(500)] + ["the same long text " * 3] * hot + [None, "", "é"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sharding.shard_by_bytes(docs, 8).toPandas().sort_values("doc_id")
    assert got["size"].tolist() == [len((t or "").encode()) + 1 for t in texts]
    assert got["text_crc32"].tolist() == [zlib.crc32((t or "").encode()) for t in texts]
    assert got.assign(t=[t or "" for t in texts]).groupby("t")["shard"].nunique().max() == 1
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    order = docs.groupBy(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("s")).orderBy("h")
    assert got.groupby("shard")["size"].sum().max() == least_capacity([r["s"] for r in order.collect()], 8)
    assert got["shard"].between(0, 7).all() and got["grown_shard"].isna().all() and (got["law"] == "bytes").all()


def test_strange_rows(spark, strange):
    got = sharding.shard_by_bytes(strange, 8).collect()
    assert len(got) == strange.count()
    assert sharding.shard_by_bytes(strange.limit(0), 8).count() == 0
    assert {r["shard"] for r in sharding.shard_by_bytes(strange, 1).collect()} == {0}
