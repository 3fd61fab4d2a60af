"""Probing finds every code in the radius; recall against brute force; odd vectors take no part."""

import dataclasses

import numpy as np

from shoal.llm import mih


def table(spark, x, extra=()):
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_pigeonhole_probing_is_complete():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 256, (600, 8), dtype=np.uint8)
    block = mih.Block(codes)
    for radius in (0, 3, 7, 8, 15, 21, 26, 64):
        for q in codes[:20] ^ np.uint8(5):
            want = np.flatnonzero(np.bitwise_count(codes ^ q).sum(axis=1) <= radius)
            assert np.array_equal(np.sort(block.within(q, radius)), want)


def test_recall_and_distances(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32)) + rng.integers(0, 5, (3000, 1))
    got = mih.nearest_neighbours(table(spark, x), k=10, every=50).toPandas()
    hits = []
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:10]
        g = g.sort_values("rank")
        assert np.allclose(g.score, d[g.vec_id], atol=0) and list(g["rank"]) == list(range(1, 11))
        hits.append(len(set(want) & set(g.vec_id)) / 10)
    assert len(hits) == 60 and np.mean(hits) >= 0.9


def brute(rows, every, k):
    """(query_id, rank, id, score), sorted: every candidate but the query's own row, missing components as 0."""
    longest = max((len(v) for _, v in rows), default=0)
    rows = [(i, np.array(list(v) + [0.0] * (longest - len(v)))) for i, v in rows]
    out = []
    for a, (qid, q) in enumerate(rows):
        if qid is not None and qid % every == 0:
            near = sorted((np.sqrt(((v - q) ** 2).sum()), i is None, i) if i is not None else (np.sqrt(((v - q) ** 2).sum()), True, 0) for b, (i, v) in enumerate(rows) if a != b)[:k]
            out += [(qid, rank, None if null else i, float(d)) for rank, (d, null, i) in enumerate(near, 1)]
    return sorted(out, key=str)


def test_repeated_and_null_ids_and_lengths_against_brute_force(spark, monkeypatch):
    """With all bits as the radius the search is exact; in blocks and slices of a few rows as well."""
    fit = mih.BinaryCodes.fit
    monkeypatch.setattr(mih.BinaryCodes, "fit", lambda *a: dataclasses.replace(fit(*a), radius=mih.BITS))
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (200, [0.0, 0.0]), (300, [nan, 1.0]), (400, [1.0, inf]), (500, [1.0, None]), (800, [])]
    rng = np.random.default_rng(2)
    good = [(i % 7, [float(a) for a in rng.integers(-2, 3, 4)]) for i in range(60)] + [(600, [1.0]), (None, [1.0, 2.0, 0.0, 1.0]), (0, [1.0, 0.0, 0.0, 1.0]), (0, [1.0, 0.0, 0.0, 1.0]), (None, [1.0, 0.0, 0.0, 1.0])]
    good = [(i, v) for i, v in good if any(v)]
    want = brute(good, 3, 5)
    for slice_bytes, block in ((16 << 20, 1 << 14), (300, 7)):
        monkeypatch.setattr(mih, "SLICE_BYTES", slice_bytes)
        monkeypatch.setattr(mih, "INDEX_BLOCK", block)
        got = mih.nearest_neighbours(spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").repartition(3), k=5, every=3, bits=64)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_columns_of_clashing_names(spark):
    rows = [(i, [float(i), 1.0], "x", 1, 2.0, 3, 4, 5) for i in range(30)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, v int, score double, rank int, q int, copies int")
    got = mih.nearest_neighbours(docs, k=3, every=10).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 1), (0, 2), (0, 3), (10, 9), (10, 11), (10, 8), (20, 19), (20, 21), (20, 18)]


def test_few_candidates(spark):
    assert mih.nearest_neighbours(table(spark, []), k=10).count() == 0
    assert mih.nearest_neighbours(table(spark, [(1.0, 2.0)]), k=10).count() == 0
    got = mih.nearest_neighbours(table(spark, [(1.0, 0.0)] * 3 + [(0.0, 1.0)]), k=10).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]


def test_nothing_is_shuffled_but_what_is_found(spark):
    plan = mih.nearest_neighbours(table(spark, np.eye(20) + 1), k=3, every=5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan
