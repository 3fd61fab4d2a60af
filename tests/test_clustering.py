"""The merge kernel against a plain one, and the plans on groups that are clear."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shoal import oracle, queries
from shoal.operators import kernel
from shoal.plans import base, distributed, scalable, sweep
from shoal.plans.config import ClusterConfig, ScalableConfig, kept_points
from tests.test_contract import same
from tests.test_search_and_stats import points


def plain(x, k, c, alpha, metric):
    """Global-minimum merges with everything recomputed each time."""
    groups = [([i], x[i : i + 1], x[i : i + 1]) for i in range(len(x))]
    while len(groups) > k:
        best = min(((kernel.distances(a[2], b[2], metric).min(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j), key=lambda t: (round(t[0], 12), t[1], t[2]))
        _, i, j = best
        members = groups[i][0] + groups[j][0]
        mean = x[members].mean(axis=0)
        pool = kernel.distinct_rows(np.concatenate([groups[i][1], groups[j][1]]))
        if len(pool) < c:
            pool = x[sorted(members)]
        chosen = pool[kernel.scattered(pool, mean, c, metric)]
        groups[i] = (members, chosen, chosen + alpha * (mean - chosen))
        del groups[j]
    return {frozenset(g[0]) for g in groups}


@pytest.mark.parametrize("metric", ["euclidean", "pearson"])
@pytest.mark.parametrize(("k", "c", "alpha"), [(3, 5, 0.3), (4, 1, 0.5), (2, 10, 0.9)])
def test_kernel_against_a_plain_one(metric, k, c, alpha):
    rng = np.random.default_rng(k * 10 + c)
    x = rng.normal(size=(45, 5))
    got = kernel.agglomerate(x, k, c, alpha, metric)
    assert {frozenset(cl.members.tolist()) for cl in got.clusters} == plain(x, k, c, alpha, metric)


def partition(labels):
    out = {}
    for i, v in labels.items():
        out.setdefault(v, set()).add(i)
    return {frozenset(s) for s in out.values()}


def labels_of(model):
    return {r["point_id"]: r["label"] for r in model.labels.collect()}


def test_six_points(spark):
    p = points(spark, [(0, 0), (1, 0), (0.5, 0.5), (10, 10), (11, 10), (10.5, 10.5)])
    model = base.fit(p, ClusterConfig(k=2, c=2))
    assert partition(labels_of(model)) == {frozenset({0, 1, 2}), frozenset({3, 4, 5})}
    assert model.clusters.count() == 2 and model.representatives.count() == 4


def test_sine_and_cosine_by_correlation(spark):
    t = np.arange(10)
    x = [np.sin(t) + 0.1 * i for i in range(3)] + [np.cos(t) + 0.1 * i for i in range(3)]
    model = base.fit(points(spark, x), ClusterConfig(k=2, c=2, metric="pearson"))
    assert partition(labels_of(model)) == {frozenset({0, 1, 2}), frozenset({3, 4, 5})}


def blobs(n=60, seed=0):
    rng = np.random.default_rng(seed)
    centers = np.array([(0, 0), (10, 0), (5, 9)])
    return np.concatenate([rng.normal(c, 0.5, (n, 2)) for c in centers]), np.repeat(np.arange(3), n)


@pytest.mark.parametrize("alpha", [0.0, 0.3, 1.0])
def test_blobs_by_every_plan(spark, alpha):
    x, truth = blobs()
    p = points(spark, x, truth)
    want = partition(dict(enumerate(truth)))
    assert partition(labels_of(base.fit(p, ClusterConfig(k=3, alpha=alpha)))) == want
    assert partition(labels_of(scalable.fit_scalable(p, ScalableConfig(k=3, alpha=alpha, n_partitions=3)))) == want
    assert partition(labels_of(distributed.fit_distributed(p, ClusterConfig(k=3, alpha=alpha), splits=3, most=100, reduce_factor=10))) == want


def test_options_and_row_order(spark):
    x, truth = blobs(30, 4)
    p = points(spark, x, truth)
    want = partition(dict(enumerate(truth)))
    assert partition(labels_of(base.fit(p.repartition(5), ClusterConfig(k=3)))) == want
    assert partition(labels_of(base.standardized_fit(p, ClusterConfig(k=3)))) == want
    assert partition(labels_of(scalable.fit_auto(p, 3))) == want == partition(labels_of(scalable.fit_auto(p, 3, scalable=True)))
    for f in (0.0, 1.0):
        assert partition(labels_of(base.fit(p, ClusterConfig(k=3, keep_fraction=f)))) == want


def test_prediction(spark):
    x, _ = blobs(20, 1)
    model = base.fit(points(spark, x), ClusterConfig(k=3))
    got = model.predict(points(spark, [(0.5, 0.5), (10.5, 0.5)])).orderBy("point_id").collect()
    assert got[0]["label"] != got[1]["label"]


def test_sizes_of_samples():
    assert ScalableConfig(k=3, sample_size=0.5).points_sampled(300) == 300
    assert ScalableConfig(sample_size_auto=True).points_sampled(4314) == 792
    assert ScalableConfig(sample_size=0.1).points_sampled(10**6) == 15_000
    assert kept_points(100, 5, 0.0) == 100 and kept_points(100, 5, 0.01) == 5
    assert ClusterConfig(alpha=0.0).alpha == 0.1 and ClusterConfig(alpha=1.0).alpha == 0.9
    with pytest.raises(ValueError):
        ClusterConfig(metric="cosine")
    with pytest.raises(ValueError):
        ScalableConfig(n_partitions=0)


def test_limit_and_too_few_points(spark):
    x, _ = blobs(5)
    with pytest.raises(ValueError, match="scalable"):
        base.fit(points(spark, x), ClusterConfig(k=2), limit=10)
    with pytest.raises(ValueError, match="cannot form"):
        base.fit(points(spark, x[:2]), ClusterConfig(k=3))


def test_sweep_has_a_row_per_setting(spark):
    x, _ = blobs(20)
    got = sweep.sweep(points(spark, x), ClusterConfig(k=3), [(0.3, 0.0), (0.5, 0.5)]).collect()
    assert len(got) == 2 and all(r["n"] == 60 and r["n_clusters"] == 3 for r in got)


def test_majority_vote_prefers_the_lowest_label(spark):
    t = spark.createDataFrame([(0, 2), (0, 1), (1, 4)], "partial_id int, label int")
    assert {r["partial_id"]: r["label"] for r in distributed.majority_vote(t).collect()} == {0: 1, 1: 4}


def test_a_stream_is_labelled_like_a_table(spark, tmp_path):
    from shoal.streaming.label import write_labels

    x, _ = blobs(10)
    p = points(spark, x)
    model = base.fit(p, ClusterConfig(k=3))
    p.select("point_id", "features").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("point_id long, features array<double>").parquet(str(tmp_path / "in"))
    write_labels(stream, model, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = {r["point_id"]: r["label"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["point_id"]: r["label"] for r in model.predict(p).collect()}


def test_scattered_points_by_definition():
    rng = np.random.default_rng(3)
    for metric in ("euclidean", "pearson"):
        x = rng.normal(size=(40, 5))
        got = kernel.scattered(x, x.mean(axis=0), 6, metric)
        apart = lambda a, b: float(kernel.distances(a[None, :], b[None, :], metric)[0, 0])  # noqa: E731, B023
        want = [max(range(40), key=lambda i: apart(x[i], x.mean(axis=0)))]  # noqa: B023
        while len(want) < 6:
            want.append(max((i for i in range(40) if i not in want), key=lambda i: min(apart(x[i], x[j]) for j in want)))  # noqa: B023
        assert got.tolist() == want
    assert kernel.scattered(np.ones((4, 2)), np.ones(2), 3, "euclidean").tolist() == [0]


def test_two_summaries_as_one():
    config = ClusterConfig(k=1, c=2, alpha=0.5)
    n, mean, reps = distributed.merge_summaries((3, [0.0, 0.0], [[1.0, 0.0], [0.0, 1.0]]), (1, [8.0, 0.0], [[9.0, 0.0]]), config)
    assert n == 4 and mean.tolist() == [2.0, 0.0]
    # the farthest from the mean, then the farthest from it, each halfway to the mean
    assert reps.tolist() == [[5.5, 0.0], [1.0, 0.5]]


def test_the_scalable_form_honours_the_kept_share(spark):
    """Far points are left out of the sample, whatever the form, and are labelled all the same."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.1, (60, 2)), rng.normal(0, 0.1, (60, 2)) + [2.0, 0.0], rng.normal(0, 0.1, (10, 2)) + [500.0, 500.0]])
    table = points(spark, x)
    for model in (base.fit(table, ClusterConfig(k=2, c=3, keep_fraction=0.9)), scalable.fit_scalable(table, ScalableConfig(k=2, c=3, keep_fraction=0.9, sample_size=1.0, n_partitions=2, outlier_threshold=1))):
        assert max(abs(v) for r in model.representatives.collect() for v in r["rep"]) < 100
        assert model.labels.count() == len(x)


def test_the_base_form_refuses_what_it_cannot_hold(spark):
    table = points(spark, np.random.default_rng(5).normal(size=(50, 2)))
    with pytest.raises(ValueError, match="limit"):
        base.fit(table, ClusterConfig(k=2), limit=20)
    assert base.fit(table, ClusterConfig(k=2, keep_fraction=0.4), limit=20).labels.count() == 50


def sizes_of(model):
    return sorted((r["count"] for r in model.labels.groupBy("label").count().collect()), reverse=True)


def test_sweeps_give_what_single_fits_give(spark):
    rng = np.random.default_rng(21)
    p = points(spark, rng.normal(size=(400, 3)) + rng.integers(0, 3, (400, 1)) * 6)
    config = ScalableConfig(k=3, c=4, sample_size=0.5, n_partitions=2, outlier_threshold=1)
    for r in sweep.sweep_scalable(p, config, [0.2, 0.7]).collect():
        want = sizes_of(scalable.fit_scalable(p, config.with_(alpha=r["alpha"])))
        assert (r["n"], r["largest"]) == (400, want[0]) and r["tau"] == pytest.approx(sum(want[:2]) / 400)
    plan = ClusterConfig(k=3, c=4, alpha=0.5)
    for r in sweep.sweep_distributed(p, plan, [0.0, 0.6], splits=2, most=60, reduce_factor=5).collect():
        want = sizes_of(distributed.fit_distributed(p, plan.with_(keep_fraction=r["keep_fraction"]), splits=2, most=60, reduce_factor=5))
        assert (r["n"], r["largest"]) == (400, want[0]) and r["tau"] == pytest.approx(sum(want[:2]) / 400)


def by_definition(x, k, c, alpha, metric, center, candidates):
    """The closest pair of all, found anew for every merge, and merged from its members."""
    live = [kernel.Cluster(np.array([i]), x[i], x[i : i + 1], x[i : i + 1]) for i in range(len(x))]
    while len(live) > k:
        _, i, j = min((round(float(kernel.distances(a.reps, b.reps, metric).min()), 9), i, j) for i, a in enumerate(live) for j, b in enumerate(live) if i < j)
        live[i] = kernel.merged(x, live[i], live[j], c, alpha, metric, center, candidates)
        del live[j]
    return {frozenset(g.members.tolist()) for g in live}, sorted(g.center.tolist() for g in live)


@pytest.mark.parametrize(("metric", "center", "candidates"), [("euclidean", "mean", "representatives"), ("euclidean", "mean", "all_points"), ("pearson", "mean", "all_points"), ("pearson", "mean", "representatives")])
@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize("d", [3, 12])
def test_merging_without_a_table_by_definition(metric, center, candidates, repeated, d):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(48, d))
    if repeated and metric == "euclidean":
        x = x[rng.integers(0, 20, 48)]
    got = kernel.agglomerate(x, 4, 3, 0.3, metric, center, candidates)
    groups, centers = by_definition(x, 4, 3, 0.3, metric, center, candidates)
    assert {frozenset(g.members.tolist()) for g in got.clusters} == groups
    assert np.allclose(sorted(g.center.tolist() for g in got.clusters), centers)
    assert len(got.merges) == 44 and kernel.agglomerate(x, 4, 3, 0.3, metric, center, candidates).merges == got.merges


@pytest.mark.parametrize(("metric", "candidates"), [("euclidean", "representatives"), ("pearson", "representatives"), ("pearson", "all_points")])
@pytest.mark.parametrize("kind", ["close", "far_off", "repeated"])
def test_single_precision_decides_nothing(metric, candidates, kind):
    """Distances that differ by less than a pass can tell, lengths that hide them, equal and flat vectors."""
    rng = np.random.default_rng(17)
    x = rng.normal(size=(40, 12))
    if kind == "close":
        x = np.repeat(x[:8], 5, axis=0) + rng.normal(size=(40, 12)) * 1e-4
    elif kind == "far_off":
        x = x * 1e-3 + np.linspace(50.0, 90.0, 12)
    else:
        x = np.concatenate([x[rng.integers(0, 9, 36)], np.ones((4, 12))])
    got = kernel.agglomerate(x, 5, 3, 0.3, metric, "mean", candidates)
    live = [kernel.Cluster(np.array([i]), x[i], x[i : i + 1], x[i : i + 1]) for i in range(len(x))]
    name = list(range(len(x)))
    form = lambda a: kernel.unit_forms(a) if metric == "pearson" else a
    for u, v, apart in got.merges:  # each merge, of the pairs that there are then, is of the least distance
        i, j = name.index(u), name.index(v)
        each = {(a, b): min(kernel.exactly(form(live[a].reps), form(live[b].reps), metric)) for a in range(len(live)) for b in range(a + 1, len(live))}
        least = min(each.values())
        assert each[i, j] == pytest.approx(least, rel=1e-9, abs=1e-11) and apart == pytest.approx(least, rel=1e-9, abs=1e-11)
        live[i] = kernel.merged(x, live[i], live[j], 3, 0.3, metric, "mean", candidates)
        del live[j], name[j]
    assert {frozenset(g.members.tolist()) for g in live} == {frozenset(g.members.tolist()) for g in got.clusters}


def test_the_medoid_of_a_growing_cluster():
    """The bounds leave out no member: every centre is the member of the least summed distance."""
    x = np.random.default_rng(9).normal(size=(300, 6))
    for g in kernel.agglomerate(x, 3, 4, 0.3, "pearson", "medoid").clusters:
        total = kernel.distances(x[g.members], x[g.members], "pearson").sum(axis=1)
        assert kernel.distances(g.center[None, :], x[g.members], "pearson").sum() == pytest.approx(total.min())


def test_more_equal_points_than_clusters():
    x = np.repeat([[0.0, 0.0], [1.0, 1.0]], 5, axis=0)
    for k in (1, 2, 3, 7, 10, 12):
        got = kernel.agglomerate(x, k, 3, 0.3)
        assert len(got.clusters) == min(k, 10) and sum(len(g.members) for g in got.clusters) == 10
    assert [g.members.tolist() for g in kernel.agglomerate(x, 7, 3, 0.3).clusters] == [[0, 1, 2, 3], [4], [5], [6], [7], [8], [9]]


@pytest.fixture(scope="session")
def large(spark, tmp_path_factory):
    """Tables of 5,200 embeddings in ten clear directions and 5,200 suppliers of 25 nations: more than the base form once took."""
    rng = np.random.default_rng(31)
    at = str(tmp_path_factory.mktemp("large"))
    base_of = rng.normal(size=(10, 6)) * 10
    rows = [(i, [float(v) for v in base_of[i % 10] + rng.normal(size=6) * 0.01], i % 10) for i in range(5200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([(i, i % 25, float(rng.integers(-99999, 999999)) / 100) for i in range(5200)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{at}/supplier.parquet")
    return at


@pytest.mark.parametrize("name", ["agglo_all_points", "agglo_euclidean", "agglo_pearson", "agglo_pearson_medoid", "agglo_sampled", "agglo_separable", "representatives"])
def test_base_queries_over_more_than_5000_points(spark, large, name):
    from shoal import queries

    got = queries.REGISTRY[name](spark, large).collect()
    if name == "representatives":
        assert {r["label"] for r in got} == set(range(25)) and all(round(r["x"] / 1000) == r["label"] for r in got) and len(got) == 100
        return
    want = {frozenset(range(g, 5200, 25 if name == "agglo_separable" else 10)) for g in range(25 if name == "agglo_separable" else 10)}
    assert len(got) == 5200
    if name != "agglo_sampled":  # the nearer half to the centroid need not hold every group
        assert partition({r["point_id"]: r["label"] for r in got}) == want


@pytest.fixture(scope="session")
def repeated(spark, tmp_path_factory):
    """6,000 suppliers: those of sf0.01 sixty times, with shifted keys."""
    at = str(tmp_path_factory.mktemp("repeated"))
    one = spark.read.parquet("/root/testdata/sf0.01/supplier.parquet")
    copies = one.crossJoin(spark.range(60).withColumnRenamed("id", "copy")).withColumn("s_suppkey", F.col("s_suppkey") + F.col("copy") * 1000)
    copies.drop("copy").write.parquet(f"{at}/supplier.parquet")
    return at


def by_sql(at, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{at}/supplier.parquet/*.parquet'")
    return con.execute(sql).df()


def test_repeated_suppliers_against_sql(spark, repeated):
    got = queries.REGISTRY["agglo_separable"](spark, repeated).toPandas()
    same(got, by_sql(repeated, oracle.SQL["agglo_separable"]))


def test_representatives_of_repeated_suppliers(spark, repeated):
    """Of each nation, by its least key: both ends, moved by 0.3 towards its mean, are among up to four."""
    got = queries.REGISTRY["representatives"](spark, repeated).toPandas()
    want = by_sql(repeated, "SELECT s_nationkey * 1000.0 AS x, min(s_acctbal) / 1e4 AS low, max(s_acctbal) / 1e4 AS high, avg(s_acctbal) / 1e4 AS mean FROM supplier GROUP BY s_nationkey ORDER BY min(s_suppkey)")
    assert sorted(got["label"].unique()) == list(range(len(want)))
    for label, w in want.iterrows():
        own = got[got["label"] == label]
        assert len(own) <= 4 and (own["x"] - float(w["x"])).abs().max() < 1e-6
        assert [own["y"].min(), own["y"].max()] == pytest.approx([w["low"] + 0.3 * (w["mean"] - w["low"]), w["high"] + 0.3 * (w["mean"] - w["high"])], abs=2e-6)


def merged_to_one(y, c=4, alpha=0.3):
    """Representatives of points in a line, merged to one cluster from a table of all distances."""
    members, own, moved = [[i] for i in range(len(y))], [[v] for v in y], np.repeat(y[:, None], c, axis=1)
    table = np.abs(y[:, None] - y)
    np.fill_diagonal(table, np.inf)
    for _ in range(len(y) - 1):
        u, v = divmod(int(table.argmin()), len(y))  # the smaller slots first
        members[u] += members[v]
        mean = float(np.mean(y[members[u]]))
        pool = list(dict.fromkeys(own[u] + own[v]))
        if len(pool) < c:
            pool = list(dict.fromkeys(y[sorted(members[u])]))
        chosen = [max(pool, key=lambda p: abs(p - mean))]  # noqa: B023
        while len(chosen) < min(c, len(pool)):
            chosen.append(max((p for p in pool if p not in chosen), key=lambda p: min(abs(p - q) for q in chosen)))
        own[u], reps = chosen, [p + alpha * (mean - p) for p in chosen]
        moved[u] = reps + reps[-1:] * (c - len(reps))
        table[v] = table[:, v] = moved[v] = np.inf
        row = np.abs(moved[:, :, None] - moved[u]).min(axis=(1, 2))
        row[u] = np.inf
        table[u] = table[:, u] = row
    return reps


@pytest.mark.parametrize("kind", ["large", "repeated"])
def test_every_representative_over_5000_suppliers(spark, request, kind):
    """All rows of the query, in their order, are those of a plain loop over each nation."""
    at = request.getfixturevalue(kind)
    got = queries.REGISTRY["representatives"](spark, at).toPandas().sort_values(["label", "rep_idx"])
    points = by_sql(at, "SELECT s_nationkey AS nation, s_acctbal / 1e4 AS y FROM supplier ORDER BY s_suppkey")
    want = [(label, i, nation * 1000.0, y) for label, nation in enumerate(points["nation"].unique()) for i, y in enumerate(merged_to_one(points["y"][points["nation"] == nation].to_numpy()))]
    assert [tuple(r) for r in got[["label", "rep_idx", "x"]].to_numpy()] == [w[:3] for w in want]
    assert np.abs(got["y"].to_numpy() - [w[3] for w in want]).max() < 1e-6


def test_tight_groups_go_on_in_double_precision():
    """Where single precision can't tell distances apart, its bounds are given up, and the merges stay right."""
    rng = np.random.default_rng(31)
    x = np.repeat(rng.normal(size=(4, 6)) * 10, 150, axis=0) + rng.normal(size=(600, 6)) * 1e-3
    for candidates in ("representatives", "all_points"):
        work = kernel.Merging(x, np.ones(600, int), 3, 0.3, "pearson", "mean", candidates)
        while work.live > 4:
            assert work.merge()
        assert not work.single
        assert {frozenset(p.members.tolist()) for p in work.parts if p} == {frozenset(range(g, g + 150)) for g in range(0, 600, 150)}


def nations(n):
    """Different points in a line for each of 25 nations."""
    rng = np.random.default_rng(23)
    return np.stack([rng.integers(0, 25, n) * 1000.0, rng.uniform(-0.1, 1.0, n)], axis=1)


def test_sections_that_lie_apart_are_merged_on_their_own(monkeypatch):
    """No merge looks at the points of another nation."""
    sizes, x = [], nations(3000)
    made = kernel.Merging.__init__
    monkeypatch.setattr(kernel.Merging, "__init__", lambda self, x, *a: (sizes.append(len(x)), made(self, x, *a))[1])
    got = kernel.agglomerate(x, 25, 4, 0.3)
    assert {frozenset(c.members.tolist()) for c in got.clusters} == {frozenset(np.flatnonzero(x[:, 0] == v).tolist()) for v in np.unique(x[:, 0])}
    assert len(sizes) == 25 and max(sizes) < 250


@pytest.mark.parametrize("candidates", ["representatives", "all_points"])
@pytest.mark.parametrize("k", [1, 3, 25, 60])
def test_sections_change_no_merge(monkeypatch, k, candidates):
    """Every merge, its distance, and all representatives are those of one loop over all; below 25 clusters, sections are merged with each other."""
    x = np.concatenate([nations(400), np.round(nations(100), 1), [[500.0, 0.5], [24000.0, 900.0]]])
    got = kernel.agglomerate(x, k, 4, 0.3, candidates=candidates)
    assert len(kernel.apart(x)[0]) > 20
    monkeypatch.setattr(kernel, "apart", lambda x: ([np.arange(len(x))], np.inf))
    want = kernel.agglomerate(x, k, 4, 0.3, candidates=candidates)
    assert got.merges == want.merges and len(got.clusters) == len(want.clusters) == k
    for g, w in zip(got.clusters, want.clusters, strict=True):
        assert set(g.members) == set(w.members) and g.center.tolist() == w.center.tolist() and g.reps.tolist() == w.reps.tolist()
