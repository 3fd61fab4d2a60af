"""Fingerprints by definition, groups by brute force."""

import random
from pathlib import Path

import numpy as np
import pytest
import xxhash

from shoal.llm import graph, simhash


def by_definition(text, shingle):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), seed=42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", None, "a", "A b", "a b c", "a b c d  e\x0bf", "É é A", "x " * 300, "a b c d"])
def test_fingerprint(text):
    assert simhash.fingerprint(text, 3)[0] & (1 << 64) - 1 == by_definition(text, 3)


def brute(fps, ids, radius):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(ids))]


def mutated(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def test_groups_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "STRIP", 16)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(120)]
        texts += [" ".join(mutated(rng, base, n)) for n in (0, 0, 1, 1, 2, 3)]
    texts += ["", None, "   ", "solo", "solo"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = simhash.near_duplicate_groups(docs).orderBy("doc_id").collect()
    fps = [by_definition(t, 3) for t in texts]
    assert [r["f0"] & (1 << 64) - 1 for r in got] == fps
    assert [r["component_id"] for r in got] == brute(fps, list(range(len(texts))), 3)


def test_chains_of_fingerprints_are_followed(spark):
    fps = [0, 0b111, 0b111111, 0b111111111, 1 << 60 | (1 << 40) - 1]
    distinct = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "k long, f0 long")
    roots = {r["node"]: r["root"] for r in graph.connected_components(simhash.spanning_links(distinct, 3)).collect()}
    assert roots == {0: 0, 1: 0, 2: 0, 3: 0}


def test_a_large_group_gives_a_row_per_member():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, dtype=np.uint64)
    x = np.array([base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 64, 500)], dtype=np.uint64)[:, None]
    child, parent = simhash.forest(len(x), simhash.strip_links(x, None, 3, 3))
    assert len(child) == 499 and (parent == 0).all()


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {i: root(i) for i in parent}


def test_strange_rows(spark, strange):
    got = simhash.near_duplicate_groups(strange).collect()
    assert len(got) == strange.count()
    zero = [r for r in got if r["f0"] == 0]
    assert len(zero) == 5 and {r["component_id"] for r in zero} == {1}
    assert {r["component_id"] for r in got if r["doc_id"] in (4, 5)} == {4}
    assert [r["component_id"] for r in got if r["doc_id"] == 6] == [6, 6]
    assert simhash.near_duplicate_groups(strange.limit(0)).count() == 0
    assert simhash.verified_groups(strange.limit(0), 5, 0.8, 34, first_radius=20).count() == 0


def test_verified_groups_are_those_of_jaccard(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(16):
        base = [f"w{rng.randrange(5000)}" for _ in range(204)]
        for changes in (4, 5, 9):  # 200 shingles, five of them lost a change: Jaccard 0.818, 0.778, 0.633 to the first
            other = list(base)
            for c in range(changes):
                other[10 + c * 20] = f"new{rng.randrange(10**6)}"
            texts += [" ".join(base), " ".join(other)]
            base = [f"w{rng.randrange(5000)}" for _ in range(204)]
    texts += ["Solo word", "solo  word", None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.verified_groups(docs, 5, 0.8, 34, first_radius=20).collect()}
    sets = [{*simhash.shingles(t, 5)} for t in texts]
    alike = lambda i: sets[i] == sets[i - 1] or len(sets[i] & sets[i - 1]) / len(sets[i] | sets[i - 1]) >= 0.8
    assert got == {i: i - 1 if i % 2 and alike(i) else i for i in range(len(texts))}
    assert sum(map(alike, range(1, 96, 2))) == 16


def test_links_that_the_forest_leaves_out_are_verified(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(204)]
    rows = []
    for i in range(12):  # a star of texts that are alike in pairs only, whose candidate links form one component
        own = list(base)
        for c in range(6):
            own[5 + c * 30 + 2 * (i // 2)] = f"own{i // 2}x{c}"
        own[200 if i % 2 else 0] = f"last{i}"
        rows.append((i, " ".join(own)))
    got = simhash.verified_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 0.8, 64, first_radius=64)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: i - i % 2 for i in range(12)}


def test_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(2)
    for n in (0, 1, 4, 30, 300, 3000):
        for common in {n, -(-n * 8 // 9), n * 9 // 10}:
            both, a, b = (rng.integers(0, 1 << 63, size, dtype=np.uint64) for size in (common, n - common, n - common))
            a, b = np.sort(np.append(both, a)), np.sort(np.append(both, b))
            sizes = (np.array([len(a)]), np.array([len(b)]))
            sketches = (simhash.sketch(a)[None, :], simhash.sketch(b)[None, :])
            assert simhash.can_be_similar(*sizes, *sketches, 0.8)[0] or simhash.jaccard(a, b) < 0.8
    far = [np.sort(rng.integers(0, 1 << 63, 100, dtype=np.uint64)) for _ in range(2)]
    assert not simhash.can_be_similar(np.array([100]), np.array([100]), *(simhash.sketch(x)[None, :] for x in far), 0.8)[0]


def test_texts_of_one_hash_stay_apart(spark, monkeypatch):
    """Where two texts share the hash that names their class, another seed is taken."""
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five six"), (3, "four five six")], "doc_id long, text string")
    real = simhash.F.xxhash64

    def poor(*cols):
        seed = cols[-1]._jc.toString() if len(cols) == 2 and not isinstance(cols[-1], str) else ""
        return simhash.F.lit(5).cast("long") if seed == "42" else real(*cols)

    monkeypatch.setattr(simhash.F, "xxhash64", poor)
    got = {r["doc_id"]: r["component_id"] for r in simhash.verified_groups(docs, 5, 0.8, 34, first_radius=20).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def test_the_nearest_link_between_groups():
    groups = np.array([[1, 2], [1, 2], [1, 3], [1, 2], [1, 3]])
    apart, a, b = np.array([5, 3, 9, 3, 9]), np.array([10, 12, 7, 11, 7]), np.array([1, 1, 4, 9, 3])
    assert sorted(simhash.nearest_of(groups, apart, a, b)) == [3, 4]
    assert len(simhash.nearest_of(groups[:0], apart[:0], a[:0], b[:0])) == 0


def brute_jaccard(texts, shingle, least):
    sets = [{*simhash.shingles(t, shingle)} for t in texts]
    labels = np.arange(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if not (union := sets[i] | sets[j]) or len(sets[i] & sets[j]) / len(union) >= least:
                labels = simhash.merge_labels(labels, np.array([i]), np.array([j]))
    return dict(enumerate(labels.tolist()))


def test_verified_groups_against_brute_force(spark, monkeypatch):
    """Chains, stars and chance over several chunks and blocks, with a line that many texts share, texts without words and repeated texts."""
    monkeypatch.setattr(simhash, "CHUNK", 5)
    monkeypatch.setattr(simhash, "SET_BLOCK", 1)
    rng = random.Random(8)
    line = [f"line{i}" for i in range(12)]
    texts = ["", None, " \n", "one", "One", "one two"]
    for n in (3, 5, 8, 40, 120):
        for _ in range(3):
            base = [f"w{rng.randrange(5000)}" for _ in range(n)] + (line if rng.random() < 0.5 else [])
            for _ in range(8):
                texts.append(" ".join(mutated(rng, base, rng.randint(0, max(1, n // 25)))))
                if rng.random() < 0.3:
                    base = texts[-1].split()
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.verified_groups(docs, 5, 0.8, 128, first_radius=64).collect()}
    want = brute_jaccard(texts, 5, 0.8)
    assert got == want and 30 < len({*want.values()}) < len(texts) - 30


@pytest.fixture
def written(monkeypatch):
    """Most rows of the tables that ``durable`` has written, by tag."""
    rows, real = {}, simhash.durable

    def counted(df, tag):
        out = real(df, tag)
        rows[tag] = max(rows.get(tag, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "durable", counted)
    return rows


def test_a_group_that_is_not_alike_is_never_written_as_pairs(spark, written):
    """60 long texts of similarity 0.75, each pair of which must be compared: no table has a row for each pair."""
    rng = random.Random(10)
    base = [f"w{rng.randrange(5000)}" for _ in range(4000)]
    texts = []
    for i in range(60):
        own = list(base)
        for c in rng.sample(range(4000), 57):
            own[c] = f"own{i}x{c}"
        texts.append((i, " ".join(own)))
    got = simhash.verified_groups(spark.createDataFrame(texts, "doc_id long, text string"), 5, 0.8, 128, first_radius=64)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: i for i in range(60)}
    assert written["sets"] == 60
    assert max(n for tag, n in written.items() if tag not in ("first", "heads")) < 6 * 60  # these have shingles, at most so many as the texts


def test_shingles_of_texts_that_share_none_are_never_written(spark, monkeypatch):
    """Of texts that are like no other, keys alone are written: neither their shingles nor fingerprints."""
    n_bytes, columns, real = {}, {}, simhash.durable

    def measured(df, tag):
        out = real(df, tag)
        n_bytes[tag] = sum(p.stat().st_size for p in Path(out.shoal_path.removeprefix("file://")).rglob("*.parquet"))
        columns[tag] = out.columns
        return out

    monkeypatch.setattr(simhash, "durable", measured)
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(300)]
    texts.append("changed " + texts[7])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(4)
    got = simhash.verified_groups(docs, 5, 0.8, 34, first_radius=20)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: i if i < 300 else 7 for i in range(301)}
    assert sum(n_bytes.values()) < 300 * 400  # shingles alone take four bytes each
    assert [tag for tag, names in columns.items() if "f0" in names] == ["sets"]


@pytest.mark.parametrize("text", ["", None, " \n", "a", "A b", "a b c d", "a b c d  e\x0bf", "x " * 300, "a b c d e a b c d e a b c d e", "É é A ab a b"])
def test_rolled_hashes_tell_the_same_shingles_apart(text):
    others = ["a b c d e f", "A b c d", "ab c d e f", "x x x x x y", "a  b"]
    for other in [text, *others]:
        plain, rolled = ([make(t, 5) for t in (text, other)] for make in (simhash.shingle_set, simhash.rolled_set))
        assert [len(x) for x in plain] == [len(x) for x in rolled]
        assert len(np.intersect1d(*plain)) == len(np.intersect1d(*rolled))
        assert all((x[1:] > x[:-1]).all() for x in rolled)


def test_verified_groups_compare_no_text_with_all(spark, monkeypatch, written):
    def all_with_all(*_, **__):
        raise AssertionError("all fingerprints are compared with all")

    monkeypatch.setattr(simhash, "spanning_links", all_with_all)
    rng = random.Random(11)
    line = " ".join(f"line{i}" for i in range(12))
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(100)) + " " + line for _ in range(300)]
    texts.append("changed " + texts[7])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = simhash.verified_groups(docs, 5, 0.8, 34, first_radius=20)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: i if i < 300 else 7 for i in range(301)}
    assert written["sets"] == 2


def test_common_members_are_counted():
    rng = np.random.default_rng(6)
    left, right = ([np.unique(rng.integers(0, 300, n, dtype=np.uint64)) for n in sizes] for sizes in ((0, 5, 90), (1, 400, 0, 60)))
    assert simhash.common(left, right).tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]
