"""The pipeline's stages on planted documents, on strange rows and on nothing."""

import hashlib
import random

import pytest

import __spark_entry__
import corpus_pipeline
from shoal.llm import bpe
from shoal.runtime import durable

SF = "/root/testdata/sf0.001"


def chained(spark, docs, upto=None):
    for _, stage in corpus_pipeline.STAGES[:upto]:
        docs = durable(stage(spark, docs, SF), "stage")
    return docs


def planted(spark):
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("the in er an ti on re st ou ly".split()) for _ in range(rng.randint(1, 4))) for _ in range(n))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    base = prose(300)
    near = base.split()
    near[17] = "changed"
    rows = [
        (0, prose(200)), (1, base), (2, base), (3, " ".join(near)), (4, f"{prose(60)} {item} {prose(60)}"), (5, f"{prose(50)} token = \"7f5790b897549d620aedfc0705a565f96e3741e8\" {prose(50)}"),
        (6, "12345 67890"), (7, None), (8, ""), (None, prose(80)), (9, prose(90)), (9, prose(95)),
    ]
    return spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_do_their_work(spark):
    docs = planted(spark)
    kept = chained(spark, docs, 4)
    assert kept.columns == corpus_pipeline.COLUMNS
    rows = kept.collect()
    assert sorted((r["doc_id"] for r in rows), key=str) == [0, 1, 5, 9, 9, None]
    five = next(r for r in rows if r["doc_id"] == 5)
    assert "[SECRET]" in five["text"] and "7f5790" not in five["text"] and five["n_chars"] == len(five["text"])
    out = corpus_pipeline.tokens(spark, kept, SF)
    back = {r["text"] for r in bpe.decode_ids(out).collect()}
    assert back == {r["text"] for r in rows}
    digest = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
    assert sorted(r["decoded_sha256"] for r in out.collect()) == sorted(digest(r["text"]) for r in rows)


def test_repeated_rows_stay_once(spark):
    docs = planted(spark)
    twice = docs.unionByName(docs)
    assert chained(spark, twice, 2).count() == chained(spark, docs, 2).count()


def test_texts_of_no_learned_language_go(spark):
    strange = ["Все люди рождаются свободными и равными", "人人生而自由在尊严和权利上一律平等", "bcdfg hjklm npqrs tvwxz bcdgf hkjlm nprqs" * 5]
    docs = planted(spark).unionByName(spark.createDataFrame([(100 + i, t, None, "src", len(t)) for i, t in enumerate(strange)], "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF).collect()}
    assert not kept & {100, 101, 102, 6, 7, 8} and {0, 1, 2, 3, 4, 5, 9, None} <= kept


def test_many_keys_are_joined_without_a_broadcast(spark, monkeypatch):
    docs = planted(spark)
    want = sorted(map(str, chained(spark, docs, 3).collect()))
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_BYTES", -1)
    assert sorted(map(str, chained(spark, docs, 3).collect())) == want


def test_stages_on_strange_rows(spark, strange):
    """Every stage takes nulls, empty and long texts, repeated rows and columns of other names."""
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, strange, SF)
        assert got.columns == (corpus_pipeline.COLUMNS if name != "tokens" else ["doc_id", "n_tokens", "ids", "decoded_sha256"])
        rows = got.collect()
        if name == "language":
            assert {r["doc_id"] for r in rows} <= {None, 4, 5, 6, 7, 8}
        else:
            assert len(rows) == (6 if name == "near_copies" else 12)


def test_nothing_gives_nothing(spark):
    assert chained(spark, planted(spark).limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"))
def test_registered_queries_run(spark, name):
    df = __spark_entry__.queries()[name](spark, SF)
    n = df.count()
    documents = spark.read.parquet(f"{SF}/documents.parquet").count()
    if name.split("_")[0] in ("op1", "op4", "op5", "op6", "op8", "op10"):
        assert n == documents


def test_near_copies_are_those_of_similarity(spark):
    rng = random.Random(12)
    rows = []
    for changes in (4, 5) * 8:  # of 200 shingles each change takes five: similarity 0.818 and 0.778
        base = [f"w{rng.randrange(5000)}" for _ in range(204)]
        other = list(base)
        for c in range(changes):
            other[10 + c * 20] = f"new{rng.randrange(10**6)}"
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, SF).collect()}
    assert kept == {i for i in range(32) if i % 4 != 1}


def test_executors_give_their_heap_back(spark):
    from shoal.runtime import shrink

    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    spark.range(0, 3_000_000, 1, 4).selectExpr("collect_list(id) AS a").selectExpr("size(a)").collect()
    shrink(spark)
    used, held = runtime.totalMemory() - runtime.freeMemory(), runtime.totalMemory()
    assert held < max(4 * used, 400 << 20)
