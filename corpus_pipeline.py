"""A training corpus from raw documents: language, near copies, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All
but the last return the columns of ``documents``; ``run`` chains them, with every
stage's rows written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm import bpe, decontam, langid, secrets, simhash
from shoal.runtime import durable, shrink, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose largest language holds less than this is no text of any language.
LEAST_LANGUAGE_SHARE = 0.34
#: Least Jaccard similarity of the five-word shingles of two near copies.
LEAST_COPY_SIMILARITY = 0.8
#: Pairs are held against it whose fingerprints lie within so many of 128 bits, and so many of the first 64.
COPY_BITS, COPY_FIRST_BITS = 34, 20


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``key``: id and hash of the text, never null, so that null and repeated ids don't mix texts up."""
    last = F.lit((1 << 63) - 1)
    return docs.withColumn("key", F.struct(F.coalesce("doc_id", last).alias("i"), F.xxhash64("text").alias("h")))


#: Bytes of keys that are broadcast to take documents out; beyond, the join is shuffled.
BROADCAST_BYTES = 32 << 20


def without(rows: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """``rows`` whose ``key`` is none of the ``n`` different ``keys``: texts stay where they are, unless the keys are many."""
    small = n * 24 <= BROADCAST_BYTES
    return rows.join(F.broadcast(keys) if small else keys, "key", "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that have a language.

    Null and empty texts, and texts without a letter, have none; nor has a text of which no learned
    language explains a third, whatever its length. Repeated rows and null ids are judged row by row; an
    empty table stays empty; columns beyond those of ``documents`` are dropped.
    """
    found = langid.identify(docs, langid.fit(docs), keep=("text", "lang", "source", "n_chars"))
    return found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SHARE)).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of every group of near copies; of repeated rows, one.

    A null id counts as the largest, so it stays only where its whole group has none; equal ids with
    different texts are different documents; null and empty texts are copies of each other. Only keys are
    shuffled to find the groups, and only those that go, or that are there repeatedly, come back to the texts.
    """
    rows = keyed(docs)
    groups = simhash.verified_groups(rows, shingle=5, least=LEAST_COPY_SIMILARITY, radius=COPY_BITS, first_radius=COPY_FIRST_BITS, id_col="key")
    verdicts = groups.groupBy("key").agg(F.count("*").alias("copies"), F.max(F.col("key") == F.col("component_id")).alias("stays"))
    verdicts = durable(verdicts.filter("copies > 1 or not stays"), "verdicts")
    gone, repeated = verdicts.filter("not stays").select("key"), verdicts.filter("stays").select("key")
    n_gone, n_repeated = gone.count(), repeated.count()
    once = without(rows, gone, n_gone)
    if not n_repeated:
        return once.select(*COLUMNS)
    first = once.join(repeated, "key", "left_semi").dropDuplicates(["key"])
    return without(once, repeated, n_repeated).unionByName(first).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark.

    Null and empty texts hold none and stay; repeated rows go or stay together; rows with a null id are told
    apart by their text; an empty table or benchmark changes nothing.
    """
    shrink(spark)
    rows = keyed(docs)
    leaks = decontam.find_leaks(rows, table(spark, sf_dir, "benchmark"), id_col="key")
    leaked = durable(leaks.select("key").distinct(), "leaked")
    return without(rows, leaked, leaked.count()).select(*COLUMNS)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts; all documents stay.

    ``n_chars`` counts the new text (null for a null text); equal texts are cleaned alike, whatever path
    they were found under; a text without a finding, null or empty, is as it was.
    """
    shrink(spark)
    found = durable(secrets.find_secrets(docs), "secrets")
    return secrets.redact(docs, found).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text that they decode to.

    A null text counts as empty and has no tokens; every row, repeated or of a null id, gives one row.
    """
    shrink(spark)
    encoded = bpe.encode_texts(docs, decoded=True)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("secret_redaction", secret_redaction),
    ("tokens", tokens),
]

#: SQL can express neither the mixture model, the fingerprints, the alignment, the forest nor the automaton.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = durable(docs, name)
    return docs
