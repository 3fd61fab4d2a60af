"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm import bpe, decontam, langid, license, mih, secrets, sharding, simhash, toxicity
from shoal.llm.texts import held_out
from shoal.runtime import table


def op1_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)


def op2_mih_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.nearest_neighbours(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op3_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(table(spark, sf_dir, "documents"))


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", F.size("mixture").alias("n_languages"))


def op7_secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "at", "finding", "probability")


def op8_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip_digests(table(spark, sf_dir, "documents"))


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minimax_shards": op1_minimax_shards,
        "op2_mih_neighbours": op2_mih_neighbours,
        "op3_license_notices": op3_license_notices,
        "op4_simhash_groups": op4_simhash_groups,
        "op5_token_counts": op5_token_counts,
        "op6_language_mixture": op6_language_mixture,
        "op7_secret_findings": op7_secret_findings,
        "op8_bpe_roundtrip": op8_bpe_roundtrip,
        "op9_benchmark_leaks": op9_benchmark_leaks,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_license_notices": license.scan_sql()}
