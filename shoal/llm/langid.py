"""Language identification of mixed documents.

A document's letter trigrams are taken as draws from a mixture of languages and of a
background, under which every trigram is as likely as any other. Expectation-maximisation
estimates the proportions; the set of languages is the one with the best penalised
likelihood, among the sets of the largest proportions. What no language of the set
explains falls to the background and lowers the score: texts of languages that were not
learned, and letter junk, score low.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is
every text where nothing could be learned; letters that no language knows give the
learned language that fits least badly, at a score near 0; very long texts are read
whole; repeated rows and null ids each give a row; rows without a language are
predicted but not learned from; an empty table gives an empty result; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.texts import held_out
from shoal.runtime import freeing, ship

#: Cells that trigrams are hashed to; documents per language, as expected, that a model is fitted on.
CELLS, SAMPLE_PER_LANGUAGE = 1 << 15, 2000
#: Steps of expectation-maximisation; least proportion of a candidate language; weight of the penalty.
STEPS, LEAST_SHARE, PENALTY = 12, 0.05, 3.0
UNDETERMINED = "und"
LETTERS = np.array([chr(c).isalpha() for c in range(0x10000)])


def trigram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Cells and counts of the trigrams of ``text``: letters in lower case, all else a blank; of trigrams around a blank only those between two letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = LETTERS[np.minimum(codes, 0xFFFF)]
    if (high := codes >= 0x10000).any():
        letter[high] = [chr(c).isalpha() for c in codes[high]]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.concatenate([[32], np.where(letter, codes, 32), [32]]).astype(np.uint64)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    keep = (b != 32) | ((a != 32) & (c != 32))
    mixed = ((a * np.uint64(0x1F1F1F1F) + b) * np.uint64(0x9E3779B1) + c) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.bincount((mixed[keep] >> np.uint64(49)).astype(np.int64), minlength=CELLS)
    cells = np.flatnonzero(counts)
    return cells, counts[cells]


@dataclass(frozen=True)
class LanguageModel:
    """Likelihoods of every cell in every language: ``p`` is (CELLS, languages)."""

    languages: list[str]
    p: np.ndarray

    @classmethod
    def fit(cls, counts: dict[str, np.ndarray]) -> LanguageModel:
        languages = sorted(counts)
        if not languages:
            return cls([], np.zeros((CELLS, 0)))
        table = np.stack([counts[x] for x in languages], axis=1) + 0.05
        return cls(languages, table / table.sum(axis=0))

    def proportions(self, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions of the columns of ``p`` and, last, of the background, by expectation-maximisation, and the log-likelihood they reach."""
        p = np.concatenate([p, np.full((len(p), 1), 1 / CELLS)], axis=1)
        share = np.full(p.shape[1], 1 / p.shape[1])
        total = n.sum()
        for _ in range(STEPS):
            share = share * (p.T @ (n / (p @ share))) / total
        return share, float(n @ np.log(p @ share))

    def predict(self, text: str | None) -> tuple[str, float, list[tuple[str, float]]]:
        """The language of the largest proportion, that proportion, and the selected mixture (the rest is background)."""
        cells, n = trigram_counts(text)
        if not len(cells) or not self.languages:
            return UNDETERMINED, 0.0, []
        p = self.p[cells]
        share = self.proportions(p, n)[0][:-1]
        order = np.argsort(-share, kind="stable")
        order = order[: max(1, int((share >= LEAST_SHARE).sum()))]
        best = None
        for k in range(1, len(order) + 1):
            own, likelihood = self.proportions(p[:, order[:k]], n)
            value = likelihood - PENALTY * k * np.log(n.sum() + 1)
            if best is None or value > best[0]:
                best = (value, order[:k], own[:-1])
        _, chosen, own = best
        mixture = sorted(((self.languages[i], float(x)) for i, x in zip(chosen, own, strict=True)), key=lambda m: (-m[1], m[0]))
        return mixture[0][0], min(1.0, mixture[0][1]), mixture


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from a sample of the rows that are not held out: about ``per_language`` of each language, chosen by a hash of the id."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel.fit({})
    million = 1_000_000
    limits = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(million, -(-per_language * million // n)))])
    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit(6)), F.lit(million)) < limits[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                cells, n = trigram_counts(batch.column(1)[k].as_py())
                own = sums.setdefault(batch.column(0)[k].as_py(), np.zeros(CELLS, np.int64))
                own[cells] += n
        if sums:
            blobs = [zlib.compress(x.tobytes(), 1) for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array(blobs, pa.binary())], names=["lang", "counts"])

    counts: dict[str, np.ndarray] = {}
    for r in sample.repartition(12).mapInArrow(freeing(count), "lang string, counts binary").collect():  # 12 tables a language
        own = counts.setdefault(r["lang"], np.zeros(CELLS, np.int64))
        own += np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return LanguageModel.fit(counts)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score, mixture, *keep) per row, in one narrow pass; the model is of fixed size and is broadcast."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [f"k{i}" for i in range(len(keep))]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        mixture_type = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for batch in batches:
            found = [own.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(batch.column(2 + i) for i in range(len(kept))),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([[{"lang": a, "share": s} for a, s in f[2]] for f in found], mixture_type),
                ],
                names=["id", *kept, "lang_pred", "score", "mixture"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)])
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"{c} {types[c]}" for c in ("id", *kept)] + ["lang_pred string", "score double", "mixture array<struct<lang:string,share:double>>"])
    out = rows.mapInArrow(freeing(predict), schema)
    return out.select(F.col("id").alias(id_col), "lang_pred", "score", "mixture", *[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)])
