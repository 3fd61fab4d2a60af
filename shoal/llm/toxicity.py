"""A toxicity classifier that is held back from leaning on identity terms.

Features are the distinct words of a whole text and the beginnings of its longer words. They are selected by the
likelihood ratio of their counts under either label; a logistic model is fitted to
them with a ridge penalty, and with the squared change of the log-odds when an identity
term of a labelled text is swapped for another of its kind: the features of the text
and of its swapped twin are both taken, words and beginnings alike. Templates that mention
each term neutrally are labelled neutral and swapped too, so that terms the corpus
lacks are covered.

Defined results: null and empty texts have no words and get the base score; very long
texts are read whole; repeated rows and null ids each give a row (a null id is held
out); rows without a label are scored but not learned from, and of several labels of one
document the highest counts; without any labelled row all scores are 0; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, fsum

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.llm.texts import held_out, normal
from shoal.runtime import durable, freeing, release, ship

#: Labelled documents that a model is fitted on, chosen by a hash of the id.
SAMPLE = 20_000
#: Cells that words are hashed to; least likelihood ratio and most words of the model.
CELLS, LEAST_RATIO, MOST_WORDS = 1 << 22, 24.0, 4096
#: Bytes of a beginning.
STEM = 5
#: Steps and rate of the fit; weights of the ridge and of the counterfactual penalty.
STEPS, RATE, RIDGE, FAIRNESS = 400, 0.15, 2e-4, 20.0

#: Identity terms by language and kind; a term is swapped for the next of its kind.
IDENTITY_TERMS = {
    "en gender": ["woman", "man", "transgender", "nonbinary", "girl", "boy"],
    "en genders": ["women", "men", "girls", "boys"],
    "en religion": ["muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"],
    "en religions": ["muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"],
    "en origin": ["african", "american", "asian", "european", "mexican", "chinese", "indian", "arab", "immigrant", "refugee"],
    "en origins": ["africans", "americans", "asians", "europeans", "mexicans", "indians", "arabs", "immigrants", "refugees"],
    "en colour": ["black", "white", "brown"],
    "en orientation": ["gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"],
    "en ability": ["deaf", "blind", "disabled", "autistic"],
    "en age": ["old", "young", "elderly", "teenage"],
    "de gender": ["frau", "mann", "mädchen", "junge"],
    "de genders": ["frauen", "männer"],
    "de religion": ["muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch", "katholisch"],
    "de religions": ["muslime", "christen", "juden", "hindus", "buddhisten", "katholiken"],
    "de origins": ["afrikaner", "amerikaner", "asiaten", "europäer", "türken", "araber", "deutsche", "ausländer", "flüchtlinge"],
    "de orientation": ["schwul", "lesbisch", "bisexuell", "heterosexuell"],
    "de ability": ["taub", "blind", "behindert", "autistisch"],
    "fr gender": ["femme", "homme", "fille", "garçon"],
    "fr genders": ["femmes", "hommes", "filles", "garçons"],
    "fr religion": ["musulman", "chrétien", "juif", "hindou", "bouddhiste", "catholique"],
    "fr religions": ["musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "catholiques"],
    "fr origins": ["africains", "américains", "asiatiques", "européens", "arabes", "immigrés", "réfugiés"],
    "fr orientation": ["homosexuel", "hétérosexuel", "bisexuel", "lesbienne"],
    "fr ability": ["sourd", "aveugle", "handicapé", "autiste"],
    "es gender": ["mujer", "hombre", "niña", "niño"],
    "es genders": ["mujeres", "hombres", "niñas", "niños"],
    "es religion": ["musulmán", "cristiano", "judío", "hindú", "budista", "católico"],
    "es religions": ["musulmanes", "cristianos", "judíos", "hindúes", "budistas", "católicos"],
    "es origins": ["africanos", "americanos", "asiáticos", "europeos", "mexicanos", "árabes", "inmigrantes", "refugiados"],
    "es orientation": ["homosexual", "heterosexual", "bisexual", "lesbiana"],
    "es ability": ["sordo", "ciego", "discapacitado", "autista"],
}
#: Neutral mentions of a term, by language.
TEMPLATES = {
    "en": ["i am a {} person", "my neighbour is {}", "the {} community met today", "a {} writer won the prize"],
    "de": ["mein nachbar ist {}", "heute traf sich die gemeinde {}", "viele {} wohnen in dieser stadt"],
    "fr": ["mon voisin est {}", "la communauté {} se réunit ce soir", "beaucoup de {} vivent dans cette ville"],
    "es": ["mi vecino es {}", "la comunidad {} se reunió hoy", "muchos {} viven en esta ciudad"],
}


def swaps() -> dict[bytes, bytes]:
    """Each identity term to the next one of its kind; a term of several kinds keeps its first."""
    out: dict[bytes, bytes] = {}
    for terms in IDENTITY_TERMS.values():
        for a, b in zip(terms, [*terms[1:], terms[0]], strict=True):
            out.setdefault(a.encode(), b.encode())
    return out


SWAPS = swaps()


def cell(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word) & (CELLS - 1)


def of_words(words: set[bytes]) -> set[int]:
    """The cells of ``words`` and, as ``^`` and five bytes, of the beginnings that stand for inflected words."""
    return {cell(w) for w in words | {b"^" + w[:STEM] for w in words if len(w) > STEM}}


def cells(text: str | None) -> set[int]:
    """The cells of all features of ``text``."""
    return of_words(set(normal(text).split()))


def counterfactuals(text: str | None) -> list[list[int]]:
    """For each identity term of ``text``, how its features change when the term is swapped: 1 + cell for each that comes, less than 0 for each that goes."""
    words = set(normal(text).split())
    out = []
    for term in sorted(words & SWAPS.keys()):
        before, after = of_words(words), of_words((words - {term}) | {SWAPS[term]})
        out.append([c + 1 for c in sorted(after - before)] + [-c - 1 for c in sorted(before - after)])
    return out


def neutral_mentions() -> list[str]:
    """Every template with every term of its language."""
    return [t.format(term) for kind, terms in IDENTITY_TERMS.items() for t in TEMPLATES[kind[:2]] for term in terms]


@dataclass(frozen=True)
class ToxicityModel:
    bias: float
    weights: dict[int, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        z = self.bias + fsum(self.weights.get(c, 0.0) for c in cells(text))
        return 1 / (1 + exp(-min(50.0, max(-50.0, z))))


def ratio(n1: Column, n0: Column, t1: int, t0: int) -> Column:
    """Twice the log-likelihood ratio of a word's presence depending on the label."""

    def part(k: Column, n: Column) -> Column:
        xlogx = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
        return xlogx(k) + xlogx(n - k) - xlogx(n)

    return 2 * (part(n1, F.lit(float(t1))) + part(n0, F.lit(float(t0))) - part(n1 + n0, F.lit(float(t1 + t0))))


def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of every member of ``rows``."""
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int64)


def fit_rows(rows: list[np.ndarray], label: np.ndarray, changes: list[np.ndarray], kept: list[int]) -> ToxicityModel:
    """Fit to the places in ``kept`` of each labelled text's features, and to the changes that swaps make to them.

    A change holds 1 + place for a feature that comes and less than 0 for one that goes.
    """
    place = {c: i for i, c in enumerate(kept)}
    known = lambda found: np.array([(1 if c > 0 else -1) * (1 + place[abs(c) - 1]) for c in found], np.int64)
    mentions = neutral_mentions()
    y = np.concatenate([label, np.zeros(len(mentions))])
    of, column = flat([*rows, *(np.array(sorted(place[c] for c in cells(t)), np.int64) for t in mentions)])
    # the changes of the corpus and those of the templates count alike, however many there are of each
    parts = [c for c in (changes, [known(x) for t in mentions for x in counterfactuals(t)]) if c]
    pair, signed = flat([x for p in parts for x in p])
    weight = np.repeat([1 / len(p) for p in parts], [len(p) for p in parts])
    at, sign = np.abs(signed) - 1, np.sign(signed)
    w, bias = np.zeros(len(kept)), float(np.log(label.sum() / (1 - label).sum()))
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(of, weights=w[column], minlength=len(y))
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(y)
        change = np.bincount(pair, weights=sign * w[at], minlength=len(weight)) * weight
        g = np.bincount(column, weights=error[of], minlength=len(kept)) + RIDGE * w / max(1, len(kept)) * 10
        g += 2 * FAIRNESS * np.bincount(at, weights=sign * change[pair], minlength=len(kept))
        g = np.append(g, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        # the rate falls to nothing, so that the penalty's stiff directions settle
        move = RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return ToxicityModel(float(bias), {c: float(w[i]) for c, i in place.items() if w[i]})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Learn from at most ``sample`` labelled documents that are not held out.

    Their features are counted where they lie; only the places of the chosen ones reach the driver.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter(~held_out("id") & F.col("label").isNotNull())
    known = known.groupBy("id").agg((F.max("label") > 0).cast("int").alias("label")).orderBy(F.xxhash64("id", F.lit(10)), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = rows.join(F.broadcast(known), "id").select("label", "text")  # at most ``sample`` narrow rows are broadcast

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            own = pa.array([sorted(cells(t)) for t in texts], pa.list_(pa.int32()))
            changed = pa.array([counterfactuals(t) for t in texts], pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0), own, changed], names=["label", "cells", "changes"])

    found = durable(chosen.mapInArrow(freeing(extract), "label int, cells array<int>, changes array<array<int>>"), "features")
    n, t1 = found.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    drawn = found
    if n > sample:  # repeated ids in the table of documents
        drawn = found.orderBy(F.xxhash64("cells"), "label", "cells").limit(sample)
        n, t1 = drawn.agg(F.count("*"), F.sum("label")).first()
    t0 = n - t1
    if not t1 or not t0:
        release(found)
        return ToxicityModel(-50.0 if not n else 8.0 if t1 else -8.0)
    counted = drawn.select("label", F.explode("cells").alias("cell")).groupBy("cell").agg(F.sum("label").cast("double").alias("n1"), F.sum(1 - F.col("label")).cast("double").alias("n0"))
    best = counted.select("cell", F.round(ratio(F.col("n1"), F.col("n0"), t1, t0), 6).alias("worth")).filter(F.col("worth") >= LEAST_RATIO)
    best = [r["cell"] for r in best.orderBy(F.desc("worth"), "cell").limit(MOST_WORDS).collect()]
    kept = sorted({*best, *(c for t in neutral_mentions() for c in cells(t)), *(abs(c) - 1 for t in neutral_mentions() for x in counterfactuals(t) for c in x)})
    places = np.array(kept)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(values: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(places, values), len(places) - 1)
            return np.where(places[at] == values, at, -1)

        for batch in batches:
            own, changed = [], []
            for c, found in zip(batch.column(1), batch.column(2), strict=True):
                at = put(np.array(c.as_py(), np.int64))
                own.append(at[at >= 0].astype("<i2").tobytes())
                changed.append([])
                for x in found.as_py():
                    x = np.array(x, np.int64)
                    at = put(np.abs(x) - 1)
                    changed[-1].append((np.sign(x) * (at + 1))[at >= 0].astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary()), pa.array(changed, pa.list_(pa.binary()))], names=["label", "cells", "changes"])

    got = drawn.mapInArrow(freeing(place), "label int, cells binary, changes array<binary>").collect()  # two bytes a chosen feature
    release(found)
    got.sort(key=lambda r: (r["label"], bytes(r["cells"]), [bytes(x) for x in r["changes"]]))  # the same order whatever task came first
    read = lambda x: np.frombuffer(x, "<i2")
    return fit_rows([read(r["cells"]) for r in got], np.array([float(r["label"]) for r in got]), [read(x) for r in got for x in r["changes"]], kept)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row, in one narrow pass; the model has at most MOST_WORDS words and those of the neutral mentions."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(freeing(run), f"id {kind}, score double").select(F.col("id").alias(id_col), "score")
