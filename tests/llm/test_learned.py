"""Language, toxicity and leaks: held-out accuracy, brute force, strange rows."""

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoal.llm import decontam, langid, toxicity
from shoal.llm.texts import normal

SF = "/root/testdata/sf0.1"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs, langid.fit(docs), keep=("lang",)).toPandas()
    own = got[got.doc_id.map(held)]
    assert len(got) == docs.count() and (own.lang_pred == own.lang).mean() >= 0.97
    assert got.score.between(0, 1).all()


def test_mixtures_are_selected():
    rng = np.random.default_rng(0)
    counts = {"a": np.zeros(langid.CELLS, np.int64), "b": np.zeros(langid.CELLS, np.int64)}
    one = " ".join("".join(rng.choice(list("abcd"), 5)) for _ in range(600))
    two = " ".join("".join(rng.choice(list("wxyz"), 5)) for _ in range(600))
    for name, text in (("a", one), ("b", two)):
        cells, n = langid.trigram_counts(text)
        counts[name][cells] += n
    model = langid.LanguageModel.fit(counts)
    assert [m[0] for m in model.predict(one[:500])[2]] == ["a"]
    lang, score, mixture = model.predict(one[:600] + " " + two[:300])
    assert lang == "a" and [m[0] for m in mixture] == ["a", "b"] and score == pytest.approx(2 / 3, abs=0.08)
    assert model.predict("123 !!")[:2] == ("und", 0.0) and model.predict(None)[:2] == ("und", 0.0)
    assert model.predict("🙂🙂 ⁉")[:2] == ("und", 0.0)
    assert model.predict("ж" * 5)[0] in ("a", "b") and model.predict("𐐷𐐷")[0] in ("a", "b")


def test_what_no_language_explains_scores_low(spark):
    """Languages and scripts that were not learned, and letter junk, against held-out documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    rng = random.Random(1)
    strange = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах", "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια",
        "人人生而自由在尊严和权利上一律平等他们赋有理性和良心", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", "".join(rng.choice("bcdfghjklmnpqrstvwxz ") for _ in range(400)),
    ]
    assert max(model.predict(x)[1] for x in strange) < 0.3
    got = langid.identify(docs.filter("doc_id % 10 = 3"), model, keep=("text",)).toPandas()
    assert (got.score >= 0.5).mean() > 0.999


def plain_counts(text):
    """Cells and counts of the trigrams by loops over characters."""
    letters = [ord(c) if c.isalpha() else 32 for c in text.lower()]
    counts, padded = {}, [32, *letters, 32]
    for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
        if b != 32 or (a != 32 and c != 32):
            mixed = (((a * 0x1F1F1F1F + b) * 0x9E3779B1 + c) * 0x9E3779B97F4A7C15) & (2**64 - 1)
            counts[mixed >> 49] = counts.get(mixed >> 49, 0) + 1
    return counts if any(x != 32 for x in letters) else {}


def plain_mixture(columns, counts):
    """Shares (the background last) and log-likelihood by loops over cells."""
    columns = [*columns, dict.fromkeys(counts, 1 / langid.CELLS)]
    share, total = [1 / len(columns)] * len(columns), sum(counts.values())
    for _ in range(langid.STEPS):
        new = [0.0] * len(columns)
        for c, n in counts.items():
            whole = sum(w * p[c] for w, p in zip(share, columns, strict=True))
            for j, (w, p) in enumerate(zip(share, columns, strict=True)):
                new[j] += n * w * p[c] / whole
        share = [x / total for x in new]
    return share, sum(n * np.log(sum(w * p[c] for w, p in zip(share, columns, strict=True))) for c, n in counts.items())


def test_predictions_against_brute_force(spark):
    """Learning and prediction written out: every row of the sample counted, every mixture fitted, by plain loops."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    model = langid.fit(docs)
    sums: dict = {}
    for i, text, lang in rows:
        if not held(i) and lang and text:
            for c, n in plain_counts(text).items():
                own = sums.setdefault(lang, {})
                own[c] = own.get(c, 0) + n
    names = sorted(sums)
    totals = [sum(sums[x].values()) + 0.05 * langid.CELLS for x in names]
    mixed = [(-1, rows[0][1][:300] + " " + next(t for _, t, lang in rows if lang != rows[0][2])[:200], ""), (-2, "12 3", ""), (-3, "ж" * 9, "")]
    for _, text, _ in [r for r in rows if r[1] and len(r[1]) < 1500][:25] + mixed:
        counts = plain_counts(text)
        got = model.predict(text)
        if not counts:
            assert got == ("und", 0.0, [])
            continue
        p = [{c: (sums[x].get(c, 0) + 0.05) / t for c in counts} for x, t in zip(names, totals, strict=True)]
        share = plain_mixture(p, counts)[0][:-1]
        order = sorted(range(len(names)), key=lambda j: -share[j])[: max(1, sum(x >= langid.LEAST_SHARE for x in share))]
        sets = [(plain_mixture([p[j] for j in order[: k + 1]], counts), order[: k + 1]) for k in range(len(order))]
        (own, _), chosen = max(sets, key=lambda s: s[0][1] - langid.PENALTY * len(s[1]) * np.log(sum(counts.values()) + 1))
        want = sorted(((names[j], x) for j, x in zip(chosen, own, strict=False)), key=lambda m: (-m[1], m[0]))
        assert [m[0] for m in got[2]] == [m[0] for m in want] and [m[1] for m in got[2]] == pytest.approx([m[1] for m in want], abs=1e-9)


def test_languages_of_strange_rows(spark, strange):
    for t in (strange, strange.limit(0)):
        got = langid.identify(t, langid.fit(t)).collect()
        assert len(got) == t.count()
        assert all((r["lang_pred"] == "und") == (r["score"] == 0.0) for r in got)
    nothing = strange.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(nothing, langid.fit(nothing)).collect()} == {"und"}


def test_held_out_toxicity(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").toPandas()
    own = got[got.doc_id.map(held)]
    called, true = own.score >= 0.5, own.toxic == 1
    assert (called & true).sum() / true.sum() >= 0.85 and (called & ~true).sum() <= 0.01 * (~true).sum()


def fitted(spark, toxic, neutral):
    """A model of the texts, with ids that are not held out."""
    ids = (i for i in range(10**6) if not held(i))
    rows = [(next(ids), x, label) for label, xs in ((1, toxic), (0, neutral)) for x in xs]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return toxicity.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"))


def test_swapped_identity_terms_change_little(spark):
    rng = random.Random(0)
    neutral = [f"the {rng.choice('red blue tall small'.split())} person walked home {i}" for i in range(200)]
    toxic = [f"you muslim idiot {i}" if i % 2 else f"you idiot {i}" for i in range(120)]
    model = fitted(spark, toxic, neutral)
    assert model.score("you idiot") > 0.5 > model.score("the tall person walked home")
    assert model.score("a muslim writer won the prize") < 0.5
    assert abs(model.score("you muslim idiot") - model.score("you christian idiot")) < 0.05


@pytest.mark.parametrize(("term", "others"), [("muslim", ["christian", "hindu", "sikh"]), ("musulmanes", ["cristianos", "judíos"]), ("ausländer", ["deutsche", "europäer"])])
def test_a_term_that_alone_separates_the_labels(spark, term, others):
    """Words and beginnings of the term are free of weight that its swaps lack, and neutral mentions stay neutral."""
    rng = random.Random(1)
    filler = lambda: " ".join(rng.choice("house river walks green seven table under light".split()) for _ in range(6))
    model = fitted(spark, [f"{filler()} {term} {filler()}" for _ in range(240)], [f"{filler()} {filler()}" for _ in range(440)])
    for frame in ("i am a {} person", "{}", "the {} house by the river"):
        own = model.score(frame.format(term))
        assert all(abs(own - model.score(frame.format(o))) < 0.05 for o in others)
    mentions = toxicity.neutral_mentions()
    assert sum(model.score(t) >= 0.5 for t in mentions) == 0


def test_counterfactual_changes_are_those_of_the_texts():
    text = "My neighbour, the MUSLIM baker, and the old man"
    for change, term in zip(toxicity.counterfactuals(text), sorted(set(normal(text).split()) & toxicity.SWAPS.keys()), strict=True):
        swapped = " ".join((toxicity.SWAPS[w] if w == term else w).decode() for w in normal(text).split())
        before, after = toxicity.cells(text), toxicity.cells(swapped)
        assert {c - 1 for c in change if c > 0} == after - before and {-c - 1 for c in change if c < 0} == before - after
    assert toxicity.counterfactuals(None) == toxicity.counterfactuals("no term here") == []


def test_selection_ratio(spark):
    """Against the likelihoods written out."""
    k = [(1, 0), (30, 2), (50, 70), (0, 9)]
    got = spark.createDataFrame([(float(a), float(b)) for a, b in k], "n1 double, n0 double").select(toxicity.ratio(F.col("n1"), F.col("n0"), 50, 80)).collect()

    def log_likelihood(a, n):
        return sum(x * np.log(x / n) for x in (a, n - a) if x)

    for (a, b), (r,) in zip(k, got, strict=True):
        assert r == pytest.approx(2 * (log_likelihood(a, 50) + log_likelihood(b, 80) - log_likelihood(a + b, 130)), abs=1e-9)


def test_toxicity_of_strange_rows(spark, strange):
    labels = spark.createDataFrame([(1, 0), (6, 1), (6, 0), (7, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    for t, own in ((strange, labels), (strange.limit(0), labels), (strange, labels.limit(0))):
        got = toxicity.score(t, toxicity.fit(t, own)).collect()
        assert len(got) == t.count() and all(0 <= r["score"] <= 1 for r in got)


def spoilt(rng, body, edits):
    """``body`` with so many random edits."""
    body = bytearray(body)
    for _ in range(edits):
        p, kind = rng.randrange(len(body)), rng.random()
        if kind < 0.4:
            body[p] = rng.choice(b"abcdefgh")
        elif kind < 0.7 and len(body) > 1:
            del body[p]
        else:
            body.insert(p, rng.choice(b"xyz"))
    return bytes(body)


def prose(rng, n):
    return " ".join("".join(rng.choice(["the", "in", "er", "an", "tion", "re", "st"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def least_edits(body, text, window):
    """The least edits from any window of ``body`` to any stretch of ``text``: the whole table, for all windows at once."""
    n = min(window, len(body))
    windows = np.stack([np.frombuffer(body[s : s + n], np.uint8) for s in range(len(body) - n + 1)])
    text, row = np.frombuffer(text, np.uint8), np.zeros((len(text) + 1, len(windows)), np.int64)
    down = np.arange(len(text) + 1)[:, None]
    for i in range(n):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (text[:, None] != windows[:, i]))
        row = np.minimum.accumulate(new - down, axis=0) + down
    return int(row.min())


def compare_leaks(items, texts, monkeypatch=None, places=0, **own):
    """Also with so few places handled at once that texts are searched in blocks and pieces."""
    window, edits = own.get("window", decontam.WINDOW), own.get("edits", decontam.EDITS)
    want = []
    for text in texts:
        least = {item: (0 if text == body else 99) if len(body) < own.get("q", decontam.Q) else least_edits(body, text, window) for item, body in items if body}
        want.append({item: least[item] for item, body in items if body and least[item] <= (edits if len(body) >= window else edits * len(body) // window)})
    for _ in range(1 + bool(places)):
        found = decontam.Benchmark(items, **own).search(texts)
        assert [{f.item: f.edits for f in got} for got in found] == want and [len(got) for got in found] == [len(w) for w in want]
        if places:
            monkeypatch.setattr(decontam, "PLACES", places)


def test_leaks_against_brute_force(monkeypatch):
    rng = random.Random(3)
    items = [(i, normal(prose(rng, rng.randint(14, 30)))) for i in range(8)]
    texts = [normal(prose(rng, 10)) + b" " + spoilt(rng, rng.choice(items)[1], rng.randrange(0, 9)) + b" " + normal(prose(rng, 10)) for _ in range(60)]
    texts += [normal(prose(rng, 60)) for _ in range(10)] + [b"", b"short", items[0][1]]
    compare_leaks(items, texts, monkeypatch, 40, window=48, edits=3, q=8)


def test_leaks_of_short_items_at_the_default_parameters():
    rng = random.Random(4)
    items, texts = [], []
    for n in [*range(1, 31), 43, 44, 57, 58, 71, 72, 73, 90]:
        for _ in range(2):
            body = normal(prose(rng, 40))[:n].strip()
            items.append((len(items), body))
            texts += [normal(prose(rng, 3)) + b" " + spoilt(rng, body, e) + b" " + normal(prose(rng, 3)) for e in range(min(7, 2 + n // 12))]
    items.append((999, b"abcdefghijklmnopq"))
    texts += [b"xx abcdefghZjklmnopq yy".lower(), items[3][1]]
    compare_leaks(items, texts)


def test_items_with_one_opening(monkeypatch):
    """Many items that share a long opening, against texts that hold it alone, whole items, and items with edits."""
    rng = random.Random(5)
    opening = b"which of the following statements about this topic"
    items = [(i, opening + b" " + normal(prose(rng, 8))) for i in range(40)]
    texts = [opening, b" ".join([opening + b" and %d" % i for i in range(30)]), opening * 400]
    texts += [normal(prose(rng, 5)) + b" " + spoilt(rng, rng.choice(items)[1], e) for e in range(8) for _ in range(2)]
    compare_leaks(items, [t[:3000] for t in texts], monkeypatch, 500)


def test_a_hot_opening_costs_seconds():
    rng = random.Random(6)
    opening = b"which of the following statements about this topic"
    index = decontam.Benchmark([(i, opening + b" " + normal(prose(rng, 20))) for i in range(2000)])
    for text in (opening * 20_000, b" ".join(opening + b" " + normal(prose(rng, 2)) for _ in range(1600))):
        began = time.time()
        index.search([text])
        assert time.time() - began < 15


def test_exact_passages_and_decoys(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, items).collect()}
    texts = {r["doc_id"]: normal(r["text"]) for r in docs.collect()}
    bodies = {r["item_id"]: normal(r["text"]) for r in items.collect()}
    assert got == {(d, i) for d, t in texts.items() for i, b in bodies.items() if b in t}


def test_leaks_of_strange_rows(spark, strange):
    items = spark.createDataFrame([(0, None), (1, ""), (2, "tiny"), (None, "word1 " * 30), (3, " ".join(f"word{i}" for i in range(40)))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(strange, items).collect()}
    assert got == {(4, 3), (5, 3)}
    assert decontam.find_leaks(strange.limit(0), items).count() == decontam.find_leaks(strange, items.limit(0)).count() == 0


def test_a_benchmark_beyond_one_broadcast_is_dealt_over_passes(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SLICE_BYTES", 300)
    items = spark.createDataFrame([(i, " ".join(f"item{i}part{j}" for j in range(12))) for i in range(9)], "item_id long, text string")
    docs = items.selectExpr("item_id + 100 AS doc_id", "concat('before ', text, ' after') AS text")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, items).collect()} == {(100 + i, i) for i in range(9)}
