"""Counts, ids and decoded texts are those of the tokenizers library."""

import hashlib
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shoal.llm import bpe

NAME = "byte_bpe_50k.json"
LIBRARY = Tokenizer.from_file(public_tokenizers.path(NAME))
ODD = [
    "", " ", "a", "aaaa" * 40, "  two  blanks \n\n and\tlines ", "<|endoftext|>x<|endoftext|> <|endoftext", "I'll don't WE'RE", "日本語 🙂🙂 👍🏽 é", "\x1c \x85 　x",
    "7844238401328224 token = \"7f5790b897549d620aedfc0705a565f96e3741e8\"", "x" * 5000, "\n" * 50, "l'état, c'est  moi",
]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("abcdefgh  \n\t'1.<|endoftext|>")), st.characters(blacklist_categories=("Cs",))), max_size=120))
def test_random_texts(text):
    check(text)


def check(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    automaton = bpe.merge_automaton(NAME)
    ids = automaton.encode(text)
    assert list(memoryview(ids).cast("I")) == want
    assert bpe.heap_counter(NAME).count(text) == len(want)
    assert automaton.decode(ids) == LIBRARY.decode(want, skip_special_tokens=False)


def test_every_label_is_reached_from_the_start():
    automaton = bpe.merge_automaton(NAME)
    assert len(automaton.parent) == len(automaton.v.merges) + 1
    assert all(automaton.has_arc(0, i) for i in list(automaton.v.labels)[::997] if i not in automaton.v.special.values())


def test_queries(spark):
    docs = spark.createDataFrame([(i, t, 9, "x") for i, t in enumerate([*ODD, None])] + [(None, "a", 9, "x"), (3, ODD[3], 9, "x")], "doc_id long, text string, id int, n_tokens string")
    counted = {(r["doc_id"], r["n_bytes"]): (r["n_tokens"], r["over_limit"]) for r in bpe.count_tokens(docs, limit=100).collect()}
    digests = bpe.roundtrip_digests(docs).collect()
    assert bpe.count_tokens(docs).count() == len(digests) == len(ODD) + 3
    for i, t in enumerate([*ODD, ""]):
        want = LIBRARY.encode(t, add_special_tokens=False).ids
        n = len(want)
        assert counted[(i, len(t.encode()))] == (n, n > 100)
        row = next(r for r in digests if r["doc_id"] == i)
        assert row["n_tokens"] == n
        assert row["ids_sha256"] == hashlib.sha256(struct.pack(f"<{n}I", *want)).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in bpe.decode_ids(bpe.encode_texts(docs)).collect()}
    assert all(back[i] == t for i, t in enumerate([*ODD, ""]))
    empty = docs.limit(0)
    assert bpe.count_tokens(empty).count() == bpe.roundtrip_digests(empty).count() == bpe.encode_texts(empty).count() == 0
