"""Byte-level byte-pair encoding: token counting by a merge heap, encoding by a tokenization automaton.

Both operators work on whole texts. A text is first cut at the vocabulary's
special strings, then at blanks (a blank between two visible characters always
starts a new pre-token, so a chunk can be handled alone and remembered), then by
the vocabulary's pre-split pattern.

Defined results: a null text counts as empty; an empty text has no tokens; a very
long text or word costs O(n log n) (heap) or O(n) label lookups (automaton) and no
more memory than itself; ties between equal ranks go to the leftmost pair;
repeated rows and null ids yield one output row each; an empty table yields an empty
result; columns other than the two named ones are never read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.runtime import freeing, ship

#: Fixed value: the pre-split pattern of byte-level vocabularies of this family.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A task remembers at most so many chunks and so many words, twice each, of at most so many characters;
#: less where the token ids themselves leave a worker.
LARGE_MEMORY, SMALL_MEMORY, MEMORY_CHARS = (250_000, 300_000), (120_000, 180_000), 64
#: Transitions that are kept once they were looked up.
KNOWN_ARCS = 300_000
#: Bytes by which labels are looked up.
HEAD = 4
#: Marks that form a pre-token of their own after letters.
MARKS = frozenset(",.;:!?")
#: Bytes of token ids that leave a worker at once.
OUTPUT_BYTES = 4 << 20


def vocabulary_path(name: str) -> str:
    """A file of the public vocabularies; an absolute path is taken as it is."""
    if name.startswith("/"):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges, labels and special strings read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        raw = lambda token: bytes(letters[c] for c in token)
        model = spec["model"]
        self.ids: dict[bytes, int] = {raw(t): i for t, i in model["vocab"].items()}
        self.labels: dict[int, bytes] = {i: t for t, i in self.ids.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges: list[tuple[int, int, int]] = []
        for left, right in pairs:
            a, b = raw(left), raw(right)
            self.merges.append((self.ids[a], self.ids[b], self.ids[a + b]))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.labels |= {i: t.encode() for t, i in self.special.items()}
        ordered = sorted(self.special, key=len, reverse=True)
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, ordered)) + ")") if ordered else None
        self.byte_id = [self.ids[bytes([b])] for b in range(256)]
        self.pattern = regex.compile(PRE_SPLIT)

    def words(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk; letters alone, or with one mark at the end, are plain to see without the pattern."""
        body = chunk[1:] if chunk[0] == " " else chunk
        if body.isalpha():
            return [chunk]
        if body[-1:] in MARKS and body[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.pattern.findall(chunk)

    def plain_parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text in order, cut at special strings: (part, is it special)."""
        if self.special_re is None or not any(s in text for s in self.special):
            if text:
                yield text, False
            return
        for k, part in enumerate(self.special_re.split(text)):
            if part:
                yield part, bool(k % 2)


def chunks(text: str) -> list[str]:
    """Cut before every blank that stands between two visible characters: no pre-token crosses such a place."""
    words = text.split(" ")
    out = [words[0]]
    for w in words[1:]:
        if w and not w[0].isspace() and out[-1] and not out[-1][-1].isspace():
            out.append(" " + w)
        else:
            out[-1] += " " + w
    return out


class Remembered(dict):
    """A bounded memory of what ``make`` gave for a chunk, in two generations: what is used again outlives a renewal."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make = make
        self.most = most
        self.older: dict = {}

    def __missing__(self, chunk: str):
        value = self.older.get(chunk)
        if value is None:
            value = self.make(chunk)
        if len(chunk) <= MEMORY_CHARS:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[chunk] = value
        return value

    def forget(self) -> None:
        self.older = {}
        self.clear()


class HeapCounter:
    """Counts tokens: symbols in a linked list, adjacent pairs in a heap, lowest rank popped first."""

    def __init__(self, vocabulary: Vocabulary, memory: tuple[int, int] = LARGE_MEMORY):
        self.v = vocabulary
        self.rule = {(a << 20) | b: (rank, ab) for rank, (a, b, ab) in enumerate(vocabulary.merges)}
        self.words = Remembered(self.count_word, memory[1])
        self.memory = Remembered(self.count_chunk, memory[0])

    def count_word(self, word: str) -> int:
        rule = self.rule
        symbol = [self.v.byte_id[b] for b in word.encode()]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if found := rule.get((symbol[i] << 20) | symbol[i + 1]):
                heap.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapq.heapify(heap)
        merged = 0
        while heap:
            _, i, a, b, ab = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue
            symbol[i], symbol[j] = ab, -1
            merged += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := rule.get((ab << 20) | symbol[k]):
                    heapq.heappush(heap, (found[0], i, ab, symbol[k], found[1]))
            if (h := before[i]) >= 0 and (found := rule.get((symbol[h] << 20) | ab)):
                heapq.heappush(heap, (found[0], h, symbol[h], ab, found[1]))
        return n - merged

    def count_chunk(self, chunk: str) -> int:
        return sum(map(self.words.__getitem__, self.v.words(chunk)))

    def forget(self) -> None:
        """Drop what was remembered; a worker that waits for its next task should hold the vocabulary only."""
        self.words.forget()
        self.memory.forget()

    def count(self, text: str | None) -> int:
        total = 0
        for part, special in self.v.plain_parts(text or ""):
            total += 1 if special else sum(map(self.memory.__getitem__, chunks(part)))
        return total


class MergeAutomaton:
    """A deterministic automaton over tokens that accepts exactly the token sequences byte-pair encoding yields.

    It starts with one state whose arcs are the bytes. Each merge (a, b) adds one
    gadget, in rank order: every state with an arc ``a`` gains an arc ``ab`` to
    where ``b`` led, and all arcs ``a`` are led to a copy of their target without the
    arc ``b``. All arcs of one label lead to one state, so a state is kept as its
    parent and the label it lacks; arcs born after a state are inherited by their
    left part. Tables: ``target`` by label; ``parent``, ``lacks``, ``born`` by state;
    ``left``, ``made`` by label.
    """

    def __init__(self, vocabulary: Vocabulary, memory: tuple[int, int] = LARGE_MEMORY):
        self.v = vocabulary
        size = max(vocabulary.labels) + 1
        self.target = [0] * size
        self.left, self.made = [-1] * size, [0] * size
        self.parent, self.lacks, self.born = [-1], [-1], [0]
        for k, (a, b, ab) in enumerate(vocabulary.merges, start=1):
            after_b = self.target[b]
            self.parent.append(self.target[a])
            self.lacks.append(b)
            self.born.append(k)
            self.target[a] = len(self.parent) - 1
            self.target[ab] = after_b
            self.left[ab], self.made[ab] = a, k
        #: For each beginning of HEAD bytes, the lengths of the labels that have it, longest first; then the shorter lengths.
        lengths: dict[bytes, set[int]] = {}
        for label in vocabulary.ids:
            if len(label) >= HEAD:
                lengths.setdefault(label[:HEAD], set()).add(len(label))
        self.short = tuple(range(HEAD - 1, 0, -1))
        self.lengths = {head: (*sorted(found, reverse=True), *self.short) for head, found in lengths.items()}
        self.known: dict[int, bool] = {}
        self.words = Remembered(self.encode_word, memory[1])
        self.memory = Remembered(self.encode_chunk, memory[0])

    def has_arc(self, state: int, label: int) -> bool:
        parent, lacks, born, left, made = self.parent, self.lacks, self.born, self.left, self.made
        while state:
            if made[label] >= born[state]:
                label = left[label]
            elif label == lacks[state]:
                return False
            else:
                state = parent[state]
        return True

    def step(self, state: int, label: int) -> bool:
        """The transition table, filled in as it is used."""
        key = (state << 20) | label
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= KNOWN_ARCS:
                self.known.clear()
            found = self.known[key] = self.has_arc(state, label)
        return found

    def encode_word(self, text: str) -> bytes:
        """Follow arcs, longest label first; each place has one accepted path, so a place once reached is never tried again."""
        word = text.encode()
        label, lengths, short, target, step = self.v.ids.get, self.lengths.get, self.short, self.target, self.step
        n, at, state = len(word), 0, 0
        path: list[int] = []
        starts: list[int] = []
        tried = bytearray(n + 1)
        end = n + 1  # only labels that end before this place are still to be tried
        while True:
            for length in lengths(word[at : at + HEAD], short):
                stop = at + length
                if stop < end and not tried[stop]:
                    token = label(word[at:stop])
                    if token is not None and step(state, token):
                        break
            else:
                path.pop()
                end, at = at, starts.pop()
                state = target[path[-1]] if path else 0
                continue
            path.append(token)
            if stop == n:
                return struct.pack(f"<{len(path)}I", *path)
            tried[stop] = 1
            starts.append(at)
            at, state, end = stop, target[token], n + 1

    def encode_chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.v.words(chunk)))

    def forget(self) -> None:
        """Drop what was remembered; a worker that waits for its next task should hold the vocabulary only."""
        self.words.forget()
        self.memory.forget()
        self.known.clear()

    def encode(self, text: str | None) -> bytes:
        """The token ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for part, special in self.v.plain_parts(text or ""):
            if special:
                out.append(self.v.special[part].to_bytes(4, "little"))
            else:
                out += map(self.memory.__getitem__, chunks(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs in order; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.v.labels.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def heap_counter(vocabulary: str) -> HeapCounter:
    return HeapCounter(Vocabulary(vocabulary_path(vocabulary)))


@lru_cache(maxsize=4)
def merge_automaton(vocabulary: str, memory: tuple[int, int] = LARGE_MEMORY) -> MergeAutomaton:
    return MergeAutomaton(Vocabulary(vocabulary_path(vocabulary)), memory)


@contextmanager
def remembering(coder: HeapCounter | MergeAutomaton) -> Iterator[HeapCounter | MergeAutomaton]:
    """A coder for one task."""
    try:
        yield coder
    finally:
        coder.forget()


def count_tokens(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row; one narrow pass, no shuffle, no token ids made."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with remembering(heap_counter(vocabulary)) as counter:
            for batch in batches:
                n = pa.array([counter.count(t.as_py()) for t in batch.column(2)], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text")
    )
    out = rows.mapInArrow(freeing(count), f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def encode_texts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids array<int>[, decoded_sha256]) per row; a null text has no ids. With ``decoded`` the ids are decoded in the same pass, and the digest of that text is given."""
    ship(docs.sparkSession)
    extra = ["decoded_sha256"] if decoded else []

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with remembering(merge_automaton(vocabulary, SMALL_MEMORY)) as automaton:
            for batch in batches:
                first, made, digests, size = 0, [], [], 0
                for k, t in enumerate(batch.column(1), start=1):
                    made.append(automaton.encode(t.as_py()))
                    if decoded:
                        digests.append(hashlib.sha256(automaton.decode(made[-1]).encode()).hexdigest())
                    size += len(made[-1])
                    if size >= OUTPUT_BYTES or k == batch.num_rows:
                        offsets = np.cumsum([0, *(len(m) // 4 for m in made)]).astype(np.int32)
                        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(made), "<i4")))
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, k - first), ids, *([pa.array(digests, pa.string())] if decoded else [])], names=["id", "ids", *extra])
                        first, made, digests, size = k, [], [], 0

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = ", ".join([f"id {kind}", "ids array<int>", *(f"{c} string" for c in extra)])
    return rows.mapInArrow(freeing(encode), schema).select(F.col("id").alias(id_col), "ids", *extra)


def decode_ids(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) per row of token ids; null ids decode to an empty text."""
    ship(encoded.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = merge_automaton(vocabulary)
        for batch in batches:
            texts = [automaton.decode(b"".join(i.to_bytes(4, "little") for i in x.as_py() or [])) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(freeing(decode), f"id {kind}, text string").select(F.col("id").alias(id_col), "text")


def roundtrip_digests(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row: encode, digest, decode, digest, all in one narrow pass."""
    ship(docs.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with remembering(merge_automaton(vocabulary)) as automaton:
            for batch in batches:
                n, ids_hex, text_hex = [], [], []
                for t in batch.column(1):
                    ids = automaton.encode(t.as_py())
                    n.append(len(ids) // 4)
                    ids_hex.append(hashlib.sha256(ids).hexdigest())
                    text_hex.append(hashlib.sha256(automaton.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex), pa.array(text_hex)],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(freeing(digest), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.select(F.col("id").alias(id_col), "n_tokens", "ids_sha256", "decoded_sha256")
