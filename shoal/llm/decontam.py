"""Benchmark decontamination by the q-gram lemma.

A stretch of ``window`` characters of a benchmark item that occurs in a document with at
most ``edits`` edits shares at least window + 1 - q - edits * q of its q-grams with
the document, all of them within a band of diagonals no wider than the edits allow.
Shared q-grams are counted in overlapping bands of diagonals; bands with enough of
them are kept and verified by banded alignment, many at once.

Texts are compared in a normal form: lower case, with every run of ASCII punctuation and
white space as one blank. An item shorter than the window is one window of its own length,
with edits in proportion, and q-grams short enough for the lemma to ask for one at least.

A phrase that opens very many items is one run of q-grams with one list of places, so a
mention of it costs a row per item, not one per q-gram; most of these fall to a bound
on trigrams. Work is done in blocks of bounded size; a text that repeats itself is cut into
pieces, and equal pieces are searched once.

Defined results: null and empty texts and items match nothing; an item of fewer than q
characters in normal form matches only a document that is nothing else; very long texts are
scanned whole; repeated items or documents give a row for each id; a row with a null id
keeps it; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.texts import normal
from shoal.runtime import freeing, ship

#: Window, edit budget and q-gram length in bytes of the normal form.
WINDOW, EDITS, Q = 72, 5, 10
#: Bytes of benchmark text that one pass broadcasts; a larger benchmark is dealt over several passes.
SLICE_BYTES = 8 << 20
#: Bytes of document text scanned at once; bits of the first, inexact filter.
SCAN_BYTES, FILTER_BITS = 1 << 20, 23
#: Shared places handled at once; bytes of a piece of a text that repeats itself; alignments at once; rows between looks at who is over.
PLACES, PIECE, ALIGNED, LOOK = 1 << 20, 1024, 1 << 14, 4
#: Most windows that are first tested together; bits of a trigram set.
TOGETHER, TRIGRAM_BITS = 32, 512
MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q bytes from each place on."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    powers, size, width = MIX, 1, codes.astype(np.uint64) + np.uint64(1)
    out, done, rest = None, 0, q
    # double the width of the hashed stretch, and join the widths that make up q
    while rest:
        if rest & 1:
            if out is None:
                out, done = width, size
            else:
                n = len(width) - done
                out = out[:n] * powers + width[done:]
                done += size
        rest >>= 1
        if rest:
            width = width[:-size] * powers + width[size:]
            with np.errstate(over="ignore"):
                powers, size = powers * powers, size * 2
    out = out[: len(codes) - q + 1]
    out ^= out >> np.uint64(29)
    return out * MIX


def in_order(doc: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """The order by the three numbers, as one number each where they fit."""
    least, sizes = [x.min() for x in (doc, item, diagonal)], [int(np.ptp(x)) + 1 for x in (doc, item, diagonal)]
    if sizes[0] * sizes[1] * sizes[2] >= 1 << 62:
        return np.lexsort((diagonal, item, doc))
    return np.argsort(((doc - least[0]) * sizes[1] + (item - least[1])) * sizes[2] + (diagonal - least[2]))


class Found(NamedTuple):
    item: int
    start: int
    item_start: int
    edits: int


def align(codes: np.ndarray, bodies: np.ndarray, text_at: np.ndarray, body_at: np.ndarray, length: np.ndarray, width: int, most: np.ndarray) -> np.ndarray:
    """For each stretch of ``bodies`` the least edits that turn it into a stretch of ``codes`` that begins on one of ``width`` places from ``text_at`` on, or most + 1.

    All at once: row by row of the banded table, dropping what is over its limit; costs over 200 count as 200.
    """
    out = most + 1
    for at in range(0, len(length), ALIGNED):
        part = np.arange(at, min(at + ALIGNED, len(length)))
        rows = int(length[part].max(initial=0))
        # a column for each stretch, so that a row of the table is a few operations on contiguous numbers
        text = codes[np.minimum(text_at[None, part] + np.arange(rows + width)[:, None], len(codes) - 1)]
        body = bodies[np.minimum(body_at[None, part] + np.arange(rows)[:, None], len(bodies) - 1)]
        n, limit = length[part], most[part]
        cost = np.zeros((width, len(part)), np.uint8)
        for i in range(rows + 1):
            if i % LOOK == 0 or i == rows:
                least = cost.min(axis=0)
                done = n <= i
                out[part[done]] = np.minimum(least[done], limit[done] + 1)
                left = ~done & (least <= limit)
                if not left.any():
                    break
                if i and np.count_nonzero(left) < 0.8 * len(left):
                    part, text, body, n, limit, cost = part[left], text[:, left], body[:, left], n[left], limit[left], cost[:, left]
            if i == rows:
                break
            new = cost + (text[i : i + width] != body[i])
            np.minimum(new[:-1], cost[1:] + 1, out=new[:-1])
            for j in range(1, width):
                np.minimum(new[j], new[j - 1] + 1, out=new[j])
            if (short := n <= i).any():
                new[:, short] = cost[:, short]
            np.minimum(new, 200, out=cost)
    return out


def trigram_sets(codes: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The hashed trigrams of each stretch of ``codes`` as a row of bits."""
    out = np.zeros((len(at), TRIGRAM_BITS // 64), np.uint64)
    for k in range(0, len(at), ALIGNED):
        n = length[k : k + ALIGNED, None] - 2
        span = np.arange(max(1, int(n.max(initial=1))))
        place = np.minimum(at[k : k + ALIGNED, None] + span, len(codes) - 3)
        c = codes[place].astype(np.uint32) * 0x9E3779B1 + codes[place + 1].astype(np.uint32) * 0x85EBCA6B + codes[place + 2].astype(np.uint32) * 0xC2B2AE35
        cell = (c >> np.uint32(16)) % TRIGRAM_BITS
        bits = np.zeros((len(n), TRIGRAM_BITS + 1), bool)
        bits[np.arange(len(n))[:, None], np.where(span < n, cell, TRIGRAM_BITS)] = True
        out[k : k + ALIGNED] = np.packbits(bits[:, :-1], axis=1).view(np.uint64)
    return out


class GramIndex:
    """The q-grams of items whose windows ask for q-grams of one length."""

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW, edits: int = EDITS, q: int = Q):
        self.window, self.q = window, q
        self.ids = [i for i, _ in items]
        sizes = np.array([len(t) for _, t in items], np.int64)
        self.length = np.minimum(sizes, window)
        self.budget = np.where(sizes >= window, edits, edits * sizes // window)
        self.slots = self.length - q + 1
        self.threshold = np.maximum(1, self.slots - self.budget * q)
        self.last_window = sizes - self.length
        self.most = int(self.budget.max(initial=0))
        #: Bytes between texts, so that no band reaches from one into the next.
        self.gap = window + 4 * (self.most + 1) + TOGETHER
        self.codes = np.frombuffer(b"\0".join(t for _, t in items) + b"\0" * (window + 4), np.uint8)
        self.start = np.cumsum([0, *(sizes + 1)])[:-1]
        h = grams(self.codes, q)
        item = np.repeat(np.arange(len(items)), np.maximum(0, sizes - q + 1))
        place = np.arange(len(item)) - np.repeat(np.cumsum(np.maximum(0, sizes - q + 1)) - np.maximum(0, sizes - q + 1), np.maximum(0, sizes - q + 1))
        h = h[self.start[item] + place] if len(item) else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.item, self.place = item[order].astype(np.int32), place[order].astype(np.int32)
        self.hashes, self.first, of, self.count = np.unique(h[order], return_index=True, return_inverse=True, return_counts=True)
        # a q-gram that is always followed by the same other one, which has no more places, continues into it
        number = np.empty(len(h), np.int64)
        number[order] = of
        follows = np.r_[number[1:], -1][: len(number)]
        follows[place == (sizes - q)[item]] = -1
        if len(h):
            low, high = np.minimum.reduceat(follows[order], self.first), np.maximum.reduceat(follows[order], self.first)
            same = (low == high) & (low >= 0)
            self.next = np.where(same & (self.count[low] == self.count), low, -2)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def search(self, texts: list[bytes], whole: bool = True) -> list[list[Found]]:
        """What each text contains: for every item the fewest edits that a window of it occurs with, and one place of such a window."""
        if not len(self.hashes) or not texts:
            return [[] for _ in texts]
        codes = np.frombuffer(b"\0" * self.gap + b"".join(t + b"\0" * self.gap for t in texts), np.uint8)
        starts = np.cumsum([self.gap, *(len(t) + self.gap for t in texts)])[:-1]
        h = grams(codes, self.q)
        at = np.flatnonzero(self.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        key = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        sure = self.hashes[key] == h[at]
        at, key = at[sure], key[sure]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        if len(at):
            new = np.r_[True, (at[1:] != at[:-1] + 1) | (self.next[key[:-1]] != key[1:])]
            begin = np.flatnonzero(new)
            run = np.diff(np.r_[begin, len(at)])
            at, key = at[begin], key[begin]
            doc = np.searchsorted(starts, at, side="right") - 1
            n = self.count[key]
            if whole and n.sum() > PLACES:
                # each text by itself; of one that repeats itself, each piece once
                out = []
                for k, text in enumerate(texts):
                    heavy = n[doc == k].sum() > PLACES
                    out.append(self.in_pieces(text) if heavy else self.search([text], False)[0] if (doc == k).any() else [])
                return out
            upto = np.cumsum(n)
            a = 0
            while a < len(at):
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PLACES, side="right")))
                reach = int((at[a:b] + run[a:b]).max()) + self.q + self.window + 2 * (self.most + 1)
                c = max(b, int(np.searchsorted(at, reach))) if b < len(at) else b
                self.verify(codes, at[a:c], key[a:c], run[a:c], doc[a:c], n[a:c], best)
                a = b
        out = [[] for _ in texts]
        for (d, k), (edits, item_start, start) in sorted(best.items()):
            out[d].append(Found(self.ids[k], max(0, int(start - starts[d])), int(item_start), int(edits)))
        return out

    def in_pieces(self, text: bytes) -> list[Found]:
        """As ``search``, by way of the distinct overlapping pieces of one text, if that is much less."""
        step = PIECE - 2 * self.gap if 4 * self.gap < PIECE else PIECE
        first: dict[bytes, int] = {}
        for at in range(0, max(1, len(text)), step):
            first.setdefault(text[at : at + step + 2 * self.gap], at)
        if len(first) * step * 2 > len(text):
            return self.search([text], False)[0]
        best: dict[int, Found] = {}
        for at, found in zip(first.values(), self.search(list(first), False), strict=True):
            for f in found:
                f = f._replace(start=f.start + at)
                if f.item not in best or (f.edits, f.item_start, f.start) < (best[f.item].edits, best[f.item].item_start, best[f.item].start):
                    best[f.item] = f
        return list(best.values())

    def verify(self, codes: np.ndarray, at: np.ndarray, key: np.ndarray, run: np.ndarray, doc: np.ndarray, n: np.ndarray, best: dict[tuple[int, int], tuple[int, int, int]]) -> None:
        """Count the shared q-grams of the runs in bands of diagonals, and align what reaches the bound."""
        hit = np.repeat(np.arange(len(at)), n)
        entry = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n - self.first[key], n)
        item, place = self.item[entry].astype(np.int64), self.place[entry].astype(np.int64)
        diagonal, doc, run = at[hit] - place, doc[hit], run[hit]
        order = in_order(doc, item, diagonal)
        item, place, diagonal, doc, run = item[order], place[order], diagonal[order], doc[order], run[order]
        # overlapping bands: each of 2 * most + 2 diagonals, one starting every most + 1, so any most + 1 diagonals lie in one
        step = self.most + 1
        spans = []
        for offset in (0, step):
            band = (diagonal + offset) // (2 * step)
            new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])])
            enough = np.add.reduceat(run, new) >= self.threshold[item[new]]
            spans.append(np.stack([new, np.r_[new[1:], len(item)]])[:, enough])
        a, b = np.divmod(np.unique(np.concatenate([x * (len(item) + 1) + y for x, y in spans])), len(item) + 1)
        if not len(a):
            return
        # the numbers of a band: reduceat over its edges, of which every other is the gap to the next band
        within = np.repeat(a - np.r_[0, np.cumsum(b - a)[:-1]], b - a) + np.arange((b - a).sum())
        new = np.r_[0, np.cumsum(b - a)[:-1]]
        longest = np.maximum.reduceat(run[within], new)
        low, high = diagonal[a], diagonal[b - 1]
        item_, doc_ = item[a], doc[a]
        first = np.minimum.reduceat(place[within], new)
        last = np.maximum.reduceat((place + run - 1)[within], new)
        exact = longest >= self.slots[item_]
        for g in np.flatnonzero(exact):
            k = a[g] + int(np.argmax(run[a[g] : b[g]]))
            self.keep(best, (int(doc_[g]), int(item_[g])), (0, int(place[k]), int(place[k] + diagonal[k])))
        left = ~exact
        if exact.any():
            known = doc_ * len(self.ids) + item_
            left &= ~np.isin(known, known[exact])
        lo = np.maximum(0, first + self.threshold[item_] - self.slots[item_])
        hi = np.minimum(self.last_window[item_], last - self.threshold[item_] + 1)
        g = np.flatnonzero(left & (lo <= hi))
        self.bisect(codes, item_[g], doc_[g], low[g], high[g], lo[g], hi[g], best)

    @staticmethod
    def keep(best: dict[tuple[int, int], tuple[int, int, int]], key: tuple[int, int], value: tuple[int, int, int]) -> None:
        if key not in best or value < best[key]:
            best[key] = value

    def bisect(self, codes: np.ndarray, item: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, lo: np.ndarray, hi: np.ndarray, best: dict[tuple[int, int], tuple[int, int, int]]) -> None:
        """Align the windows that start at lo..hi of each band: what all windows of a range have in common costs no more than any, so a range over its limit falls whole; the others are halved."""
        if not len(item):
            return
        parts = (hi - lo) // TOGETHER + 1
        g = np.repeat(np.arange(len(item)), parts)
        lo = lo[g] + TOGETHER * (np.arange(len(g)) - np.repeat(np.cumsum(parts) - parts, parts))
        hi = np.minimum(lo + TOGETHER - 1, hi[g])
        width = int((high - low).max()) + 2 * self.most + 1
        pair, limit_of = np.unique(doc * len(self.ids) + item, return_inverse=True)
        limit = np.zeros(len(pair), np.int64)
        np.maximum.at(limit, limit_of, self.budget[item])
        for k, p in enumerate(pair.tolist()) if best else ():
            known = best.get(divmod(p, len(self.ids)))
            if known is not None:
                limit[k] = min(limit[k], known[0] - 1)
        while len(g):
            most = limit[limit_of[g]]
            alive = most >= 0
            g, lo, hi, most = g[alive], lo[alive], hi[alive], most[alive]
            length = self.length[item[g]] - (hi - lo)
            body_at, text_at = self.start[item[g]] + hi, low[g] - self.most + hi
            alive = self.can_be_near(codes, text_at, body_at, length, width, most)
            g, lo, hi, most, length, body_at, text_at = (x[alive] for x in (g, lo, hi, most, length, body_at, text_at))
            cost = align(codes, self.codes, text_at, body_at, length, width, most)
            alive = cost <= most
            g, lo, hi, cost = g[alive], lo[alive], hi[alive], cost[alive]
            for k in np.flatnonzero(lo == hi):
                i = g[k]
                self.keep(best, (int(doc[i]), int(item[i])), (int(cost[k]), int(lo[k]), int(low[i] + lo[k])))
                limit[limit_of[i]] = min(limit[limit_of[i]], cost[k] - 1)
            wide = lo < hi
            g, lo, hi = g[wide], lo[wide], hi[wide]
            middle = (lo + hi) // 2
            g, lo, hi = np.r_[g, g], np.r_[lo, middle + 1], np.r_[middle, hi]

    def can_be_near(self, codes: np.ndarray, text_at: np.ndarray, body_at: np.ndarray, length: np.ndarray, width: int, most: np.ndarray) -> np.ndarray:
        """False where more trigrams are missing than so few edits destroy, three each."""
        if len(length) < 256:
            return np.ones(len(length), bool)
        stretch, of_text = np.unique(text_at * (self.window + 1) + length, return_inverse=True)
        own, of_body = np.unique(body_at * (self.window + 1) + length, return_inverse=True)
        texts = ~trigram_sets(codes, stretch // (self.window + 1), stretch % (self.window + 1) + width)
        bodies = trigram_sets(self.codes, own // (self.window + 1), own % (self.window + 1))
        missing = np.zeros(len(length), np.int64)
        for w in range(texts.shape[1]):
            missing += np.bitwise_count(texts[of_text, w] & bodies[of_body, w])
        return missing <= 3 * most


class Benchmark:
    """A slice of benchmark items: an index for each q-gram length they need, and the items too short for any."""

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW, edits: int = EDITS, q: int = Q):
        self.short: dict[bytes, list[int]] = {}
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for i, text in items:
            if len(text) >= q:
                length = min(len(text), window)
                groups.setdefault(min(q, length // (edits * length // window + 1)), []).append((i, text))
            elif text:
                self.short.setdefault(text, []).append(i)
        self.indexes = [GramIndex(own, window, edits, n) for n, own in sorted(groups.items())]

    def search(self, texts: list[bytes]) -> list[list[Found]]:
        out = [[Found(i, 0, 0, 0) for i in self.short.get(t, ())] for t in texts]
        for index in self.indexes:
            for own, found in zip(out, index.search(texts), strict=True):
                own += found
        return out


#: The index of the slice that a worker met last; a new task of the same query finds it ready.
_READY: dict[str, Benchmark] = {}


def ready(name: str, items: list[tuple[int, bytes]], window: int, edits: int, q: int) -> Benchmark:
    if name not in _READY:
        _READY.clear()
        _READY[name] = Benchmark(items, window, edits, q)
    return _READY[name]


def slices(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, bytes]]]:
    """The items in slices of a checked size, each small enough to broadcast; equal (id, text) rows once."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text") > 0).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // SLICE_BYTES)
    for s in range(n):
        part = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == s).collect()
        yield [(r["id"], normal(r["text"])) for r in part]


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    edits: int = EDITS,
    q: int = Q,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, item, start, item_start, edits): a row for each document and each item of which it holds a window.

    ``edits`` is the least of all windows; ``start`` and ``item_start`` say where one such window lies in
    the document (to within the edits) and in the item, in bytes of the normal form.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, item {item_kind}, start int, item_start int, edits int"
    out = None
    for items in slices(benchmark, item_id_col, item_text_col):
        shared, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            index = None
            for batch in batches:
                index = index or ready(name, shared.value, window, edits, q)
                ids, texts, size = [], [], 0
                for k in range(batch.num_rows + 1):
                    if k == batch.num_rows or size >= SCAN_BYTES:
                        found = [(i, *f) for i, got in zip(ids, index.search(texts), strict=True) for f in got]
                        if found:
                            types = [batch.schema.field(0).type, None, *[pa.int32()] * 3]
                            cols = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
                            yield pa.RecordBatch.from_arrays(cols, names=["id", "item", "start", "item_start", "edits"])
                        ids, texts, size = [], [], 0
                    if k < batch.num_rows:
                        ids.append(batch.column(0)[k].as_py())
                        texts.append(normal(batch.column(1)[k].as_py()))
                        size += len(texts[-1])

        part = rows.mapInArrow(freeing(scan), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_col, "item": item_id_col})
