"""SimHash near-duplicates: word-shingle fingerprints, tiled exact comparison, components.

Distinct fingerprints are dealt into strips; a task takes two strips and cuts them into tiles
of one population count each. Tiles whose counts differ by more than the radius cannot
hold a link and are skipped; every other pair of tiles is compared whole by
exclusive-or and bit count. A pair of strips emits a spanning forest of its links, never the
links themselves, so a group of any size costs a row per member. A fingerprint travels
once for each strip: that is the square root of the number of tasks, until strips are full.

``verified_groups`` holds texts against each other only where they can have the similarity. Shingles
are put in one order, the rarest first. Of two texts with a Jaccard similarity of ``least`` or more, the first
n - ceil(least * n) + 1 shingles of each have one in common. Most shingles are in one text only, so most texts
have as many of their own and go no further; the others are joined to what shares such a shingle
with them. Fingerprints and whole sets are made of these alone. Their components are cut into chunks, a task takes two chunks and compares every
pair by fingerprints and by whole shingle sets, and emits a spanning forest of the links. So no pair
is ever a row, a group of any size costs a row per member and tile, and the rest is linear in the texts.

Defined results: a null or empty text, or one of blanks only, has no words and
the fingerprint zero, which links like any other; texts with fewer words than a
shingle are one shingle; very long texts are read whole; equal texts share one
fingerprint and are compared once; repeated rows and repeated or null ids each keep
their row (a null id is never the smallest of a component unless all are null); an
empty table gives an empty result; columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.graph import connected_components
from shoal.runtime import durable, freeing, release, ship

#: Most fingerprints in a strip, and least if there are tasks enough; elements of one block of the comparison.
STRIP, LEAST_STRIP, BLOCK = 1 << 19, 256, 1 << 18
#: For each byte value, its eight bits, lowest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
SEEDS = (42, 43)
#: An odd factor; a rolled hash is a polynomial in it of the words' hashes.
ROLL = np.uint64(0x9E3779B97F4A7C15)
#: Members of a chunk; chunks of a component until chunks are full; members of a full chunk; elements of a block of the comparison of sets.
CHUNK, CHUNKS, FULL_CHUNK, SET_BLOCK = 64, 64, 1024, 1 << 20
#: Most parts into which shingles are dealt.
MOST_PARTS = 512
#: Words of the small and of the large parity sketch: bit x is set if an odd number of the shingle hashes is x modulo its bits.
SKETCH, LARGE_SKETCH = 4, 16
#: Bytes of keys that are broadcast to find their texts; beyond, the join is shuffled.
BROADCAST_BYTES = 32 << 20


def shingles(text: str | None, shingle: int = 3) -> list[bytes]:
    """Every run of ``shingle`` words, in order; of fewer words, the one run there is."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly \x20 \x09-\x0D
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - [len(w) for w in words]).tolist()
    ends = ends.tolist()
    k = min(shingle, len(words))
    return [joined[i:j] for i, j in zip(starts, ends[k - 1 :], strict=False)]


def hashes(pieces: list[bytes], seed: int = SEEDS[0]) -> np.ndarray:
    """XXH64 of every piece."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, seed) for p in pieces), dtype="<u8", count=len(pieces))


def shingle_set(text: str | None, shingle: int = 3) -> np.ndarray:
    """The distinct shingles of ``text`` as sorted 64-bit hashes."""
    return np.unique(hashes(shingles(text, shingle)))


def rolled_set(text: str | None, shingle: int = 3) -> np.ndarray:
    """As ``shingle_set`` by other hashes, each made of those of its words, so that no shingle is cut out."""
    h = hashes((text or "").encode().lower().split())
    n = len(h) - min(shingle, len(h)) + 1 if len(h) else 0
    out = np.zeros(n, np.uint64)
    for at in range(len(h) - n + 1 if n else 0):
        out = out * ROLL + h[at : at + n]
    return np.unique(out)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common members of two sorted sets; of two empty ones 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / union if (union := len(a) + len(b) - both) else 1.0


def sketch(members: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """The parity sketch of a shingle set: two sketches differ in no more bits than their sets in members."""
    odd = np.bincount((members % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def least_apart(n: np.ndarray, m: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """In how many members two sets differ at least, by their sizes and sketches."""
    return np.maximum(np.bitwise_count((p ^ q).view(np.uint64)).sum(axis=1, dtype=np.int64), np.abs(n - m))


def can_be_similar(n: np.ndarray, m: np.ndarray, p: np.ndarray, q: np.ndarray, least: float) -> np.ndarray:
    """False where sizes and sketches alone rule out a Jaccard similarity of ``least``; never where the sets have it."""
    return least_apart(n, m, p, q) * (1 + least) <= (1 - least) * (n + m) + 1e-6


def nearest_of(groups: np.ndarray, apart: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the pairs (a, b) of each row of ``groups`` the places of the nearest; ties to the smaller numbers."""
    order = np.lexsort((b, a, apart, groups[:, 1], groups[:, 0]))
    g = groups[order]
    return order[np.r_[True, (g[1:] != g[:-1]).any(axis=1)]] if len(order) else order


def majority(h: np.ndarray) -> int:
    """The signed word whose bits are set in over half of all hashes; of none zero."""
    ones = np.concatenate([np.bincount(x, minlength=256) @ BITS for x in h.view(np.uint8).reshape(-1, 8).T])
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int = 3, seeds: tuple[int, ...] = (42,)) -> list[int]:
    """A signed 64-bit word per seed: a bit is set if over half of all shingle hashes have it."""
    pieces = shingles(text, shingle)
    return [majority(hashes(pieces, seed)) for seed in seeds]


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f0[, f1]): the fingerprint words of every row, in one narrow pass."""
    ship(docs.sparkSession)
    names = [f"f{i}" for i in range(words)]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t.as_py(), shingle, SEEDS[:words]) for t in batch.column(1)], dtype=np.int64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[:, i]) for i in range(words))], names=["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(freeing(make), f"id {kind}, " + ", ".join(f"{x} long" for x in names))


def merge_labels(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``labels`` (each node's smallest known node) after linking u[i] with v[i], by pointer jumping on minima."""
    while True:
        a, b = labels[u], labels[v]
        apart = a != b
        if not apart.any():
            return labels
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels != (jumped := labels[labels])).any():
            labels = jumped


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int, first_radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of the links between two tiles (within one if right is None, then i < j), in blocks.

    Tiles are (n, words). The words are compared one after another: a pair that is over
    ``first_radius`` in the first word is dropped, the rest is held against ``radius`` over all words.
    """
    n = len(left)
    other = left if right is None else right
    step = max(1, BLOCK // max(1, len(other)))
    for at in range(0, n, step):
        block = left[at : at + step]
        near = np.bitwise_count(block[:, 0, None] ^ other[None, :, 0]) <= first_radius
        if right is None:
            near &= np.arange(len(other))[None, :] > np.arange(at, at + len(block))[:, None]
        hits = np.flatnonzero(near)
        if not len(hits):
            continue
        i, j = np.divmod(hits, len(other))
        if left.shape[1] > 1:
            close = np.bitwise_count(block[i] ^ other[j]).sum(axis=1) <= radius
            i, j = i[close], j[close]
        yield i + at, j


def forest(n: int, links: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Indices (child, parent) of a spanning forest of ``links`` between ``n`` nodes."""
    labels = np.arange(n)
    for i, j in links:
        labels = merge_labels(labels, i, j)
    child = np.flatnonzero(labels != np.arange(n))
    return child, labels[child]


def by_count(words: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the rows by the population count of their first word, and (count, begin, end) of each tile."""
    counts = np.bitwise_count(words[:, 0])
    order = np.argsort(counts, kind="stable")
    edges = np.searchsorted(counts[order], np.arange(66))
    return order, [(c, int(edges[c]), int(edges[c + 1])) for c in range(65) if edges[c] < edges[c + 1]]


def strip_links(left: np.ndarray, right: np.ndarray | None, radius: int, first_radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of the links between two strips (within one if right is None), tile pair by tile pair."""
    order, tiles = by_count(left)
    other, others = (order, tiles) if right is None else by_count(right)
    for p, a, b in tiles:
        for q, c, d in others:
            if abs(p - q) > first_radius or (right is None and q < p):
                continue
            one = right is None and p == q
            for i, j in tile_links(left[order[a:b]], None if one else (left if right is None else right)[other[c:d]], radius, first_radius):
                yield order[a:b][i], other[c:d][j]


def spanning_links(
    distinct: DataFrame, radius: int = 3, first_radius: int | None = None, apart: str | None = None, least: float | None = None, nearest: bool = False
) -> DataFrame:
    """(a, b): row numbers ``k`` of ``distinct(k, f0[, f1])`` whose links connect all that lie within ``radius`` bits.

    With ``apart``, the name of a long column, these are not the links of a spanning forest
    but all links between rows that differ in that column; with ``nearest``, of the links between rows of
    two values only the nearest in a pair of strips. With ``least``, links count only where
    the sizes ``n`` and sketches ``p0``.. allow that similarity.
    """
    spark = distinct.sparkSession
    names = [c for c in distinct.columns if c.startswith("f")]
    extra = (["n", *[f"p{i}" for i in range(SKETCH)]] if least is not None else []) + ([apart] if apart else [])
    own = ["k", *names, *extra]
    first_radius = radius if first_radius is None else first_radius
    n = distinct.count()
    strips = max(1, -(-n // STRIP), min(ceil(sqrt(4 * spark.sparkContext.defaultParallelism)), -(-n // LEAST_STRIP)))
    dealt = distinct.withColumn("s", F.pmod(F.xxhash64(*names), F.lit(strips)).cast("int"))
    whole = durable(dealt.groupBy("s").agg(F.collect_list(F.struct(*own)).alias("rows")).select("s", *[F.col(f"rows.{c}").alias(c) for c in own]), "strips")
    parts = max(strips * (strips + 1) // 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    left = whole.select("s", F.explode(F.sequence("s", F.lit(strips - 1))).alias("t"), *[F.col(c).alias(f"l{c}") for c in own])
    right = whole.filter("s > 0").select(F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("s"), F.col("s").alias("t"), *[F.col(c).alias(f"r{c}") for c in own])
    # a strip against itself is there once: it has no right side
    paired = left.repartition(parts, "s", "t").join(right.repartition(parts, "s", "t"), ["s", "t"], "left").select(*[f"{side}{c}" for side in "lr" for c in own])
    w, e = len(names), len(extra)

    def side(columns: list[pa.Array], at: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray | None]:
        values = [c[at].values.to_numpy(zero_copy_only=False) for c in columns]
        words, more = np.stack(values[1 : 1 + w], axis=1).view(np.uint64), values[1 + w :]
        return values[0], words, more, np.stack(more[1 : 1 + SKETCH], axis=1) if least is not None else None

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                lk, lf, lx, lp = side(batch.columns[: 1 + w + e], at)
                same = not batch.column(1 + w + e)[at].is_valid
                rk, rf, rx, rp = (lk, lf, lx, lp) if same else side(batch.columns[1 + w + e :], at)

                def links():
                    for i, j in strip_links(lf, None if same else rf, radius, first_radius):
                        if apart:
                            differ = lx[-1][i] != rx[-1][j]
                            i, j = i[differ], j[differ]
                        if least is not None:
                            fits = can_be_similar(lx[0][i], rx[0][j], lp[i], rp[j], least)
                            i, j = i[fits], j[fits]
                        yield i, j if same or apart else j + len(lk)

                if nearest:
                    held = np.empty((0, 5), np.int64)  # both groups, how far apart, both rows
                    for i, j in links():
                        gi, gj = lx[-1][i], rx[-1][j]
                        held = np.concatenate([held, np.stack([np.minimum(gi, gj), np.maximum(gi, gj), least_apart(lx[0][i], rx[0][j], lp[i], rp[j]), lk[i], rk[j]], axis=1)])
                        if len(i):
                            held = held[nearest_of(held[:, :2], *held[:, 2:].T)]
                    if len(held):
                        yield pa.RecordBatch.from_arrays([pa.array(held[:, 3]), pa.array(held[:, 4])], names=["a", "b"])
                    continue
                if apart:
                    for i, j in links():
                        if len(i):
                            yield pa.RecordBatch.from_arrays([pa.array(lk[i]), pa.array(rk[j])], names=["a", "b"])
                    continue
                keys = lk if same else np.concatenate([lk, rk])
                child, parent = forest(len(keys), links())
                if len(child):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[child]), pa.array(keys[parent])], names=["a", "b"])

    out = durable(paired.mapInArrow(freeing(compare), "a long, b long"), "links")
    release(whole)
    return out


def near_duplicate_groups(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f0, component_id): component_id is the smallest id that links of at most ``radius`` bits reach; the fingerprint itself is the node."""
    ship(docs.sparkSession)
    marked = durable(fingerprints(docs, shingle, 1, id_col, text_col), "fingerprints")
    classes = durable(marked.groupBy("f0").agg(F.min("id").alias("least")).withColumn("k", F.col("f0")), "classes")
    links = spanning_links(classes.select("k", "f0"), radius)
    roots = connected_components(links)
    release(links)
    linked = classes.select("k", "least").join(roots.withColumnRenamed("node", "k"), "k")
    component = linked.select("k", "root").join(linked.groupBy("root").agg(F.min("least").alias("component")), "root").select("k", "component")
    resolved = durable(classes.join(component, "k", "left").select("f0", F.coalesce("component", "least").alias("component_id")), "resolved")
    release(classes)
    return marked.join(resolved, "f0").select(F.col("id").alias(id_col), "f0", "component_id")


def in_parts(values: np.ndarray, part: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For every part: its number, the owners that have values there, in order, how many each, and the places of these values."""
    order = np.lexsort((owner, part))
    part, owner = part[order], owner[order]
    for at in np.split(np.arange(len(values)), np.flatnonzero(part[1:] != part[:-1]) + 1):
        if len(at):
            who, count = np.unique(owner[at], return_counts=True)
            yield int(part[at[0]]), who, count, order[at]


def slack(n: int, codes: int, least: float) -> int:
    """How many of ``codes`` different codes of a set of ``n`` members may be shared with others before one of its first is."""
    return codes - (n - ceil(least * n - 1e-9) + 1)


#: Columns of the shingles of texts that are dealt to one part: keys of the texts, shingles of each, slack of each, the shingles.
DEALT = ("ks", "counts", "slacks", "codes")
DEALT_TYPES = ("<i8", "<u4", "<i4", "<u4")


def gathered(batches: Iterator[pa.RecordBatch], columns: dict[str, str], by: str) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For every value of ``by`` the arrays of all its rows, one after another."""
    held: dict[int, list[list[bytes]]] = {}
    for batch in batches:
        binary = [batch.column(c).to_pylist() for c in columns]
        for at, value in enumerate(batch.column(by).to_pylist()):
            rows = held.setdefault(value, [[] for _ in columns])
            for own, column in zip(rows, binary, strict=True):
                own.append(column[at])
    for value in list(held):
        yield value, [np.frombuffer(b"".join(x), kind) for x, kind in zip(held.pop(value), columns.values(), strict=True)]


def first_shared(dealt: DataFrame, parts: int) -> DataFrame:
    """(t, k): of every text ``k`` those of its first shingles ``t`` that other texts have too; ``dealt(p, ks, counts, slacks, codes)``.

    The order is by number of texts, then by code: what only one text has comes first, and is not written.
    """

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, (ks, counts, slacks, codes) in gathered(batches, dict(zip(DEALT, DEALT_TYPES, strict=True)), "p"):
            once = np.zeros(len(ks), bool)  # a text that is there repeatedly
            once[np.unique(ks, return_index=True)[1]] = True
            codes, ks, slacks, owner = codes[np.repeat(once, counts)], ks[once], slacks[once], np.repeat(np.arange(once.sum()), counts[once])
            _, inverse, texts = np.unique(codes, return_inverse=True, return_counts=True)
            texts = texts[inverse]
            often = texts > 1
            codes, owner, texts = codes[often], owner[often], np.minimum(texts[often], 65535)
            rows = [(h, p, ks[who].tobytes(), n.astype("<u4").tobytes(), slacks[who].tobytes(), codes[at].tobytes(), texts[at].astype("<u2").tobytes()) for h, who, n, at in in_parts(codes, ks[owner] % parts, owner)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), *(pa.binary(),) * 5), strict=True)], names=["h", "p", *DEALT, "texts"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_part = (b.append_column("ps", pa.array([np.full(len(c.as_py()) // 4, p.as_py(), "<u4").tobytes() for p, c in zip(b.column("p"), b.column("codes"), strict=True)], pa.binary())) for b in batches)
        columns = dict(zip(DEALT, DEALT_TYPES, strict=True)) | {"texts": "<u2", "ps": "<u4"}
        for _, (ks, counts, slacks, codes, texts, ps) in gathered(with_part, columns, "h"):
            keys, at, inverse = np.unique(ks, return_index=True, return_inverse=True)
            owner = np.repeat(inverse, counts)
            wanted = np.bincount(owner, minlength=len(keys)) - slacks[at]
            some = wanted[owner] > 0
            owner, texts, t = owner[some], texts[some], ps[some].astype(np.int64) << 32 | codes[some]
            order = np.lexsort((t, texts, owner))
            owner, t = owner[order], t[order]
            rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
            front = rank < wanted[owner]
            if front.any():
                yield pa.RecordBatch.from_arrays([pa.array(t[front]), pa.array(keys[owner[front]])], names=["t", "k"])

    binary = ", ".join(f"{c} binary" for c in (*DEALT, "texts"))
    back = dealt.repartition(parts, "p").mapInArrow(freeing(shared), f"h int, p int, {binary}")
    return durable(back.repartition(parts, "h").mapInArrow(freeing(first), "t long, k long"), "first")


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many members each set on the left has in common with each on the right."""
    members, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    sizes = [len(x) for x in (*left, *right)]
    row = np.repeat(np.arange(len(sizes)), sizes)
    on_left = row < len(left)
    both = (np.bincount(place[on_left], minlength=len(members)) > 0) & (np.bincount(place[~on_left], minlength=len(members)) > 0)
    column = (np.cumsum(both) - 1)[place]
    row, column = row[both[place]], column[both[place]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.int64)
    step = max(64, SET_BLOCK // len(sizes))
    for at in range(0, int(both.sum()), step):
        a, b = np.searchsorted(column, (at, at + step))
        has = np.zeros((len(sizes), step), np.float32)
        has[row[a:b], column[a:b] - at] = 1
        out += (has[: len(left)] @ has[len(left) :].T).astype(np.int64)  # at most ``step`` each, so exact
    return out


def tile_of_sets(
    left: tuple[np.ndarray, list[np.ndarray]], right: tuple[np.ndarray, list[np.ndarray]] | None, least: float, radius: int, first_radius: int
) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (i, j) of the links between two chunks of (fingerprints, sets), or within one if right is None, then i < j."""
    (lf, ls), (rf, rs) = left, right or left
    bits = np.bitwise_count(lf[:, None, :] ^ rf[None, :, :])
    near = (bits[:, :, 0] <= first_radius) & (bits.sum(axis=2, dtype=np.int64) <= radius)
    if right is None:
        near &= np.arange(len(lf))[:, None] < np.arange(len(lf))[None, :]
    if not near.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    both = common(ls, rs)
    union = np.array([len(x) for x in ls])[:, None] + np.array([len(x) for x in rs])[None, :] - both
    return np.nonzero(near & (np.where(union > 0, both / np.maximum(union, 1), 1.0) >= least))


def similar_links(candidates: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, least: float, radius: int, first_radius: int, words: int) -> DataFrame:
    """(a, b): a spanning forest, tile by tile, of the links between the texts of each component ``candidates(node, root)``."""
    names = [f"f{i}" for i in range(words)]
    large = candidates.groupBy("root").agg(F.count("*").alias("m")).filter(F.col("m") > CHUNK)
    chunks = F.greatest(F.least(F.ceil(F.col("m") / CHUNK), F.lit(CHUNKS)), F.ceil(F.col("m") / FULL_CHUNK)).cast("int")
    large = durable(large.select("root", chunks.alias("c")), "large")
    few = large.count() * 16 <= BROADCAST_BYTES
    members = candidates.join(F.broadcast(large) if few else large, "root", "left").select(F.col("node").alias("k"), "root", F.coalesce("c", F.lit(1)).alias("c"))
    members = durable(members.withColumn("i", F.pmod(F.xxhash64("k", "root"), "c").cast("int")).join(classes.select("k", "least"), "k"), "members")
    few = members.count() * 64 <= BROADCAST_BYTES
    ends = members.withColumnRenamed("k", "end")
    wanted = texts.join(F.broadcast(ends) if few else ends, (F.col("k") == F.col("end")) & F.col("id").eqNullSafe(F.col("least")))  # of equal texts the one of the smallest id
    kept = ["k", "root", "c", "i"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, sets = [], []
            for t in batch.column(len(kept)):
                pieces = shingles(t.as_py(), shingle)
                h = hashes(pieces)
                marks.append([majority(h), *(majority(hashes(pieces, seed)) for seed in SEEDS[1:words])])
                sets.append(np.unique(h).tobytes())
            marks = np.array(marks, np.int64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array(marks[:, i]) for i in range(words)), pa.array(sets, pa.binary())], names=[*kept, *names, "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows = None, []

        def links() -> Iterator[pa.RecordBatch]:
            sides = [[r for r in rows if r[3] == side] for side in (False, True)]
            if not sides[0] or tile[1] != tile[2] and not sides[1]:
                return
            left, right = ((np.array([r[5:-1] for r in x], np.int64).view(np.uint64), [np.frombuffer(r[-1], "<u8") for r in x]) if x else None for x in sides)
            i, j = tile_of_sets(left, right, least, radius, first_radius)
            keys = np.array([r[4] for x in sides for r in x], np.int64)
            child, parent = forest(len(keys), [(i, j + len(sides[0]) if right else j)])
            if len(child):
                yield pa.RecordBatch.from_arrays([pa.array(keys[child]), pa.array(keys[parent])], names=["a", "b"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:3] != tile:
                    yield from links()
                    tile, rows = r[:3], []
                rows.append(r)
        yield from links()

    kinds = ", ".join(f"{c} {'int' if c in 'ci' else 'long'}" for c in (*kept, *names))
    sets = durable(wanted.select(*kept, "text").dropDuplicates(["k"]).mapInArrow(freeing(make), f"{kinds}, s binary"), "sets")
    paired = sets.select("*", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("j"))
    paired = paired.select("root", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), (F.col("i") > F.col("j")).alias("right"), "k", *names, "s")
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = durable(paired.repartition(parts, "root", "x", "y").sortWithinPartitions("root", "x", "y").mapInArrow(freeing(compare), "a long, b long"), "similar")
    release(large, members, sets)
    return out


def verified_groups(
    docs: DataFrame,
    shingle: int,
    least: float,
    radius: int,
    words: int = 2,
    first_radius: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, component_id): the smallest id that is reached by links of a Jaccard similarity of ``least`` or more.

    Links are all pairs of that similarity within ``radius`` bits of each other, and ``first_radius`` in the first word.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_PARTS)
    first_radius = radius if first_radius is None else first_radius

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, slacks = [], []
            for t in batch.column(1):
                members = rolled_set(t.as_py(), shingle)
                members = members if len(members) else np.zeros(1, np.uint64)  # what has no shingles shares one
                # a code is the part and the upper half of a hash
                codes.append(np.unique(members % np.uint64(parts) << np.uint64(32) | members >> np.uint64(32)))
                slacks.append(slack(len(members), len(codes[-1]), least))
            if not codes:
                continue
            keys, slacks, owner, codes = batch.column(0).to_numpy(), np.array(slacks, "<i4"), np.repeat(np.arange(len(codes)), [len(x) for x in codes]), np.concatenate(codes)
            dealt = [(p, keys[who].astype("<i8").tobytes(), count.astype("<u4").tobytes(), slacks[who].tobytes(), codes[at].astype("<u4").tobytes()) for p, who, count, at in in_parts(codes, codes >> np.uint64(32), owner)]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*dealt, strict=True), (pa.int32(), *(pa.binary(),) * 4), strict=True)], names=["p", *DEALT])

    for seed in range(42, 50):
        # a class is a text, known by its hash; where two texts share that, another seed is taken
        texts = rows.select(F.xxhash64("text", F.lit(seed)).alias("k"), F.xxhash64("text", F.lit(-seed)).alias("k2"), "id", "text")
        marked = durable(texts.select("k", "k2", "id"), "marked")
        classes = durable(marked.groupBy("k").agg(F.min("id").alias("least"), (F.min("k2") == F.max("k2")).alias("one")), "classes")
        if classes.filter("not one").isEmpty():
            break
        release(marked, classes)
    # the shingles of all texts are shuffled, never written
    first = first_shared(texts.select("k", "text").mapInArrow(freeing(deal), "p int, " + ", ".join(f"{c} binary" for c in DEALT)), parts)
    # minima are written before they are joined, as in ``connected_components``
    heads = durable(first.groupBy("t").agg(F.min("k").alias("m"), F.count("*").alias("n")).filter("n > 1").select("t", "m"), "heads")
    candidates = durable(connected_components(first.join(heads, "t").select(F.col("k").alias("a"), F.col("m").alias("b"))), "candidates")
    release(first, heads)
    links = similar_links(candidates, classes, texts, shingle, least, radius, first_radius, words)
    roots = connected_components(links).withColumnRenamed("node", "k")
    linked = classes.select("k", "least").join(roots, "k")
    component = linked.select("k", "root").join(linked.groupBy("root").agg(F.min("least").alias("component")), "root").select("k", "component")
    resolved = durable(classes.join(component, "k", "left").select("k", F.coalesce("component", "least").alias("component_id")), "resolved")
    release(classes, candidates, links)
    return marked.join(resolved, "k").select(F.col("id").alias(id_col), "component_id")
