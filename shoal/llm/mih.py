"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

A rotation is learned by iterative quantisation on a bounded sample, so that the signs
of the rotated, centred vectors lose little. Codes are split into substrings, and every
block of the index keeps one table for each. Codes within ``radius`` bits of a query
agree with it up to radius / substrings bits in some substring (the pigeonhole
principle, sharpened for the remainder), so probing these buckets finds them all;
the codes found are checked and the original vectors ranked by exact distance. The
radius is measured at fitting: the one that holds nearly all true neighbours in the
sample. A query that has fewer than ``k`` rows of the sample within it gets a radius that holds
``k`` of them, so every query finds ``k`` rows.

The index stays where it lies: its rows are neither shuffled nor copied. Queries, a stated set, go to
it in broadcast slices of a measured size, each with the distance of its k-th nearest
sample row; only rows found within that distance leave a task, at most ``k`` + 1 a block.

Defined results: vectors that are null, zero, or that hold null or non-finite components take no
part; missing components of shorter vectors count as 0. A row without an id is a candidate
(ties: after all others) but no query. Repeated ids are rows of their own: each query row leaves
out itself and nothing else, and repeated query rows each have their result. Ties go to the
smaller id; fewer candidates than ``k`` are all returned; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoal.runtime import durable, freeing, ship

#: Bits of a code and of a substring; rows and bytes that the rotation is learned from at most; steps of learning.
BITS, SUBSTRING, SAMPLE, SAMPLE_BYTES, STEPS = 64, 8, 20_000, 64 << 20, 30
#: Share of the sample's true neighbours that the radius must hold; sample queries that measure it.
HELD, MEASURED = 0.985, 256
#: Rows of an index block; bytes of queries that are broadcast at once.
INDEX_BLOCK, SLICE_BYTES = 16_384, 16 << 20


def learn_rotation(x: np.ndarray, steps: int, rng: np.random.Generator) -> np.ndarray:
    """An orthogonal matrix that brings the rows of ``x`` near to the corners of a cube."""
    r = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(steps):
        u, _, vt = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
        r = (u @ vt).T
    return r


@dataclass(frozen=True)
class BinaryCodes:
    mean: np.ndarray
    turn: np.ndarray
    radius: int

    @classmethod
    def fit(cls, x: np.ndarray, k: int, bits: int = BITS, seed: int = 0) -> BinaryCodes:
        rng = np.random.default_rng(seed)
        mean = x.mean(axis=0)
        parts = [learn_rotation(x - mean, STEPS, rng) for _ in range(-(-bits // x.shape[1]))]
        codes = cls(mean, np.concatenate(parts, axis=1)[:, :bits], bits)
        own = codes.encode(x)
        distances = []
        for i in rng.permutation(len(x))[:MEASURED]:
            d = ((x - x[i]) ** 2).sum(axis=1)
            d[i] = np.inf
            near = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
            distances.append(np.bitwise_count(own[near] ^ own[i]).sum(axis=1))
        flat = np.concatenate(distances) if distances else np.zeros(1)
        return cls(mean, codes.turn, int(np.quantile(flat, HELD)) if len(flat) else bits)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """A row of bytes for each vector."""
        return np.packbits((x - self.mean) @ self.turn >= 0, axis=1)


def masks(bits: int) -> list[np.ndarray]:
    """For each number of flipped bits up to 8, all values of a substring with at most so many bits set."""
    out = []
    for most in range(bits + 1):
        values = [sum(1 << b for b in c) for n in range(most + 1) for c in itertools.combinations(range(bits), n)]
        out.append(np.array(values, dtype=np.int64))
    return out


MASKS = masks(SUBSTRING)


class Block:
    """Substring tables over a block of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.rows, self.first = [], []
        for j in range(codes.shape[1]):
            rows = np.argsort(self.codes[:, j], kind="stable")
            self.rows.append(rows)
            self.first.append(np.searchsorted(self.codes[rows, j], np.arange(257)))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows within ``radius`` bits of ``code``, by probing the tables."""
        m = len(self.rows)
        whole, rest = divmod(radius, m)
        seen = np.zeros(len(self.codes), bool)
        for j in range(m):
            # if every one of the first rest + 1 substrings differed by more than whole bits and the others by whole or more, the sum would pass the radius
            most = whole if j <= rest else whole - 1
            if most < 0:
                continue
            values = MASKS[min(most, SUBSTRING)] ^ int(code[j])
            start = self.first[j][values]
            n = self.first[j][values + 1] - start
            flat = np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            seen[self.rows[j][flat]] = True
        found = np.flatnonzero(seen)
        return found[np.bitwise_count(self.codes[found] ^ code).sum(axis=1) <= radius]

def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, v): rows that take part, as long as the longest of them, and that length."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(
        F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    least, most = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if least == most:
        return rows, most or 0
    return rows.select("id", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(most) - F.size("v"))).alias("v")), most


def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (0 for null), which of them are null, and the vectors as a matrix."""
    ids, v = batch.column(0), batch.column(1)
    x = v.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), pc.is_null(ids).to_numpy(zero_copy_only=False), x


def reaches(codes: BinaryCodes, ids: np.ndarray, x: np.ndarray, k: int, qid: np.ndarray, q: np.ndarray) -> tuple[list[int], list[float]]:
    """For each query the radius to search, and a distance within which it surely has ``k`` rows."""
    own, bits, radii, bounds = codes.encode(x), codes.turn.shape[1], [], []
    for i, v, c in zip(qid, q, codes.encode(q), strict=True):
        apart = np.bitwise_count(own ^ c).sum(axis=1, dtype=np.int64)
        itself = np.flatnonzero((ids == i) & (x == v).all(axis=1))[:1]
        others = np.delete(np.arange(len(x)), itself)
        if len(others) < k:
            radii.append(bits)
            bounds.append(float("inf"))
            continue
        radii.append(max(codes.radius, int(np.partition(apart[others], k - 1)[k - 1])))
        found = others[apart[others] <= radii[-1]]
        bounds.append(float(np.partition(distances(x[found], v), k - 1)[k - 1]) * (1 + 1e-9))
    return radii, bounds


def nearest_neighbours(
    vectors: DataFrame, k: int = 10, every: int = 100, bits: int = BITS, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest rows found for every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    ship(spark)
    rows, length = usable(vectors, id_col, vector_col)
    width = 8 * length
    if not width:
        found = spark.createDataFrame([], "q long, query_id long, copies long, id long, score double")
    else:
        fitted = rows.orderBy(F.xxhash64("id", "v"), "id", "v").limit(max(1, min(sample, SAMPLE_BYTES // width))).collect()  # bounded in rows and bytes
        x = np.array([r["v"] for r in fitted])
        shared = spark.sparkContext.broadcast((BinaryCodes.fit(x, k, bits), np.array([-1 if r["id"] is None else r["id"] for r in fitted]), x))
        asked = rows.filter(F.pmod("id", F.lit(every)) == 0).groupBy("id", "v").agg(F.count("*").alias("copies"))

        def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, ids, x = shared.value
            for batch in batches:
                if batch.num_rows:
                    qid, _, q = columns(batch)
                    radii, bounds = reaches(codes, ids, x, k, qid, q)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(radii, pa.int32()), pa.array(bounds, pa.float64())], names=["id", "v", "copies", "radius", "bound"])

        queries = durable(asked.mapInArrow(freeing(prepare), "id long, v array<double>, copies long, radius int, bound double"), "queries")
        slices = max(1, -(-queries.count() * (width + 64) // SLICE_BYTES))
        parts, before = [], 0
        for s in range(slices):
            own = queries.filter(F.pmod(F.xxhash64("id", "v"), F.lit(slices)) == s).orderBy("id", "v").collect()  # about SLICE_BYTES
            part = search(rows, shared, own, before, k)
            parts.append(durable(part, "found") if slices > 1 else part)
            before += len(own)
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
    best = Window.partitionBy("q").orderBy("score", F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k + 1)
    # the query's own row, once
    itself = F.min(F.when((F.col("id") == F.col("query_id")) & (F.col("score") == 0), F.col("rank"))).over(Window.partitionBy("q"))
    others = ranked.withColumn("itself", F.coalesce(itself, F.lit(k + 2))).filter("rank != itself")
    numbered = others.withColumn("rank", F.col("rank") - (F.col("rank") > F.col("itself")).cast("int")).filter(F.col("rank") <= k)
    each = numbered.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def search(rows: DataFrame, shared, queries: list, before: int, k: int) -> DataFrame:
    """(q, query_id, copies, id, score): of every block of ``rows`` at most ``k`` + 1 within reach of each query, the queries numbered from ``before`` on."""
    spark = rows.sparkSession
    q = np.array([r["v"] for r in queries])
    numbers = [np.array([r[c] for r in queries]) for c in ("id", "copies", "radius", "bound")]
    asked = spark.sparkContext.broadcast((q, *numbers))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, INDEX_BLOCK):
                part = batch.slice(at, INDEX_BLOCK)
                if n + part.num_rows > INDEX_BLOCK:
                    yield tuple(map(np.concatenate, zip(*held, strict=True)))
                    held, n = [], 0
                held.append(columns(part))
                n += part.num_rows
        if n:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, (q, qid, copies, radius, bound) = shared.value[0], asked.value
        asked_codes = codes.encode(q) if len(q) else []
        for ids, missing, x in blocks(batches):
            block, out = Block(codes.encode(x)), []
            for i, code in enumerate(asked_codes):
                near = block.within(code, int(radius[i]))
                d = distances(x[near], q[i])
                near, d = near[d <= bound[i]], d[d <= bound[i]]
                order = np.lexsort((ids[near], missing[near], d))[: k + 1]
                out.append((np.full(len(order), i), near[order], d[order]))
            if out:
                i, near, d = map(np.concatenate, zip(*out, strict=True))
                found = [pa.array(before + i), pa.array(qid[i]), pa.array(copies[i]), pa.array(ids[near], mask=missing[near]), pa.array(d)]
                yield pa.RecordBatch.from_arrays(found, names=["q", "query_id", "copies", "id", "score"])

    return rows.mapInArrow(freeing(find), "q long, query_id long, copies long, id long, score double")
