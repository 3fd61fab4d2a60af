"""Minimax contiguous sharding of ordered atomic groups.

Groups are ordered by the 64-bit hash of their key, so that a shard is a range of
hashes: rows find their shard by comparing with the cut points, without a join. The
smallest capacity with which greedy filling needs no more than the wanted shards is
found by binary search over group sizes. The sizes are never gathered: the search
runs over a histogram by hash prefix and refines only the prefixes in which a cut
can still fall, until lower and upper bound of the capacity meet.

Defined results: a null key or text counts as the empty one (size 1, checksum 0) and
shares its group; two keys of equal hash form one group, which still keeps equal keys
together; repeated rows and repeated or null ids get a slot each; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoal.runtime import durable

#: Bits by which a pass splits a prefix; prefixes refined in one pass; rows in a numbering bucket.
SPLIT_BITS, REFINED_AT_ONCE, BUCKET_ROWS = 10, 64, 20_000


@dataclass(frozen=True)
class Segment:
    """A range of hashes in order: its first and last hash that occur, and its bytes."""

    first: int
    last: int
    size: int
    bits: int

    @property
    def atomic(self) -> bool:
        return self.first == self.last


def greedy_cuts(segments: list[Segment], capacity: int, shards: int, divisible: bool) -> list[int] | None:
    """Fill shard after shard up to ``capacity``; the byte offset where each ends, or None if the shards don't suffice.

    Segments that hold several groups are atoms, or with ``divisible`` can be cut anywhere.
    """
    ends, filled, at = [], 0, 0
    for s in segments:
        left = s.size
        while filled + left > capacity:
            if divisible and not s.atomic:
                left -= capacity - filled
                at += capacity - filled
            elif left > capacity:
                return None
            ends.append(at)
            filled = 0
            if len(ends) >= shards:
                return None
        filled += left
        at += left
    return [*ends, at]


def smallest_capacity(segments: list[Segment], shards: int, divisible: bool) -> int:
    """Binary search for the least capacity with which ``greedy_cuts`` succeeds."""
    total = sum(s.size for s in segments)
    low, high = max(1, -(-total // shards)), max(1, total)
    while low < high:
        mid = (low + high) // 2
        if greedy_cuts(segments, mid, shards, divisible) is None:
            low = mid + 1
        else:
            high = mid
    return low


def undecided(segments: list[Segment], low: int, high: int, shards: int) -> list[Segment]:
    """The segments of several groups in which a greedy cut for some capacity from ``low`` to ``high`` can fall."""
    large = [s for s in segments if not s.atomic and s.size > low]
    if large:
        return large
    out, at = [], 0
    reach = max(s.size for s in segments)
    for s in segments:
        # the j-th cut lies at most j*capacity in, and each shard before it is short by less than one segment
        hit = any(at < j * high and at + s.size > j * (low - reach) for j in range(1, shards))
        if hit and not s.atomic:
            out.append(s)
        at += s.size
    return out


def histogram(groups: DataFrame, segments: list[Segment] | None, bits: int) -> list[Segment]:
    """Sizes by the first ``bits`` bits of the hash, within the prefixes of ``segments`` (None: all)."""
    rows = groups
    if segments is not None:
        known = segments[0].bits
        rows = rows.filter(F.shiftright("h", 64 - known).isin([s.first >> (64 - known) for s in segments]))
    made = rows.groupBy(F.shiftright("h", 64 - bits).alias("p")).agg(F.min("h").alias("a"), F.max("h").alias("b"), F.sum("size").alias("n"))
    return [Segment(r["a"], r["b"], r["n"], bits) for r in made.collect()]  # at most 2**SPLIT_BITS * REFINED_AT_ONCE rows


def minimax_segments(rows: DataFrame, shards: int) -> tuple[list[Segment], int]:
    """Segments in order, fine enough for the smallest feasible capacity, and that capacity."""
    segments = sorted(histogram(rows, None, SPLIT_BITS), key=lambda s: s.first)
    while segments:
        low, high = smallest_capacity(segments, shards, True), smallest_capacity(segments, shards, False)
        if low >= high:
            break
        open_ = undecided(segments, low, high, shards)
        if not open_:
            break
        bits = min(s.bits for s in open_)
        chosen = sorted((s for s in open_ if s.bits == bits), key=lambda s: -s.size)[:REFINED_AT_ONCE]
        finer = histogram(rows, chosen, min(64, bits + SPLIT_BITS))
        segments = sorted([*(s for s in segments if s not in set(chosen)), *finer], key=lambda s: s.first)
    return segments, smallest_capacity(segments, shards, False) if segments else 1


def even_cuts(segments: list[Segment], capacity: int, shards: int) -> list[int]:
    """Last hashes of shards 0 to shards-2: no shard over ``capacity``, and each as near as that allows to an even share."""
    ends = [0]
    for s in segments:
        ends.append(ends[-1] + s.size)
    latest = [len(segments)]  # latest[j]: the least place at which the last j shards can begin
    for _ in range(shards):
        at = latest[-1]
        while at and ends[latest[-1]] - ends[at - 1] <= capacity:
            at -= 1
        latest.append(at)
    cuts, at = [], 0
    for left in range(shards - 1, 0, -1):
        target = ends[at] + (ends[-1] - ends[at]) / (left + 1)
        last = at
        while last < len(segments) and ends[last + 1] - ends[at] <= capacity:
            last += 1
        places = range(max(at, latest[left]), last + 1)
        at = min(places, key=lambda k: abs(ends[k] - target))
        cuts.append(segments[at - 1].last if at else -(1 << 63))
    return cuts


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard): equal texts share a shard, the largest shard is as small as can be."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = durable(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        ),
        "sizes",
    )
    segments, capacity = minimax_segments(rows, shards)
    shard = F.lit(0)
    for cut in even_cuts(segments, capacity, shards) if segments else []:
        shard = shard + F.when(F.col("h") > F.lit(cut), 1).otherwise(0)
    buckets = max(32, -(-rows.count() // BUCKET_ROWS))
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("bucket", F.pmod(F.xxhash64("id", "h"), F.lit(buckets)).cast("int"))
    # a shard may hold a third of all rows: number rows within buckets, and add what the buckets before hold
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("h", "id"))
    return (
        placed.withColumn("at", within)
        .join(offsets, ["shard", "bucket"])
        .select(
            F.col("id").alias(id_col),
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("base") + F.col("at") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
