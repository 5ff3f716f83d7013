"""Sharding: contiguous partition of ordered atomic groups with the smallest possible largest shard.

Groups are documents of equal text, ordered by a hash of the text.  The
smallest feasible capacity is found by binary search over capacities, each
checked by filling shards greedily; the documents are then cut at those
places.  Group sizes stay distributed: the driver sees at most
``2**SEGMENT_BITS`` segment sums at a time, and asks for finer segments only
where a cut could fall inside one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.llm.tables import Saved

#: The first segments have as many leading bits of the hash, each refinement as many more.
SEGMENT_BITS, FINER_BITS = 16, 12


class Segments:
    """Ordered segments: first hash (shifted to unsigned), size, size of the largest group, number of groups, bits."""

    def __init__(self, low, size, largest, groups, bits):
        order = np.argsort(low)
        self.low, self.size, self.largest, self.groups, self.bits = (np.asarray(x)[order] for x in (low, size, largest, groups, bits))
        self.ends = np.cumsum(self.size, dtype=np.int64)
        self.total = int(self.ends[-1]) if len(self.ends) else 0

    def whole_cuts(self, capacity: int, shards: int) -> list[int] | None:
        """Cut numbers (segments before the cut) of a greedy filling that keeps segments whole; None if it fails."""
        at, cuts = 0, []
        for _ in range(shards):
            start = int(self.ends[at - 1]) if at else 0
            at = int(np.searchsorted(self.ends, start + capacity, side="right"))
            cuts.append(at)
        return cuts if at >= len(self.ends) else None

    def earliest_cuts(self, capacity: int, shards: int) -> list[int]:
        """The same from the end: the earliest cuts from which the rest still fits."""
        at, cuts = len(self.ends), []
        starts = self.ends - self.size
        for _ in range(shards):
            cuts.append(at)
            end = int(self.ends[at - 1]) if at else 0
            at = min(at, int(np.searchsorted(starts, end - capacity, side="left")))
        return cuts[::-1]

    def reach(self, capacity: int, shards: int) -> tuple[list[int], list[int]]:
        """Lowest and highest size at which each greedy cut can be, as divisible segments are not known inside."""
        low = high = 0
        lows, highs = [], []
        for _ in range(shards):
            lows.append(low := self._cut(low, capacity, False))
            highs.append(high := self._cut(high, capacity, True))
        return lows, highs

    def _cut(self, start: int, capacity: int, hopeful: bool) -> int:
        goal = start + capacity
        if goal >= self.total:
            return self.total
        i = int(np.searchsorted(self.ends, goal, side="right"))
        begin = int(self.ends[i] - self.size[i])
        if self.groups[i] == 1:
            return max(start, begin)
        return goal if hopeful else max(start, begin, goal - int(self.largest[i]))


def _smallest(low: int, high: int, fits) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def minimax_cuts(segments: Segments, shards: int, finer) -> tuple[int, list[int]]:
    """(smallest capacity, the first hash of each shard but the first).

    finer(rows) returns segments to put in place of segments[rows].
    """
    while True:
        least = max(int(segments.largest.max(initial=0)), -(-segments.total // shards))
        upper = _smallest(least, segments.total, lambda c: segments.whole_cuts(c, shards) is not None)
        lower = _smallest(least, upper, lambda c: segments.reach(c, shards)[1][-1] >= segments.total)
        if lower == upper:
            break
        lows, highs = segments.reach(lower, shards)[0], segments.reach(upper, shards)[1]
        unsure = np.zeros(len(segments.ends), bool)
        for a, b in zip(lows[:-1], highs[:-1], strict=True):
            unsure |= (segments.ends > a) & (segments.ends - segments.size <= b)
        unsure = np.flatnonzero(unsure & (segments.groups > 1) & (segments.bits < 64))
        if not len(unsure):
            break
        segments = finer(segments, unsure)
    # Within the smallest capacity, each cut goes where the rest would be shared evenly.
    latest, earliest, cuts, at = segments.whole_cuts(upper, shards), segments.earliest_cuts(upper, shards), [], 0
    for k in range(shards - 1):
        start = int(segments.ends[at - 1]) if at else 0
        goal = start + (segments.total - start) / (shards - k)
        near = int(np.searchsorted(segments.ends, goal, side="left"))
        before = int(segments.ends[near - 1]) if near else 0
        if near < len(segments.ends) and int(segments.ends[near]) - goal < goal - before:
            near += 1
        most = int(np.searchsorted(segments.ends, start + upper, side="right"))
        at = max(at, min(max(near, earliest[k]), most, latest[k]))
        cuts.append(at)
    return upper, [int(segments.low[c]) if c < len(segments.low) else 1 << 64 for c in cuts]


def shard(docs: DataFrame, shards: int = 24, rows_per_block: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs(doc_id, text, ...).

    The law is `bytes`: shard sizes (UTF-8 bytes plus 8 a row) are as equal as
    whole groups of equal text let them be, with the largest as small as it
    can be.  Null text counts as empty (size 8, checksum 0) and shares the
    group of empty texts; a null doc_id is an id like others; equal rows each
    keep a row and a slot of their own (which of them has which doesn't
    matter); an empty table gives no rows; further columns are not read.
    Every slot 0 ... n-1 of a shard is taken once.
    """
    save = Saved(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = save(docs.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")))
    groups = save(rows.groupBy("h").agg(F.sum("size").alias("size"), F.count("*").alias("rows")))

    def fetch(bits: int, within: DataFrame) -> list[np.ndarray]:
        """Segments of so many leading bits; low: the first hash of each, with the sign bit flipped (so unsigned order)."""
        key = F.shiftright("h", 64 - bits) if bits < 64 else F.col("h")
        found = within.groupBy(key.alias("k")).agg(F.sum("size").alias("size"), F.max("size").alias("largest"), F.count("*").alias("groups"), F.min("h").alias("low"), F.sum("rows").alias("rows")).collect()
        return [np.array([int(r["low"]) + (1 << 63) for r in found], object), *(np.array([r[c] for r in found], np.int64) for c in ("size", "largest", "groups")), np.full(len(found), bits), sum(r["rows"] for r in found)]

    def finer(segments: Segments, unsure: np.ndarray) -> Segments:
        bits = min(64, int(segments.bits[unsure].min()) + FINER_BITS)
        unsure = unsure[segments.bits[unsure] < bits]
        had = int(segments.bits[unsure].min())
        unsure = unsure[segments.bits[unsure] == had]
        keys = [(int(x) >> (64 - had)) - (1 << (had - 1)) for x in segments.low[unsure]]
        wanted = docs.sparkSession.createDataFrame([(k,) for k in keys], "k long")
        new = fetch(bits, groups.withColumn("k", F.shiftright("h", 64 - had)).join(F.broadcast(wanted), "k", "left_semi"))
        kept = np.ones(len(segments.low), bool)
        kept[unsure] = False
        return Segments(*(np.concatenate([getattr(segments, n)[kept], x]) for n, x in zip(("low", "size", "largest", "groups", "bits"), new, strict=False)))

    first = fetch(SEGMENT_BITS, groups)
    n_rows = first.pop()
    _, cuts = minimax_cuts(Segments(*first), shards, finer)
    number = F.lit(0)
    for cut in cuts:
        number = number + (F.lit(0) if cut >> 64 else (F.col("h") >= F.lit(cut - (1 << 63))).cast("int"))

    # Slots: rows are numbered in blocks of bounded size, and each block begins where the one before ends.
    blocks = max(4, -(-n_rows // (shards * rows_per_block)))
    placed = rows.withColumn("shard", number).withColumn("block", F.pmod(F.xxhash64("doc_id", "h"), F.lit(blocks)))
    starts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    starts = starts.select(F.col("shard").alias("s"), F.col("block").alias("b"), (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "h", "size"))
    numbered = placed.withColumn("slot", (within - 1).cast("long"))
    joined = numbered.join(starts, (F.col("shard") == F.col("s")) & (F.col("block") == F.col("b")))
    return joined.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("slot") + F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
