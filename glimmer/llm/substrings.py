"""Substring dedup: words under repeated windows of `length` words go, found by level-wise doubling.

Windows of a short length are counted first.  Only where a window of one length
is repeated can a window of up to twice that length be repeated, so the next
level hashes just those places at which both of its halves survived; the last
halves overlap where `length` isn't twice the length before.  The levels end
at `length`, or when no candidate survives.

The work is laid out for large inputs.  Texts are reduced to distinct ones, so
copies never meet in one group.  A part (some megabytes of texts) sends each
level's distinct hashes as one packed array for each hash range and gets one bit for
each hash back: 4 bytes out for every candidate of the lower levels, whose
false matches only make further candidates, and 12 bytes at the last, whose
hashes count as equal windows (about 100 bits with the range's).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.tables import Saved
from glimmer.llm.text import U64, Hasher, encoded, mix

BASES = (0xD6E8_FEB8_6659_FD93, 0xA076_1D64_78BD_642F)
FLAT = np.dtype([("a", "<u8"), ("b", "<u4")])


def levels(length: int, first: int) -> list[int]:
    """Lengths from `first` on, each at most twice the one before, up to `length`; those below are halves of it."""
    out = [length]
    while out[0] > max(first, 1):
        out.insert(0, -(-out[0] // 2))
    return out


class Windows:
    """Hashes of all windows of some texts."""

    def __init__(self, texts: list[bytes], hasher: Hasher, length: int) -> None:
        self.words, self.counts = hasher.words(texts)
        n = len(self.words)
        ends = np.cumsum(self.counts)
        self.ends = np.repeat(ends, self.counts)  # of the text that a word is in
        self.room = self.ends - np.arange(n)
        self.long = np.repeat(self.counts >= length, self.counts)
        self.sums = []
        for base in BASES:
            powers = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(n, U64(base))]))
            inverse = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(n, U64(pow(base, -1, 1 << 64)))]))
            sums = np.zeros(n + 1, U64)
            np.cumsum(self.words * powers[:n], out=sums[1:])
            self.sums.append((sums, inverse))

    def starts(self, length: int, before: np.ndarray | None, length_before: int) -> np.ndarray:
        """Where windows of this length can be repeated, from the survivors of the level before."""
        fits = self.long & (self.room >= length)
        if before is None:
            return np.flatnonzero(fits)
        at = np.flatnonzero(fits & before)
        return at[before[at + length - length_before]]

    def hashes(self, at: np.ndarray, length: int, which: int) -> np.ndarray:
        sums, inverse = self.sums[which]
        return mix((sums[at + length] - sums[at]) * inverse[at])


class Distinct:
    """The distinct ones of a part's hashes, sorted by hash range: of each its range, what is sent of it, and whether the part has it twice."""

    def __init__(self, hashes: np.ndarray, second: np.ndarray | None, bits: int) -> None:
        key = (hashes >> U64(64 - bits) << U64(32)) | (hashes & U64(0xFFFFFFFF))
        order = np.argsort(key, kind="stable") if second is None else np.lexsort((second, key))
        new = np.ones(len(order), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        if second is not None:
            new[1:] |= second[order[1:]] != second[order[:-1]]
        first = order[new]
        #: For each hash, which of the distinct ones it is.
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.range = (key[first] >> U64(32)).astype(np.int64)
        self.twice = np.diff(np.append(np.flatnonzero(new), len(order))) > 1
        self.packed = (key[first] & U64(0xFFFFFFFF)).astype("<u4")
        if second is not None:
            low, self.packed = self.packed, np.empty(len(first), FLAT)
            self.packed["a"], self.packed["b"] = second[first], low

    def ranges(self) -> Iterator[tuple[int, int, int]]:
        """(range, begin, end) of the distinct hashes."""
        edges = np.flatnonzero(np.concatenate([[True], self.range[1:] != self.range[:-1], [True]])) if len(self.range) else np.zeros(1, np.int64)
        return ((int(self.range[a]), a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def _level(w: Windows, lengths: list[int], k: int, alive: np.ndarray | None, bits: int) -> tuple[np.ndarray, Distinct]:
    """Where windows of level k can be repeated, and their distinct hashes."""
    at = w.starts(lengths[k], alive, lengths[k - 1] if k else 0)
    second = w.hashes(at, lengths[k], 1) if k + 1 == len(lengths) else None
    return at, Distinct(w.hashes(at, lengths[k], 0), second, bits)


def _survivors(w: Windows, lengths: list[int], answers: list[dict[int, bytes]], bits: int) -> np.ndarray | None:
    """For each word, whether a window that starts there survived the levels that have answers."""
    alive = None
    for k, answer in enumerate(answers):
        at, distinct = _level(w, lengths, k, alive, bits)
        flags = np.zeros(len(distinct.range), bool)
        for r, begin, end in distinct.ranges():
            if r in answer:
                flags[begin:end] = np.unpackbits(np.frombuffer(answer[r], np.uint8), count=end - begin).astype(bool)
        alive = np.zeros(len(w.words), bool)
        alive[at] = flags[distinct.which]
    return alive


def _sent(w: Windows, lengths: list[int], answers: list[dict[int, bytes]], bits: int) -> Iterator[tuple[int, bytes]]:
    """(range, number of hashes, whether each is there twice as bits, hashes) of the level after those that have answers: each distinct hash once."""
    _, distinct = _level(w, lengths, len(answers), _survivors(w, lengths, answers, bits), bits)
    for r, begin, end in distinct.ranges():
        yield r, (end - begin).to_bytes(4, "little") + np.packbits(distinct.twice[begin:end]).tobytes() + distinct.packed[begin:end].tobytes()


def _answers(packed: list[bytes], kind: np.dtype) -> list[np.ndarray]:
    """For each part's packed hashes of a range, which of them are repeated, in the part or elsewhere."""
    counts = [int.from_bytes(p[:4], "little") for p in packed]
    twice = [np.unpackbits(np.frombuffer(p, np.uint8, -(-n // 8), 4), count=n).astype(bool) for p, n in zip(packed, counts, strict=True)]
    hashes = [np.frombuffer(p, kind, n, 4 + -(-n // 8)) for p, n in zip(packed, counts, strict=True)]
    return np.split(_repeated(np.concatenate(hashes)) | np.concatenate(twice), np.cumsum(counts)[:-1])


def _repeated(packed: np.ndarray) -> np.ndarray:
    """Which entries are there more than once."""
    if packed.dtype == FLAT:
        order = np.lexsort((packed["b"], packed["a"]))
    else:
        order = np.argsort(packed, kind="stable")
    ordered = packed[order]
    same = np.zeros(len(packed) + 1, bool)  # as the one before
    same[1:-1] = ordered[1:] == ordered[:-1]
    out = np.zeros(len(packed), bool)
    out[order] = same[:-1] | same[1:]
    return out


def remove_repeats(docs: DataFrame, length: int = 35, first: int = 9, as_digest: bool = False, part_bytes: int = 8 << 20, range_words: int = 1 << 21) -> DataFrame:
    """What is left of each text of docs(doc_id, text, ...) without the words under windows of `length` words that also start elsewhere.

    Returns for each row doc_id, n_words, n_removed (long), spans
    (array<struct<start int, end int>>: the removed words, end excluded) and
    kept: the words left, joined by single spaces, or with as_digest
    kept_sha256, the hash of that.  All occurrences of a window go, the first
    too, and windows are judged on the input.

    A group of one hash range gets each distinct hash once from a part, however
    often the part has it, so a window that is everywhere is as many entries as
    there are parts.

    Null text has no words; an empty text, and one shorter than `length`, loses
    nothing; of equal rows each has a row; a null doc_id is kept; an empty
    table gives no rows; further columns aren't read.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    save, lengths = Saved(spark), levels(length, first)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("key"))
    distinct = save(rows.groupBy("key").agg(F.first("text").alias("text"), (F.count("*") > 1).alias("copied")))
    size = distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / part_bytes))
    bits = max(1, math.ceil(math.log2(max(2, size / 6 / range_words))))
    part = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part")
    texts = save.bucketed(distinct.select(part, "key", "text", "copied"), "part", max(1, math.ceil(parts / 3)))
    save.drop(distinct)

    def opened(table):
        table = table.sort_by("key")
        return table, Windows(encoded(table["text"]), Hasher(), length)

    def answered(table, n: int) -> list[dict[int, bytes]]:
        out: list[dict[int, bytes]] = [{} for _ in range(n)]
        for level, r, flags in zip(*(table[c].to_pylist() for c in ("level", "range", "flags")), strict=True):
            out[level][r] = flags
        return out

    answers, schema = [], pa.schema([("range", pa.int32()), ("part", pa.int32()), ("packed", pa.binary())])

    def sender(k: int):
        def send(table, flags=None):
            part = table["part"][0]
            table, w = opened(table)
            found = list(_sent(w, lengths, answered(flags, k) if k else [], bits))
            return pa.table([[r for r, _ in found], [part.as_py()] * len(found), [p for _, p in found]], schema=schema)

        return (lambda table, flags: send(table, flags) if table.num_rows else schema.empty_table()) if k else (lambda table: send(table))

    def answerer(k: int):
        kind = FLAT if k + 1 == len(lengths) else np.dtype("<u4")

        def answer(table):
            each = _answers(table["packed"].to_pylist(), kind)
            kept = np.array([i for i, f in enumerate(each) if f.any()], np.int64)
            return pa.table({"part": table["part"].take(kept), "level": pa.array([k] * len(kept), pa.int32()), "range": table["range"].take(kept), "flags": pa.array([np.packbits(each[i]).tobytes() for i in kept], pa.binary())})

        return answer

    for k in range(len(lengths)):
        by_part = texts.groupBy("part")
        if k:
            flags = answers[0]
            for more in answers[1:]:
                flags = flags.unionByName(more)
            sent = by_part.cogroup(flags.groupBy("part")).applyInArrow(sender(k), "range int, part int, packed binary")
        else:
            sent = by_part.applyInArrow(sender(k), "range int, part int, packed binary")
        answers.append(save(sent.groupBy("range").applyInArrow(answerer(k), "part int, level int, range int, flags binary")))
        if not answers[-1].take(1):
            break

    done = len(answers)
    whole = done == len(lengths)

    def finish(table, flags):
        if not table.num_rows:
            return results.empty_table()
        table, w = opened(table)
        alive = np.zeros(len(w.words), bool)
        if whole:
            alive = _survivors(w, lengths, answered(flags, done), bits)
        alive = alive | (np.repeat(np.array(table["copied"].to_pylist(), bool), w.counts) & (w.room >= length))
        steps = np.zeros(len(alive) + length + 1, np.int64)
        at = np.flatnonzero(alive)
        np.add.at(steps, at, 1)
        np.add.at(steps, at + length, -1)
        gone = np.cumsum(steps)[: len(alive)] > 0
        n_removed, spans, kept, begin = [], [], [], 0
        for raw, n in zip(encoded(table["text"]), w.counts.tolist(), strict=True):
            mine, words = gone[begin : begin + n], raw.split()
            begin += n
            n_removed.append(int(mine.sum()))
            change = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]])))
            spans.append([{"start": a, "end": b} for a, b in zip(change[::2].tolist(), change[1::2].tolist(), strict=True)])
            if n_removed[-1]:
                words = [words[i] for i in np.flatnonzero(~mine).tolist()]
            left = b" ".join(words)
            kept.append(hashlib.sha256(left).hexdigest() if as_digest else left.decode("utf-8", "replace"))
        return pa.table([table["key"].combine_chunks().cast(pa.binary()), pa.array(w.counts), pa.array(n_removed, pa.int64()), pa.array(spans, results.field("spans").type), pa.array(kept, pa.string())], schema=results)

    name = "kept_sha256" if as_digest else "kept"
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    results = pa.schema([("key", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", span), (name, pa.string())])
    flags = answers[0]
    for more in answers[1:]:
        flags = flags.unionByName(more)
    found = save(texts.groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(finish, f"key binary, n_words long, n_removed long, spans array<struct<start: int, end: int>>, {name} string"))
    save.drop(texts)
    return rows.select("doc_id", "key").join(found, "key").select("doc_id", "n_words", "n_removed", "spans", name)
