"""Packing: token sequences of at most `length`, cut where dynamic programming finds it cheapest.

Documents keep their order.  A sequence may end at the end of a document (no
penalty), at the end of a sentence (a small one) or, where neither comes soon
enough, inside a sentence (a large one).  Padding counts a token each; a
sequence whose length is a power of two isn't padded.  The cheapest cuts up to
a position follow from the cheapest up to earlier ones; as the padding is
linear in the start, the best start in the window of `length` tokens is kept
by a monotone queue.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from glimmer.llm.text import batches

#: Penalties in tokens of padding, for cutting a document between two sentences and inside one.
BETWEEN, INSIDE = 8, 64
#: Tokens for which cuts are chosen at once; what follows the last full sequence goes on to the next such run.
RUN = 1 << 18
END_ID = 1
#: How a byte-level tokenizers file splits a text before merging: a fixed value of that format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SENTENCE = re.compile(rb"[.!?][\"')\]]*$|\n")
#: Bytes of text that are encoded at once; a longer text is encoded in parts, cut before a space between words.
PART = 1 << 20
_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Ids of whole texts by a tokenizers file.

    The ids are those of the tokenizers library by its defaults, without special
    tokens added: the string of one that a text holds is its id.  A byte-level
    BPE whose merges are numbered in their order is the same as its vocabulary
    as ranks, which tiktoken encodes several times faster, between the added
    tokens; other files are encoded by the tokenizers library itself.
    """

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        raw = json.loads(vocabulary)
        model, split = raw["model"], raw["pre_tokenizer"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.bytes = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t["content"]: t["id"] for t in raw["added_tokens"]}
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in raw["added_tokens"])
        tokens = {t: self._raw(t) for t in model["vocab"] if t not in special}
        merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
        in_order = all(a < b for a, b in zip(merged, merged[1:], strict=False))
        if split == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and in_order and None not in tokens.values() and not raw["normalizer"] and plain:
            import tiktoken

            ranks = {b: model["vocab"][t] for t, b in tokens.items()}
            ordinary = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            added = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

            def encode(text: str) -> list[int]:
                if added is None or not added.search(text):
                    return ordinary(text)
                return [i for k, piece in enumerate(added.split(text)) for i in ([special[piece]] if k % 2 else ordinary(piece))]

            self.encode = encode
        else:
            tokenizer = Tokenizer.from_str(vocabulary)
            self.encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        size = 1 + max([*model["vocab"].values(), *(t["id"] for t in raw["added_tokens"])])
        self.ends, self.spaced = np.zeros(size, bool), np.zeros(size, bool)
        for token, i in model["vocab"].items():
            plain = tokens.get(token) or b""
            self.ends[i] = bool(_SENTENCE.search(plain))
            self.spaced[i] = plain[:1].isspace() or b"\n" in plain

    def _raw(self, token: str) -> bytes | None:
        try:
            return bytes(self.bytes[c] for c in token)
        except KeyError:
            return None

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts with END_ID after each, the number of ids of each, and whether a sentence ends after each id."""
        out, counts = [], np.zeros(len(texts), np.int64)
        end = np.full(1, END_ID, np.uint32)
        for i, text in enumerate(texts):
            for part in _parts(text) if len(text) > PART else (text,):
                out.append(np.array(self.encode(part), np.uint32))
                counts[i] += len(out[-1])
            out.append(end)
        ids = np.concatenate(out) if out else np.zeros(0, np.uint32)
        last = np.zeros(len(ids), bool)
        last[np.cumsum(counts + 1) - 1] = True
        follows = np.append(self.spaced[ids[1:]] | last[1:], True) if len(ids) else last
        return ids, counts + 1, self.ends[ids] & follows & ~last


def _parts(text: str) -> Iterator[str]:
    """A very long text in parts, cut where no token reaches across: before a space between two words."""
    at = 0
    while len(text) - at > PART:
        found = _BETWEEN_WORDS.search(text, at + PART)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def best_cuts(places: np.ndarray, penalties: np.ndarray, length: int, final: bool) -> tuple[list[int], float]:
    """Cuts (of places, ascending, the last being the end) and their cost: padding and penalties.

    Gaps between places are at most `length`.  Unless final, the last sequence
    is left open: the cuts end where a further sequence would begin that
    reaches the end, and its padding doesn't count.
    """
    n = len(places)
    position = np.concatenate([[0], places])
    at = np.full(int(position[-1]) + 1, -1, np.int64)
    at[position] = np.arange(n + 1)
    exact: dict[int, list[int]] = {}
    for power in (1 << k for k in range(length.bit_length()) if 1 << k <= length):
        j = np.searchsorted(position, power)
        i = at[position[j:] - power]
        for end, start in zip((np.flatnonzero(i >= 0) + j).tolist(), i[i >= 0].tolist(), strict=True):
            exact.setdefault(end, []).append(start)
    position, cost = position.tolist(), [0.0] * (n + 1)
    penalties = penalties.tolist()
    came, queue = [0] * (n + 1), deque([0])
    reduced = [0.0] * (n + 1)  # cost[i] + position[i]
    for j in range(1, n + 1):
        here = position[j]
        while position[queue[0]] < here - length:
            queue.popleft()
        best = queue[0]
        least = reduced[best] + length - here
        for i in exact.get(j, ()):
            if cost[i] < least:
                best, least = i, cost[i]
        came[j] = best
        cost[j] = least = least + penalties[j - 1]
        reduced[j] = least = least + here
        while queue and reduced[queue[-1]] >= least:
            queue.pop()
        queue.append(j)
    end = n
    if not final:
        open_from = [j for j in range(n + 1) if position[j] >= position[n] - length]
        end = min(open_from, key=lambda j: cost[j])
    total, cuts = cost[end], []
    while end:
        cuts.append(end - 1)
        end = came[end]
    return cuts[::-1], total


class Packer:
    """Packs one stream of documents; holds about RUN tokens and the documents they are of."""

    def __init__(self, length: int, first_id: int) -> None:
        self.length, self.next_id = length, first_id
        self.ids, self.stops = np.zeros(0, np.uint32), np.zeros(0, bool)
        self.docs: list[list] = []  # doc_id, tokens, start of what is held, tokens held

    def add(self, doc_ids: list, ids: np.ndarray, counts: np.ndarray, stops: np.ndarray) -> Iterator[dict]:
        self.docs += [[d, n, 0, n] for d, n in zip(doc_ids, counts.tolist(), strict=True)]
        self.ids, self.stops = np.concatenate([self.ids, ids]), np.concatenate([self.stops, stops])
        while len(self.ids) >= RUN:
            yield self._pack(RUN, False)

    def finish(self) -> Iterator[dict]:
        if len(self.ids):
            yield self._pack(len(self.ids), True)

    def _pack(self, n: int, final: bool) -> dict:
        ends = np.cumsum([d[3] for d in self.docs])
        ends = ends[: np.searchsorted(ends, n, side="right")]
        penalty = np.full(n + 1, np.inf)
        penalty[np.flatnonzero(self.stops[:n]) + 1] = BETWEEN
        penalty[ends] = 0
        forced = []
        marks = np.concatenate([[0], np.flatnonzero(np.isfinite(penalty)), [n]])
        for gap in np.flatnonzero(np.diff(marks) > self.length):
            forced += range(int(marks[gap]) + self.length, int(marks[gap + 1]), self.length)
        if final:
            forced += [n - (1 << k) for k in range(self.length.bit_length()) if 1 << k < n]
        for place in forced:
            penalty[place] = min(penalty[place], INSIDE)
        if not np.isfinite(penalty[n]):
            penalty[n] = INSIDE
        penalty[0] = np.inf
        places = np.flatnonzero(np.isfinite(penalty))
        cuts, _ = best_cuts(places, penalty[places], self.length, final)
        cuts = places[cuts]
        used = int(cuts[-1])
        # Pieces lie between cuts and document ends.
        borders = np.union1d(np.concatenate([[0], cuts]), ends[ends < used])
        first, last = borders[:-1], borders[1:]
        held = np.cumsum([d[3] for d in self.docs])
        doc = np.searchsorted(held, first, side="right")
        sequence = np.searchsorted(cuts, first, side="right")
        starts = np.concatenate([[0], cuts[:-1]])[sequence]
        raw = self.ids[:used].astype("<u4")
        begin = held - [d[3] for d in self.docs] - [d[2] for d in self.docs]
        out = {
            "doc_id": [self.docs[i][0] for i in doc.tolist()],
            "start": (first - begin[doc]).tolist(),
            "length": (last - first).tolist(),
            "ids_crc32": [zlib.crc32(raw[a:b].data) for a, b in zip(first.tolist(), last.tolist(), strict=True)],
            "doc_tokens": [self.docs[i][1] for i in doc.tolist()],
            "sequence_id": (sequence + self.next_id).tolist(),
            "offset": (first - starts).tolist(),
        }
        self.next_id += len(cuts)
        self.ids, self.stops = self.ids[used:], self.stops[used:]
        done = int(np.searchsorted(held, used, side="right"))
        if done < len(self.docs):
            part = used - int(held[done] - self.docs[done][3])
            self.docs[done][2] += part
            self.docs[done][3] -= part
        del self.docs[:done]
        return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary_path: str, length: int = 2048) -> DataFrame:
    """Pieces of the tokenized docs(doc_id, text, ...) in sequences of at most `length` tokens.

    A document is its ids by the tokenizers file and then id 1.  Every id lies
    in exactly one piece; the pieces of a sequence follow each other from
    offset 0 without a gap.  Documents are packed in their stored order, one
    stream for each input partition (no shuffle): a stream ends with one
    sequence or a few that aren't full, and sequence_id is unique over all.

    A null text is empty: its document is the single id 1.  A null doc_id stays
    null, repeated rows are packed each, an empty table gives no pieces,
    further columns aren't read; a text is encoded in parts of 1 MB and packed
    in runs of 2**18 tokens, so its length is bounded by one row's memory only.
    """
    import pyarrow as pa

    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = pa.schema([("doc_id", pa.int64()), *((c.split()[0], pa.int64()) for c in PIECES.split(", ")[1:])])

    def run(parts):
        from pyspark import TaskContext

        encoder = packer = None
        for batch in batches(parts, 512, 1 << 21):
            if packer is None:
                encoder, packer = Encoder(vocabulary.value), Packer(length, TaskContext.get().partitionId() << 40)
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for found in packer.add(batch.column("doc_id").to_pylist(), *encoder(texts)):
                yield pa.RecordBatch.from_pydict(found, schema)
        if packer is not None:
            for found in packer.finish():
                yield pa.RecordBatch.from_pydict(found, schema)

    rows = docs.selectExpr("cast(doc_id as bigint) AS doc_id", "cast(text as string) AS text")
    return rows.mapInArrow(run, PIECES)
