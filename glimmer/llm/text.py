"""Words, shingles and hashes of text batches, computed column-wise with numpy.

A word is a run of bytes other than space and the bytes 9 to 13, the pattern
``[^\\x20\\x09-\\x0D]+`` (all of those are ASCII, so splitting the UTF-8 bytes is
the same as splitting the characters).  ``bytes.split()`` splits on exactly
these six bytes.

All hashes are 64 bits wide, fixed by the constants below, and the same on
every machine: two runs, two executors or two parts of a corpus can compare
and merge what they produce.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of text that are hashed at once; a longer text is hashed in pieces that end between words.
PIECE = 1 << 19
U64 = np.uint64
_SEED = 0x5EED_2024
_BASE = 0x9E37_79B9_7F4A_7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Hasher:
    """Hashes words with a polynomial over random byte codes; holds its power tables, a few MB.

    Make one per task: it is cheap, and nothing needs to be shipped to the executors.
    """

    def __init__(self) -> None:
        raw = np.random.PCG64(_SEED).random_raw
        self.codes = raw(256).astype(U64)
        self.factors = raw(64).astype(U64) | U64(1)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.powers = self.inverse = np.ones(1, U64)

    def _tables(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, PIECE + 4096)
            for name, base in (("powers", _BASE), ("inverse", _INVERSE)):
                steps = np.full(n, base, U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        """Prefix sums from which span() takes the hash of any byte range of buf."""
        self._tables(len(buf) + 1)
        out = np.zeros(len(buf) + 1, U64)
        np.cumsum(self.codes[buf] * self.powers[: len(buf)], out=out[1:])
        return out

    def span(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((prefix[ends] - prefix[starts]) * self.inverse[starts])

    def bounds(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words of buf."""
        edge = np.ones(len(buf) + 2, bool)
        edge[1:-1] = self.space[buf]
        change = np.flatnonzero(edge[1:] != edge[:-1])
        return change[::2], change[1::2]

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of all texts, in order, and the number of words of each text."""
        hashes, counts = [], np.zeros(len(texts), np.int64)
        for first, buf, edges in pieces(texts):
            starts, ends = self.bounds(buf)
            hashes.append(self.span(self.prefix(buf), starts, ends))
            at = np.searchsorted(starts, edges)
            counts[first : first + len(edges) - 1] += np.diff(at)
        return (np.concatenate(hashes) if hashes else np.zeros(0, U64)), counts

    def runs(self, words: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all runs of k words, over document borders too: cut those off with run_mask()."""
        n = max(len(words) - k + 1, 0)
        out = np.zeros(n, U64)
        for j in range(k):
            out += words[j : j + n] * self.factors[j]
        return mix(out)

    def whole(self, words: np.ndarray) -> int:
        """Hash of a whole sequence shorter than a shingle; its length enters."""
        return int(mix((words * self.factors[: len(words)]).sum(dtype=U64, keepdims=True) + U64(len(words)))[0])

    def shingles(self, words: np.ndarray, counts: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
        """The sorted distinct shingles of each text.

        A text of 1 to k-1 words has its whole sequence as its one shingle; a text without words has none.
        """
        runs = self.runs(words, k)
        ends = np.cumsum(counts)
        for start, n in zip((ends - counts).tolist(), counts.tolist(), strict=True):
            if n >= k:
                yield np.unique(runs[start : start + n - k + 1])
            elif n:
                yield np.array([self.whole(words[start : start + n])], U64)
            else:
                yield np.zeros(0, U64)


def pieces(texts: list[bytes], most: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, byte offset of each text and of the end), about PIECE bytes each, or `most` if that is less.

    A text longer than a piece comes in several pieces, each ending between words.
    """
    piece = min(most or PIECE, PIECE)
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        if held and size + len(text) > piece:
            yield first, *_joined(held)
            first, held, size = i, [], 0
        if len(text) > piece:
            at = 0
            while at < len(text):
                end = min(at + piece, len(text))
                while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
                    end += 1
                yield i, *_joined([text[at:end]])
                at = end
            first = i + 1
        else:
            held.append(text)
            size += len(text) + 1
    if held:
        yield first, *_joined(held)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    edges = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=edges[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), edges


def encoded(column) -> list[bytes]:
    """An Arrow text column as UTF-8 bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast("binary").to_pylist()]


def batches(parts: Iterable, rows: int = 2000, size: int = 1 << 22) -> Iterator:
    """Cuts Arrow batches into slices of at most so many rows and about so many text bytes (one row at least)."""
    for batch in parts:
        at = 0
        lengths = _lengths(batch)
        while at < batch.num_rows:
            n = int(np.searchsorted(np.cumsum(lengths[at : at + rows]), size)) + 1
            n = min(n, rows, batch.num_rows - at)
            yield batch.slice(at, n)
            at += n


def _lengths(batch) -> np.ndarray:
    import pyarrow.compute as pc

    total = np.zeros(batch.num_rows, np.int64)
    for name, kind in zip(batch.schema.names, batch.schema.types, strict=True):
        if str(kind) in ("string", "large_string", "binary", "large_binary"):
            total += pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return total
