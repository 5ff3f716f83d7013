"""Line dedup by an exact set-similarity join of lines.

A line is the set of its words.  A line goes if an earlier line (by doc_id and
line number) has the same words or has a Jaccard similarity of the threshold or
more with it.  Equal lines are found first: one of them stands for all.

The join of different lines orders each one's words by rarity, rarest first, and
indexes the first few: two sets that are similar enough share one of those
(prefix filter).  Candidates under one word pass if their sizes are near enough
(length filter), if what follows the shared word's places can still make up
the overlap (positional filter), and if their parity sketches, whose width
follows the size of the set, differ in no more bits than the allowed words.
Words are ranked by document frequencies counted in a hash table of fixed size
over all lines; any order of words makes the filters exact, the rare-first one
makes them cheap.  A word that the table shows to be in one line only isn't
indexed.

Each set needs one earlier similar set, no matter which.  Of a set's
candidates a cell of the index keeps the closest two if those are surely near,
else many; all cells' closest one is verified on full sets first, and only of sets for which
that fails the other candidates are.  Sets that still have none but more
candidates than were kept go to the index again for those that come next.

The work is laid out as packed arrays: a part (some megabytes of texts) sends
one array for each cell, and rows are made of what is found only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.tables import Saved
from glimmer.llm.text import U64, Hasher, batches, encoded, mix, pieces

#: Bits of the table of word frequencies (a byte for each entry), and slices in which it is added up.
TABLE_BITS, SLICES = 22, 64
#: First bits of a word's hash that its index entries are made from, and lines whose words are sorted at once: in 64 bits, with 8 of the frequency code.
WORD_BITS, AT_ONCE = 44, 1 << 12
#: Bytes of text that are hashed at once, so few that the arrays of 8 bytes for each stay in a CPU's cache.
CACHED = 1 << 17
#: Index entries in a range of words, those of one word beyond which it is compared in blocks, and pairs that are tested at once.
RANGE, HOT, WIDE = 1 << 18, 1 << 19, 1 << 19
#: Sets of up to so many words have sketches of 1, 2 and 4 times 64 bits, larger ones of 16 times.
SIZES, WIDTHS = (40, 88, 400), (1, 2, 4, 16)
#: Thousandths of the allowed different words, as the closest candidate's sketch lets expect them, up to which a set is surely near, and probably.
SURE = (300, 750)
#: Candidates that a set keeps of a cell at first: surely near, probably, or neither.
FIRST = (2, 16, 256)
#: Candidates of a later round that are all verified at once.
FEW = 1 << 18
_ID = [("doc", "<i8"), ("row", "<i8"), ("line", "<i4")]
ENTRY = np.dtype([("word", "<u4"), *_ID, ("size", "<u4"), ("place", "<u4"), ("code", "u1"), ("side", "u1"), ("open", "u1")])
KEY = np.dtype([("a", "<u8"), ("b", "<u8"), *_ID])
PAIR = np.dtype([("row", "<i8"), ("line", "<i4"), ("row2", "<i8"), ("line2", "<i4"), ("far", "<i4"), ("more", "?")])
#: The place in the order of a document without doc_id: after all others.
LAST = (1 << 63) - 1


class Lines:
    """Lines of some texts: `doc` and `number` tell each line's text and place in it; `words` are the hashes of all words, `line` the lines they are in."""

    def __init__(self, doc: np.ndarray, number: np.ndarray, words: np.ndarray, line: np.ndarray) -> None:
        self.doc, self.number, self.words, self.line = doc, number, words, line

    @classmethod
    def whole(cls, texts: list[bytes], hasher: Hasher, rows: np.ndarray | None = None, numbers: np.ndarray | None = None) -> Lines:
        """All lines of the texts; those at (rows, numbers) count as empty."""
        counts = np.fromiter((t.count(b"\n") + 1 for t in texts), np.int64, len(texts))
        starts = np.cumsum(counts) - counts
        doc = np.repeat(np.arange(len(texts)), counts)
        hashes, at, before, known = [np.zeros(0, U64)], [np.zeros(0, np.int64)], -1, 0
        for first, buf, edges in pieces(texts, CACHED):
            # A piece of a long text goes on where the one before it ended; what joins texts is a line's end.
            base = known if first == before else int(starts[first])
            begin, end = hasher.bounds(buf)
            breaks = np.flatnonzero(buf == 10)
            hashes.append(hasher.span(hasher.prefix(buf), begin, end))
            at.append(base + np.searchsorted(breaks, begin))
            before, known = first, base + len(breaks) - 1
        words, line = np.concatenate(hashes), np.concatenate(at)
        if rows is not None and len(rows):
            stay = np.ones(len(doc), bool)
            stay[starts[rows] + numbers] = False
            words, line = words[stay[line]], line[stay[line]]
        return cls(doc, np.arange(len(doc)) - np.repeat(starts, counts), words, line)

    @classmethod
    def some(cls, texts: list[bytes], hasher: Hasher, rows: np.ndarray, numbers: np.ndarray) -> Lines:
        """The lines at (rows, numbers), which come in order."""
        found, split, last = [], [], -1
        for i, n in zip(rows.tolist(), numbers.tolist(), strict=True):
            if i != last:
                split, last = texts[i].split(b"\n"), i
            found.append(split[n])
        words, counts = hasher.words(found)
        return cls(rows, numbers, words, np.repeat(np.arange(len(found)), counts))

    def with_any(self, asked: np.ndarray) -> Lines:
        """Only the words of lines that have a word whose slot is asked for."""
        stay = np.zeros(len(self.doc), bool)
        stay[self.line[asked[slot(self.words)]]] = True
        at = stay[self.line]
        return Lines(self.doc, self.number, self.words[at], self.line[at])

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The lines that have words, and 128 bits of each: the same for lines of the same words, each as often."""
        lengths = np.bincount(self.line, minlength=len(self.doc))
        at, starts = np.flatnonzero(lengths), np.cumsum(lengths) - lengths
        if not len(at):
            return at, np.zeros((0, 2), U64)
        return at, np.stack([np.add.reduceat(w, starts[at]) for w in (self.words, mix(self.words ^ U64(0x5851F42D4C957F2D)))], axis=1)

    def sets(self) -> Iterator[bytes]:
        """The sorted distinct words of each line."""
        order = np.lexsort((self.words, self.line))
        words, line = self.words[order], self.line[order]
        new = np.ones(len(words), bool)
        new[1:] = (words[1:] != words[:-1]) | (line[1:] != line[:-1])
        raw, ends = words[new].tobytes(), np.cumsum(np.bincount(line[new], minlength=len(self.doc))) * 8
        return (raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False))


def slot(words: np.ndarray) -> np.ndarray:
    return (words >> U64(64 - TABLE_BITS)).astype(np.int64)


def code(counts: np.ndarray) -> np.ndarray:
    """Frequencies as bytes: 0 for none or one, else eighths of the logarithm to base 2."""
    return np.minimum(255, np.ceil(8 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def pack(columns: dict[str, np.ndarray], sketch: np.ndarray | None = None) -> bytes:
    """Columns one after the other, each in the smallest width that holds its differences from its smallest value; then the sketches."""
    out = [len(next(iter(columns.values()))).to_bytes(4, "little"), bytes([0 if sketch is None else sketch.shape[1]])]
    for column in columns.values():
        base, most = int(column.min()), int(column.max())
        width = next(w for w in (0, 1, 2, 4, 8) if most - base < 1 << (8 * w))
        out += [b"%d" % width, base.to_bytes(9, "little", signed=True)]
        if width:
            out.append((column - column.dtype.type(base)).astype(f"<u{width}").tobytes())
    return b"".join([*out, b"" if sketch is None else sketch.tobytes()])


def unpack(raw: bytes, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    n, wide = int.from_bytes(raw[:4], "little"), raw[4]
    out, at = np.empty(n, kind), 5
    for name in kind.names:
        width, base = int(raw[at : at + 1]), int.from_bytes(raw[at + 1 : at + 10], "little", signed=True)
        rest = np.frombuffer(raw, f"<u{width}", n, at + 10) if width else np.zeros(n, np.uint8)
        out[name] = rest.astype(kind[name]) + kind[name].type(base)
        at += 10 + n * width
    return out, np.frombuffer(raw, "<u8", n * wide, at).reshape(n, wide)


def index_entries(lines: Lines, docs: np.ndarray, rows: np.ndarray, table: np.ndarray, percent: int, asked: np.ndarray | None = None, opened: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(entries, sketches) of the lines' prefixes for each width of sketch; docs and rows tell the texts' places.

    asked limits them to words whose slots it marks; opened marks lines that
    look for candidates.  A line's entries depend on its own words only, not on
    the lines that are read with it.
    """
    ends = [*range(AT_ONCE, len(lines.doc), AT_ONCE), len(lines.doc)]
    cuts = np.searchsorted(lines.line, [0, *ends]).tolist()
    some = [_some_entries(lines, begin, end, docs, rows, table, percent, asked, opened) for begin, end in zip(cuts, cuts[1:], strict=False)]
    return [(np.concatenate([s[i][0] for s in some]), np.concatenate([s[i][1] for s in some])) for i in range(len(WIDTHS))]


def _some_entries(lines, begin, end, docs, rows, table, percent, asked, opened) -> list[tuple[np.ndarray, np.ndarray]]:
    """The entries of the words begin to end-1, which are those of at most AT_ONCE lines.

    Words are sorted as numbers of line, frequency code and the first WORD_BITS of the hash.
    """
    bits, words = WORD_BITS, lines.words[begin:end]
    base = int(lines.line[begin]) if end > begin else 0
    key = (lines.line[begin:end] - base).astype(U64) << U64(bits + 8)
    key |= table[slot(words)].astype(U64) << U64(bits)
    key |= words >> U64(64 - bits)
    key.sort()
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    line = (key >> U64(bits + 8)).astype(np.int64) + base
    codes, words = (key >> U64(bits)).astype(np.uint8), key & U64((1 << bits) - 1)
    first = np.ones(len(line), bool)
    first[1:] = line[1:] != line[:-1]
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(line)))
    sizes = np.repeat(lengths, lengths)
    place = np.arange(len(line)) - np.repeat(starts, lengths)
    kind = np.searchsorted(SIZES, lengths)
    owner = np.repeat(np.arange(len(starts)), lengths)
    take = (place < prefix_length(sizes, percent)) & (codes > 0)
    if asked is not None:
        take &= asked[(words >> U64(bits - TABLE_BITS)).astype(np.int64)]
    ones = U64(1) << (words & U64(63))
    out = []
    for k, width in enumerate(WIDTHS):
        mine = np.flatnonzero(kind == k)
        sketch = np.zeros((len(mine), width), U64)
        if len(mine):
            of = np.flatnonzero(kind[owner] == k)
            lane, at = (words[of] >> U64(6)) & U64(width - 1), np.cumsum(lengths[mine]) - lengths[mine]
            for i in range(width):
                sketch[:, i] = np.bitwise_xor.reduceat(np.where(lane == U64(i), ones[of], U64(0)) if width > 1 else ones[of], at)
            at = of[take[of]]
        else:
            at = mine
        entries, number = np.zeros(len(at), ENTRY), line[at]
        doc = lines.doc[number]
        values = {"word": (words[at] >> U64(bits - 32)).astype(np.uint32), "doc": docs[doc], "row": rows[doc], "line": lines.number[number], "size": sizes[at], "place": place[at], "code": codes[at]}
        for name, value in values.items():
            entries[name] = value
        entries["open"] = 1 if opened is None else opened[number]
        out.append((entries, sketch[np.searchsorted(mine, owner[at])]))
    return out


def cells(entries: np.ndarray, sketch: np.ndarray, ranges: int) -> Iterator[tuple[int, bool, bytes]]:
    """(cell, whether only pairs of different sides count, packed entries) for the cells that entries go to.

    A word in more than HOT lines, as far as the code tells, is compared in
    blocks: its sets are dealt to blocks, each pair of blocks is a cell.
    """
    blocks = np.ceil(np.exp2(entries["code"] / 8) / HOT).astype(np.int64)
    plain = np.flatnonzero(blocks <= 1)
    where = mix(entries["word"][plain].astype(U64)) % U64(ranges)
    yield from _dealt(entries, sketch, plain, where.astype(np.uint16 if ranges < 1 << 16 else np.int64), np.zeros(len(plain), bool), np.zeros(len(plain), np.uint8))
    hot = np.flatnonzero(blocks > 1)
    if len(hot):
        n = blocks[hot]
        own = (mix(entries["row"][hot].astype(U64) * U64(31) + entries["line"][hot].astype(U64)) % n.astype(U64)).astype(np.int64)
        at, own, other = np.repeat(hot, n), np.repeat(own, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j = np.minimum(own, other), np.maximum(own, other)
        cell = (1 << 62) + (mix((entries["word"][at].astype(U64) << U64(32)) ^ (i << 16 ^ j).astype(U64)) >> U64(2)).astype(np.int64)
        yield from _dealt(entries, sketch, at, cell, i != j, (own == j).astype(np.uint8))


def _dealt(entries, sketch, at, cell, crossing, side) -> Iterator[tuple[int, bool, bytes]]:
    order = np.argsort(cell, kind="stable")
    at, cell, crossing = at[order], cell[order], crossing[order]
    columns = {name: entries[name][at] for name in ENTRY.names if name not in ("side", "code")}
    columns |= {"side": side[order], "code": np.zeros(len(at), np.uint8)}
    columns, sketch = {name: columns[name] for name in ENTRY.names}, sketch[at]
    edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]])) if len(at) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(cell[a]), bool(crossing[a]), pack({name: c[a:b] for name, c in columns.items()}, sketch[a:b])


def prefix_length(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Words to index: all but what an overlap of the smallest similar set needs, and one more."""
    return sizes - -(-sizes * percent // 100) + 1


def needed(x, y, percent: int):
    """The least overlap at which sets of these sizes are similar: o / (x + y - o) >= percent / 100."""
    return -(-percent * (x + y) // (100 + percent))


def _chunks(counts: np.ndarray):
    """Cuts of consecutive counts into runs of about WIDE."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        begin = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, begin + WIDE, side="right")))
        yield at, end
        at = end


def _largest_partner(size: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """The size of the largest set that can still be similar to a set whose first shared word is at this place."""
    return (size - place) * (100 + percent) // percent - size


def _pairs(left, left_sketch, right, right_sketch, percent: int, cross: bool):
    """(left, right, expected different words in thousandths of the allowed) of entries under equal words that pass all filters.

    The right set has the larger size.  Of two equal ones each can be either,
    unless both are in the part of the prefix that left sets are looked for in.
    """
    width = min(left_sketch.shape[1], right_sketch.shape[1])
    while right_sketch.shape[1] > width:  # a sketch of half the width is the sum of both halves
        half = right_sketch.shape[1] // 2
        right_sketch = right_sketch[:, :half] ^ right_sketch[:, half:]
    size, place = left["size"].astype(np.int64), left["place"].astype(np.int64)
    indexed = np.flatnonzero(_largest_partner(size, place, percent) >= size)
    indexed = indexed[np.lexsort((size[indexed], left["word"][indexed]))]
    key = (left["word"][indexed].astype(U64) << U64(32)) | size[indexed].astype(U64)
    y, y_place, word = right["size"].astype(np.int64), right["place"].astype(np.int64), right["word"].astype(U64) << U64(32)
    y_most = _largest_partner(y, y_place, percent)
    first = np.searchsorted(key, word | (-(-y * percent // 100)).astype(U64), side="left")
    last = np.searchsorted(key, word | np.clip(y_most, 0, y).astype(U64), side="right")
    counts = np.maximum(last - first, 0)
    lanes = [np.ascontiguousarray(left_sketch[indexed, i]) for i in range(width)], [np.ascontiguousarray(right_sketch[:, i]) for i in range(width)]
    x, x_most = size[indexed].astype(np.int32), _largest_partner(size, place, percent)[indexed].astype(np.int32)
    y, twice = y.astype(np.int32), y_most >= y
    for begin, end in _chunks(counts):
        k = counts[begin:end]
        if not k.any():
            continue
        b = np.repeat(np.arange(begin, end), k)
        a = np.arange(len(b)) + np.repeat(first[begin:end] - (np.cumsum(k) - k), k)
        ok = np.flatnonzero(x_most[a] >= y[b])
        a, b = a[ok], b[ok]
        allowed = x[a] + y[b]
        allowed -= 2 * needed(x[a], y[b], percent)
        differ = np.zeros(len(a), np.int32)
        for one, other in zip(*lanes, strict=True):
            differ += np.bitwise_count(one[a] ^ other[b])
            ok = np.flatnonzero(differ <= allowed)
            a, b, differ, allowed = a[ok], b[ok], differ[ok], allowed[ok]
        ok = (x[a] < y[b]) | ~twice[b] | (indexed[a] < b)
        a, b, differ, allowed = indexed[a[ok]], b[ok], differ[ok], allowed[ok]
        if cross:
            ok = left["side"][a] != right["side"][b]
            a, b, differ, allowed = a[ok], b[ok], differ[ok], allowed[ok]
        free = np.maximum(1 - 2 * differ / (64 * width), 1e-9)
        yield a, b, np.minimum(-32 * width * np.log(free) * 1000 / np.maximum(allowed, 1), 1 << 20).astype(np.int64)


def candidates(packed: list[bytes], percent: int, low: int, high: int, cross: bool = False) -> np.ndarray:
    """PAIR rows (set, earlier set, distance, more) of a cell's packed entries, for sets that are open.

    Of each set come the candidates number low to high-1 (closest sketches
    first), with `more` where others follow; both count in FIRST, by how near
    the closest is.
    """
    kinds: dict[int, list] = {}
    for raw in packed:
        entries, sketch = unpack(raw, ENTRY)
        kinds.setdefault(sketch.shape[1], []).append((entries, sketch))
    kinds = {w: [np.concatenate([x[i] for x in some]) for i in (0, 1)] for w, some in kinds.items()}
    # The sets of the cell are numbered in their order.
    doc, row, line, opened = (np.concatenate([e[c] for e, _ in kinds.values()]) for c in ("doc", "row", "line", "open"))
    order = np.lexsort((line, row, doc))
    doc, row, line, opened = doc[order], row[order], line[order], opened[order]
    new = np.ones(len(order), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (line[1:] != line[:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    row, line, opened = row[new], line[new], opened[new] > 0
    numbers = dict(zip(kinds, np.split(number, np.cumsum([len(e) for e, _ in kinds.values()])[:-1]), strict=True))
    # A pair is one number: the later set, how far, the earlier set.
    bits = max(1, int(len(row)).bit_length())
    coarse = max(0, 2 * bits + 21 - 63)
    found = []
    for width, right in kinds.items():
        for other, left in kinds.items():
            if other > width or 100 * left[0]["size"].max() < percent * right[0]["size"].min():
                continue
            for a, b, far in _pairs(*left, *right, percent, cross):
                x, y = numbers[other][a], numbers[width][b]
                earlier, later = np.minimum(x, y), np.maximum(x, y)
                ok = (earlier < later) & opened[later]
                found.append((later[ok] << (63 - bits)) | (far[ok] >> coarse << bits) | earlier[ok])
    if not found:
        return np.zeros(0, PAIR)
    found = np.sort(np.concatenate(found))
    found = found[np.append(True, found[1:] != found[:-1])] if len(found) else found
    later, earlier = found >> (63 - bits), found & ((1 << bits) - 1)
    far = (found >> bits & ((1 << (63 - 2 * bits)) - 1)) << coarse
    head = np.ones(len(found), bool)
    head[1:] = later[1:] != later[:-1]
    starts = np.flatnonzero(head)
    lengths = np.diff(np.append(starts, len(head)))
    rank = np.arange(len(head)) - np.repeat(starts, lengths)
    times = np.repeat(np.array(FIRST)[np.searchsorted(SURE, far[starts])], lengths)
    take = (rank >= low * times) & (rank < high * times)
    out = np.zeros(int(take.sum()), PAIR)
    more = np.repeat(lengths, lengths) > high * times
    for name, v in {"row": row[later[take]], "line": line[later[take]], "row2": row[earlier[take]], "line2": line[earlier[take]], "far": far[take], "more": more[take]}.items():
        out[name] = v
    return out


def near_enough(x: list[bytes], y: list[bytes], percent: int) -> np.ndarray:
    """Which pairs of word sets are similar enough; words are told apart by hashes with the pair's number mixed in."""
    n, m = (np.array([len(s) // 8 for s in z], np.int64) for z in (x, y))
    salt = mix(np.arange(len(x), dtype=U64) + U64(1))
    one = np.sort(mix(np.frombuffer(b"".join(x), U64) ^ np.repeat(salt, n)))
    other, owner = mix(np.frombuffer(b"".join(y), U64) ^ np.repeat(salt, m)), np.repeat(np.arange(len(x)), m)
    if not len(one):
        return np.zeros(len(x), bool)
    both = np.bincount(owner[one[np.minimum(np.searchsorted(one, other), len(one) - 1)] == other], minlength=len(x))
    return 100 * both >= percent * (n + m - both)


def _word_slices(words: np.ndarray) -> list[tuple[int, bytes]]:
    """The non-zero counts of the words' slots in each slice of the table: numbers within it (2 bytes), then counts (4)."""
    slots = np.sort((words >> U64(64 - TABLE_BITS)).astype(np.uint32))
    starts = np.flatnonzero(np.append(True, slots[1:] != slots[:-1])) if len(slots) else np.zeros(0, np.int64)
    slots, counts, wide = slots[starts], np.diff(np.append(starts, len(slots))), (1 << TABLE_BITS) // SLICES
    edges = np.searchsorted(slots, np.arange(SLICES + 1) * wide).tolist()
    return [(i, (slots[a:b] - np.uint32(i * wide)).astype("<u2").tobytes() + counts[a:b].astype("<u4").tobytes()) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]


def _packed_counts(counts: np.ndarray) -> bytes:
    at = np.flatnonzero(counts)
    return at.astype("<u2").tobytes() + np.minimum(counts[at], 0xFFFFFFFF).astype("<u4").tobytes()


def _summed(packed: list[bytes]) -> np.ndarray:
    """The sums of a slice's packed counts."""
    n = [len(p) // 6 for p in packed]
    number = np.concatenate([np.frombuffer(p, "<u2", k) for p, k in zip(packed, n, strict=True)])
    count = np.concatenate([np.frombuffer(p, "<u4", k, 2 * k) for p, k in zip(packed, n, strict=True)])
    return np.bincount(number, count, minlength=(1 << TABLE_BITS) // SLICES).astype(np.int64)


def _by_part(rows: np.ndarray, lines: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, rows within it, lines) of the lines of one part after the other."""
    order = np.argsort(rows, kind="stable")
    rows, lines = rows[order], lines[order]
    part = rows >> 32
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(rows) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(part[a]), rows[a:b] & 0xFFFFFFFF, lines[a:b]


def dedup_lines(docs: DataFrame, percent: int = 75, as_digest: bool = False, carry: tuple[str, ...] = (), part_bytes: int = 8 << 20, range_entries: int = RANGE) -> DataFrame:
    """docs(doc_id, text, ...) without the lines that repeat an earlier one, nearly or exactly.

    Returns for each row doc_id, n_lines, n_removed (long), removed (array<int>,
    the numbers of the lines that go, from 0) and kept: the lines left, joined by newlines, or with
    as_digest kept_sha256, the hash of that; and the columns named in carry.  A line goes if an earlier one, in
    the order of doc_id and line number, has a Jaccard similarity of words of
    percent/100 or more with it, whether that one stays or not.

    Lines without words stay.  Null text has no lines and stays null (the hash
    of an empty text); an empty text is one line without words.  Documents with
    a null doc_id come last.  Rows with equal doc_id are documents of their own,
    one after the other in a fixed order, so of equal rows one keeps its lines.
    An empty table gives no rows; columns not named in carry aren't read.

    Rows are dealt to parts of about part_bytes of text by a hash of doc_id and
    text, once.  What meets in one group is bounded: a cell of the index by
    range_entries and HOT, equal lines by one entry a part.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = docs.sparkSession
    save = Saved(spark)
    text = F.col("text").cast("string")
    size, count = docs.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    parts = max(1, math.ceil((size or 0) / part_bytes), math.ceil(count * 64 / part_bytes))
    part = F.pmod(F.xxhash64("doc_id", text), F.lit(parts)).cast("int")
    rows = docs.select(part.alias("part"), F.col("doc_id").cast("long").alias("doc"), text.alias("text"), F.struct(F.lit(0).alias("glimmer"), *carry).alias("carried"))
    rows = save.bucketed(rows, "part", max(1, math.ceil(parts / 3)))
    texts = rows.select("part", "doc", "text")

    def opened(table):
        """The rows in their order, their places in the order of documents, and their numbers in all parts."""
        table = table.sort_by([("doc", "ascending"), ("text", "ascending")])  # nulls last
        docs = table["doc"].fill_null(LAST).to_numpy()
        return table, docs, (np.int64(table["part"][0].as_py()) << 32) + np.arange(table.num_rows)

    def marked(table):
        """(rows within the part, lines) of the lines that a table names, without repeats."""
        names = [(np.concatenate([[], *(x.values.to_numpy() for x in table[c])]) if table.num_rows else np.zeros(0)).astype(np.int64) for c in ("rows", "lines")]
        both = np.unique(names[0] << 32 | names[1])
        return both >> 32, both & 0xFFFFFFFF

    # One pass: every line's key, and how many lines each word is in.
    key_ranges = max(1, math.ceil((size or 0) / 64 / RANGE))

    def scan(table):
        table, docs, names = opened(table)
        lines = Lines.whole(encoded(table["text"]), Hasher())
        at, digests = lines.keys()
        order = np.lexsort((at, digests[:, 1], digests[:, 0]))
        first = np.ones(len(order), bool)
        first[1:] = (digests[order[1:]] != digests[order[:-1]]).any(axis=1)
        again = at[np.sort(order[~first])]  # equal to an earlier line of the part
        at, digests = at[order[first]], digests[order[first]]
        dealt = (digests[:, 0] % U64(key_ranges)).astype(np.int64)
        order = np.argsort(dealt, kind="stable")
        at, digests = at[order], digests[order]
        keys = dict(zip(KEY.names, (*digests.T, docs[lines.doc[at]], names[lines.doc[at]], lines.number[at]), strict=True))
        edges = np.searchsorted(dealt[order], np.arange(key_ranges + 1)).tolist()
        out = [{"range": i, "packed": pack({n: c[a:b] for n, c in keys.items()})} for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        out += [{"slice": i, "packed": p} for i, p in _word_slices(lines.words)]
        if len(again):
            out.append({"part": table["part"][0].as_py(), "rows": lines.doc[again], "lines": lines.number[again]})
        return pa.Table.from_pylist(out, scanned)

    some_lines = "part int, rows array<int>, lines array<int>"
    lists = [("part", pa.int32()), ("rows", pa.list_(pa.int32())), ("lines", pa.list_(pa.int32()))]
    scanned = pa.schema([("range", pa.int32()), ("slice", pa.int32()), ("packed", pa.binary()), *lists])
    found = save(texts.groupBy("part").applyInArrow(scan, "range int, slice int, packed binary, " + some_lines))

    def add(table):
        return pa.table({"slice": table["slice"].slice(0, 1), "packed": pa.array([_packed_counts(_summed(table["packed"].to_pylist()))], pa.binary())})

    def coded(table):
        total = _summed(table["packed"].to_pylist())
        return pa.table({"slice": table["slice"].slice(0, 1), "codes": pa.array([code(total).tobytes()], pa.binary()), "words": pa.array([int(total.sum())])})

    slices = found.where("slice IS NOT NULL").select("slice", "packed", F.pmod(F.xxhash64("packed"), F.lit(16)).alias("some"))
    slices = slices.groupBy("slice", "some").applyInArrow(add, "slice int, packed binary").groupBy("slice").applyInArrow(coded, "slice int, codes binary, words long")
    codes, totals, wide = np.zeros(1 << TABLE_BITS, np.uint8), 0, (1 << TABLE_BITS) // SLICES
    for r in slices.collect():  # the table: SLICES rows, 4 MB
        codes[r["slice"] * wide : (r["slice"] + 1) * wide] = np.frombuffer(r["codes"], np.uint8)
        totals += r["words"]
    table = spark.sparkContext.broadcast(codes)

    def repeats(data):
        """Lines that equal an earlier one of another part."""
        keys = np.concatenate([unpack(p, KEY)[0] for p in data["packed"].to_pylist()])
        keys = keys[np.lexsort([keys[c] for c in reversed(KEY.names)])]
        again = np.flatnonzero((keys["a"][1:] == keys["a"][:-1]) & (keys["b"][1:] == keys["b"][:-1])) + 1
        out = list(_by_part(keys["row"][again], keys["line"][again]))
        return pa.table([pa.array(x, f.type) for x, f in zip(([p for p, _, _ in out], [r for _, r, _ in out], [n for _, _, n in out]), some_schema, strict=True)], schema=some_schema)

    some_schema = pa.schema(lists)
    equal = found.where("range IS NOT NULL").select("range", "packed").groupBy("range").applyInArrow(repeats, some_lines)
    gone = save(equal.union(found.where("part IS NOT NULL").select("part", "rows", "lines")))
    save.drop(found)
    ranges = max(1, math.ceil(totals * (1 - percent / 100) / range_entries))

    def listed(lines: DataFrame) -> DataFrame:
        """(part, rows, lines) of lines(row, line): one row a part, whose lines are bounded by its texts.

        It is written, as texts would otherwise be dealt again as this table is.
        """
        return save(lines.groupBy(F.shiftright("row", 32).cast("int").alias("part")).agg(F.collect_list(F.expr("cast(row & 4294967295L AS int)")).alias("rows"), F.collect_list("line").alias("lines")))

    def sender(asked=None):
        def send(data, skip):
            if not data.num_rows:
                return sent_schema.empty_table()
            data, docs, names = opened(data)
            searching = pc.equal(skip["searching"], True)
            lines = Lines.whole(encoded(data["text"]), Hasher(), *marked(skip.filter(pc.invert(searching))))
            mine = None
            if asked is not None:
                lines = lines.with_any(asked.value)
                rows, numbers = marked(skip.filter(searching))
                mine = np.isin(lines.doc << 32 | lines.number, rows << 32 | numbers)
            made = [x for e, s in index_entries(lines, docs, names, table.value, percent, asked and asked.value, mine) for x in cells(e, s, ranges)]
            return pa.table([pa.array([c for c, _, _ in made], pa.int64()), pa.array([x for _, x, _ in made], pa.bool_()), pa.array([p for _, _, p in made], pa.binary())], schema=sent_schema)

        return send

    def partners(low: int, high: int):
        def run(data):
            pairs = candidates(data["packed"].to_pylist(), percent, low, high, data["crossing"][0].as_py())
            return pa.table([pa.array(pairs[n]) for n in PAIR.names], schema=pairs_schema)

        return run

    def mark(parts):
        """The slots of the words that sets (row, line, words) are indexed under, as bits of each slice."""
        for batch in batches(parts):
            sets = batch.column("words").to_pylist()
            n, nowhere = np.array([len(x) // 8 for x in sets], np.int64), np.zeros(len(sets), np.int64)
            lines = Lines(nowhere, nowhere, np.frombuffer(b"".join(sets), U64), np.repeat(np.arange(len(sets)), n))
            found = np.concatenate([e["word"] for e, _ in index_entries(lines, nowhere, nowhere, table.value, percent)])
            bits = np.bincount(found >> (32 - TABLE_BITS), minlength=1 << TABLE_BITS).reshape(SLICES, -1) > 0
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([b.tobytes() for b in np.packbits(bits, axis=1)], pa.binary())], schema=slots)

    def either(data):
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in data["bits"].to_pylist()])
        return pa.table([data["slice"].slice(0, 1), pa.array([bits.tobytes()], pa.binary())], schema=slots)

    def give(data, wanted):
        if not data.num_rows or not wanted.num_rows:
            return sets_schema.empty_table()
        data, _, names = opened(data)
        lines = Lines.some(encoded(data["text"]), Hasher(), *marked(wanted))
        return pa.table([pa.array(names[lines.doc]), pa.array(lines.number.astype(np.int32)), pa.array(list(lines.sets()), pa.binary())], schema=sets_schema)

    def test(parts):
        for batch in batches(parts):
            x = batch.column("x").to_pylist()
            ok = near_enough(x, batch.column("y").to_pylist(), percent)
            out = pa.RecordBatch.from_arrays([batch.column("row"), batch.column("line"), pa.array(x, pa.binary(), mask=ok)], ["row", "line", "words"])
            yield out.filter(pc.or_(pa.array(ok), batch.column("more")))

    def verified(pairs: DataFrame) -> DataFrame:
        """(row, line, words) of the pairs' later lines: words are null where the pair is similar on full sets, else those of a set that has `more`."""
        pairs = save(pairs.select("row", "line", "row2", "line2", "more"))
        wanted = listed(pairs.select("row", "line").union(pairs.select("row2", "line2")).distinct())
        sets = save(texts.groupBy("part").cogroup(wanted.groupBy("part")).applyInArrow(give, "row long, line int, words binary"))
        both = pairs.join(sets.withColumnRenamed("words", "x").hint("shuffle_merge"), ["row", "line"])
        both = both.join(sets.select(F.col("row").alias("row2"), F.col("line").alias("line2"), F.col("words").alias("y")).hint("shuffle_merge"), ["row2", "line2"])
        tested = save(both.select("row", "line", "x", "y", "more").mapInArrow(test, "row long, line int, words binary").distinct())
        save.drop(sets, pairs)
        return tested

    sent_schema = pa.schema([("cell", pa.int64()), ("crossing", pa.bool_()), ("packed", pa.binary())])
    pairs_schema = pa.schema([("row", pa.int64()), ("line", pa.int32()), ("row2", pa.int64()), ("line2", pa.int32()), ("far", pa.int32()), ("more", pa.bool_())])
    sets_schema = pa.schema([("row", pa.int64()), ("line", pa.int32()), ("words", pa.binary())])
    slots = pa.schema([("slice", pa.int32()), ("bits", pa.binary())])
    kinds = "row long, line int, row2 long, line2 int, far int, more boolean"
    skip = gone.withColumn("searching", F.lit(False))
    near, low, high, asked, failed = None, 0, 1, None, None
    while True:
        sent = texts.groupBy("part").cogroup(skip.groupBy("part")).applyInArrow(sender(asked), "cell long, crossing boolean, packed binary")
        pairs = save(sent.groupBy("cell").applyInArrow(partners(low, high), kinds))
        closest = save(pairs.groupBy("row", "line").agg(F.min(F.struct("far", "row2", "line2")).alias("c"), F.count("*").alias("n"), F.max("more").alias("more")).select("row", "line", "c.row2", "c.line2", "n", "more"))
        # Of later rounds' sets the closest one hardly ever passes: if there are few candidates, all are verified at once.
        few = failed is not None and pairs.count() <= FEW
        passed = verified(pairs.select("row", "line", "row2", "line2", F.lit(False).alias("more")).distinct() if few else closest)
        if failed is None:
            failed = passed.where("words IS NOT NULL")  # all sets of later rounds are among these
        passed = passed.where("words IS NULL").select("row", "line")
        if not few:
            others = pairs.join(closest.where("n > 1").select("row", "line"), ["row", "line"], "left_semi").join(passed, ["row", "line"], "left_anti")
            others = save(others.select("row", "line", "row2", "line2").distinct().join(closest, ["row", "line", "row2", "line2"], "left_anti"))
            if others.take(1):
                passed = passed.union(verified(others.withColumn("more", F.lit(False))).select("row", "line"))
            save.drop(others)
        near = save(passed if near is None else near.union(passed).distinct())
        left = save(closest.where("more").select("row", "line").join(near, ["row", "line"], "left_anti"))
        save.drop(pairs, closest)
        if not left.take(1):
            break
        # Sets that are still open ask for the entries of all sets under their words again.
        bits = failed.join(left.hint("shuffle_merge"), ["row", "line"], "left_semi").mapInArrow(mark, "slice int, bits binary")
        bits = bits.groupBy("slice", F.pmod(F.xxhash64("bits"), F.lit(64))).applyInArrow(either, "slice int, bits binary").groupBy("slice").applyInArrow(either, "slice int, bits binary")
        flags = {r["slice"]: np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool) for r in bits.collect()}  # SLICES rows, 0.5 MB
        asked = spark.sparkContext.broadcast(np.concatenate([flags[i] for i in range(SLICES)]))
        skip = gone.withColumn("searching", F.lit(False)).union(listed(left).withColumn("searching", F.lit(True)))
        low, high = high, high * 16

    # Lines that go: those that equal an earlier line, and those with an earlier similar one.
    name = "kept_sha256" if as_digest else "kept"
    carried = rows.schema["carried"].dataType.simpleString()

    def finish(data, drop):
        data, _, _ = opened(data)  # every part that has lines to drop has rows
        drop_rows, drop_lines = marked(drop)
        cuts = np.searchsorted(drop_rows, np.arange(data.num_rows + 1)).tolist()
        n_lines, removed, kept = [], [], []
        for i, raw in enumerate(data["text"].cast("binary").to_pylist()):
            split, numbers = [] if raw is None else raw.split(b"\n"), drop_lines[cuts[i] : cuts[i + 1]].tolist()
            n_lines.append(len(split))
            removed.append(numbers)
            if numbers:
                out = set(numbers)
                raw = b"\n".join([x for k, x in enumerate(split) if k not in out])
            kept.append(hashlib.sha256(raw or b"").hexdigest() if as_digest else None if raw is None else raw.decode("utf-8", "replace"))
        return pa.table([data["doc"], pa.array(n_lines, pa.int64()), pa.array([len(x) for x in removed], pa.int64()), pa.array(removed, pa.list_(pa.int32())), pa.array(kept, pa.string()), data["carried"]], names=["doc_id", "n_lines", "n_removed", "removed", name, "carried"])

    kind = f"doc_id long, n_lines long, n_removed long, removed array<int>, {name} string, carried {carried}"
    drop = gone.union(listed(near))
    out = rows.groupBy("part").cogroup(drop.groupBy("part")).applyInArrow(finish, kind)
    return out.select("doc_id", "n_lines", "n_removed", "removed", name, *(F.col("carried")[c].alias(c) for c in carry))
