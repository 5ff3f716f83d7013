"""Exact similarity join of shingle sets by PartEnum signatures.

A document is the set of its five-word shingles (lower-cased A-Z); equal sets
are one node.  Sizes are cut into bands so wide that linked sets are in the same
or in neighbouring bands, so a set signs for its own band and for the next one.
Within a band, linked sets differ in k features at most.  The domain of features
(hash values) is cut into first-level partitions, so many that linked sets differ
in at most one feature in some of them, and each of those into three parts; of
these, every two are a signature: one feature can spoil only one of the three
parts, so linked sets share a signature.

A signature over parts in which a set has no feature tells nothing and would be
shared by all sorts of sets.  It is left out, and there are some more partitions than
the bound asks for: linked sets agree in several of them, and could miss each other
only if in as many partitions the set has a pair of empty parts.  Such a set can
only miss sets of its kind, so those sign once more, with other hashes, and
again if need be; those left in the last round sign empty parts as well.  A set
too small to be linked with any but its equals, which are one node, signs nothing.

Sets that share signatures are candidates, linked when their full sets say so.
Each group has a centre, and a set is first paired with a few centres of its
groups; where a group's sets aren't in one component after that, all its pairs of
different components are compared by sketches, in blocks, and near pairs are
confirmed in the same way, so no link is lost to the choice of centres.  A centre's
groups are mostly of the same sets, one for each signature: they are compared as
one where that makes no more pairs than they have, and so are those of centres
that lead to the same one.  What a task holds at once is
bounded: a group with many rows has its cells in tasks of their own.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.components import components
from glimmer.llm.minhash import _joined, _passing, _sets_of, set_key, shingle_sets, similar
from glimmer.llm.tables import Saved
from glimmer.llm.text import U64, Hasher, batches, encoded, mix

#: Parts of a first-level partition; a signature is all but one of them.
PARTS = 3
#: First-level partitions by which the bound is exceeded, and rounds of signing.
SPARE, ROUNDS = 1.1, 6
#: The smallest hashes of a set kept for the comparison of blocks, 4 bytes each, and by how much their estimate may miss the
#: similarity (6 standard deviations); sets of no more are compared by all of theirs.
LEAST, SLACK = 512, 0.11
#: Sets of a group that are compared at once, sets whose signatures are sent at once, and how many of those make a signature hot.
BLOCK, SETS, HOT = 2048, 2000, 32
#: Centres that a set is paired with before whole groups are looked at.
CENTRES = 3
#: Times that centres are led on to the centres of their own groups before whole groups are compared; each doubles the steps.
JUMPS = 2
#: Rows of cells that are compared at once, about; a group with more has its cells dealt one by one.
CELL_ROWS = 4096
#: Shared hashes and sets of a block that a cell looks at in one step, and candidates that are held before they are looked at.
WIDTH, STRIP, HELD = 512, 256, 1 << 20
_HASHED = U64(0x5851F42D4C957F2D)


def band(size: int, percent: int) -> tuple[int, int]:
    """(number, largest size) of the band that holds a size: bands reach from l to the largest size that a set of l can be linked with."""
    number, low = 0, 1
    while (high := low * 100 // percent) < size:
        number, low = number + 1, high + 1
    return number, high


def bound(high: int, percent: int) -> int:
    """In how many features two linked sets of no more than `high` can differ."""
    return 2 * high * (100 - percent) // (100 + percent)


def alone(size: int, percent: int) -> bool:
    """Whether sets of this size are linked with equal ones only: the most alike of all others has one feature more."""
    return 100 * size < percent * (size + 1)


def signatures(shingles: np.ndarray, percent: int) -> np.ndarray:
    """All signatures of a non-empty set of sorted hashes: for its own band and for the next."""
    number, high = band(len(shingles), percent)
    out = []
    for instance, high in ((number, high), (number + 1, (high + 1) * 100 // percent)):
        k = bound(high, percent)
        partitions = math.ceil((k // 2 + 1) * SPARE) + (k > 0)
        agreeing = partitions - k // 2  # in so many of them, linked sets differ in one feature at most
        for turn in range(ROUNDS):
            own, empty = _signed(shingles, instance, turn, partitions, turn + 1 == ROUNDS)
            out.append(own)
            if empty < agreeing:
                break
    return np.unique(np.concatenate(out))


def _signed(shingles: np.ndarray, instance: int, turn: int, partitions: int, with_empty: bool) -> tuple[np.ndarray, int]:
    """The signatures of one round, and the number of partitions in which some have no feature."""
    values = shingles if not turn else np.sort(mix(shingles ^ U64(turn)))
    place = ((values >> U64(32)) * U64(partitions * PARTS)) >> U64(32)
    ends = np.searchsorted(place, np.arange(partitions * PARTS + 1, dtype=U64))
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(values ^ _HASHED), dtype=U64)])
    part = (sums[ends[1:]] - sums[ends[:-1]]).reshape(partitions, PARTS)
    n = np.diff(ends).reshape(partitions, PARTS)
    tags = mix(np.arange(partitions * PARTS, dtype=U64).reshape(partitions, PARTS) + (U64(instance * ROUNDS + turn + 1) << U64(32)))
    out = mix(part.sum(axis=1, dtype=U64, keepdims=True) - part + tags)
    full = n.sum(axis=1, keepdims=True) > n
    return out.ravel() if with_empty else out[full], int((~full.all(axis=1)).sum())


def sketch(shingles: np.ndarray) -> bytes:
    return (shingles[:LEAST] >> U64(32)).astype("<u4").tobytes()


def estimate(one: np.ndarray, other: np.ndarray, whole: bool) -> float:
    """The Jaccard similarity of two sets by their sketches; whole: both hold all of their sets."""
    both = np.sort(np.concatenate([one, other]), kind="stable")
    again = both[1:] == both[:-1]
    n = int(again.sum())
    if whole or len(both) - n <= LEAST:
        return n / max(len(both) - n, 1)
    last = both[np.concatenate([[True], ~again])][LEAST - 1]
    return float((both[1:][again] <= last).sum()) / LEAST


def _enough(both, n, m, percent: int):
    """Whether sets of n and m that share so many 32 bits may be linked: two of a set that are equal by chance may have been counted once."""
    return (both >= (percent / 100 - 0.03) * (n + m - both)) & (100 * (both + 2) >= percent * (n + m - both - 2))


def _may_link(x: np.ndarray, y: np.ndarray, n: int, m: int, percent: int) -> bool:
    if 100 * min(n, m) < percent * max(n, m):
        return False
    if n <= LEAST and m <= LEAST:
        return bool(_enough(n + m - len(np.union1d(x, y)), n, m, percent))
    return estimate(x, y, False) >= percent / 100 - SLACK


def matched(nodes: np.ndarray, signed: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, node) of the groups of nodes that share a signature; groups of the same nodes once.

    key tells groups apart by their nodes, wherever they are found; a group
    that has a hot entry, and so has more nodes elsewhere, by its signature.
    """
    order = np.lexsort((nodes, signed))
    nodes, signed, hot = nodes[order], signed[order], hot[order]
    edges = np.flatnonzero(np.concatenate([[True], signed[1:] != signed[:-1], [True]])) if len(signed) else np.zeros(1, np.int64)
    hot = np.logical_or.reduceat(hot, edges[:-1]) if len(signed) else hot
    new = np.ones(len(nodes), bool)
    new[1:] = (signed[1:] != signed[:-1]) | (nodes[1:] != nodes[:-1])
    nodes, signed = nodes[new], signed[new]
    edges = np.flatnonzero(np.concatenate([[True], signed[1:] != signed[:-1], [True]])) if len(signed) else np.zeros(1, np.int64)
    sizes = np.diff(edges)
    large = (sizes > 1) | hot
    at = np.repeat(large, sizes)
    nodes, signed, sizes, hot = nodes[at], signed[at], sizes[large], hot[large]
    starts = np.cumsum(sizes) - sizes
    keys = np.where(hot, mix(signed[starts]), mix(np.add.reduceat(mix(nodes.astype(U64)), starts))) if len(sizes) else np.zeros(0, U64)
    _, once = np.unique(keys, return_index=True)
    kept = np.zeros(len(sizes), bool)
    kept[once] = True
    at = np.repeat(kept, sizes)
    return np.repeat(keys.view(np.int64), sizes)[at], nodes[at]


def jaccard_components(docs: DataFrame, percent: int = 80, rows_per_bucket: int = 4000, range_signatures: int = 1 << 21) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs(doc_id, text, ...).

    Documents whose shingle sets have a Jaccard similarity of percent/100 or
    more are linked; component_id is the smallest doc_id that links reach.  A
    text with fewer than five words has its whole word sequence as its one
    shingle; null text and text without words have none and are linked with
    nothing (each its own component).

    If a doc_id has several texts, a link of any of them counts for equal sets.
    A null doc_id takes no part: its component_id is null.  An empty table
    gives no rows; further columns aren't read.
    """
    import pyarrow as pa

    save = Saved(docs.sparkSession)
    given = docs.selectExpr("cast(doc_id as bigint) AS doc_id", "cast(text as string) AS text")
    # Texts are read again by doc_id: dealt by it once, later joins need not move them.
    rows = save.bucketed(given.where("doc_id IS NOT NULL"), "doc_id", max(1, math.ceil(given.count() / rows_per_bucket)))

    def measure(parts):
        hasher = Hasher()
        for batch in batches(parts):
            sets = shingle_sets(encoded(batch.column("text")), hasher)
            keys, sketches = zip(*((set_key(s), sketch(s)) if len(s) else (None, None) for s in sets), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "n_shingles", "set_key", "sketch"])

    measured = save(rows.union(given.where("doc_id IS NULL")).mapInArrow(measure, "doc_id long, n_shingles long, set_key binary, sketch binary"))
    nodes = save(measured.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    slim = save(measured.select("doc_id", "n_shingles", "set_key"))
    save.drop(measured)
    about = nodes.agg(F.sum("n_shingles")).first()[0] or 0
    bits = max(1, math.ceil(math.log2(max(2, about / range_signatures))))

    def sign(parts):
        hasher = Hasher()
        for batch in batches(parts, SETS):
            ids, signed = batch.column("doc_id").to_numpy(), []
            for s in shingle_sets(encoded(batch.column("text")), hasher):
                signed.append(np.zeros(0, U64) if alone(len(s), percent) else signatures(s, percent))
            flat, who = np.concatenate(signed), np.repeat(np.argsort(np.argsort(ids, kind="stable")), [len(x) for x in signed])
            ids = np.sort(ids)
            # Of a signature that many sets of the batch have, the first set stands for all where signatures meet.
            _, which, n = np.unique(flat, return_inverse=True, return_counts=True)
            hot = n[which] >= HOT
            least = np.full(len(n), len(ids))
            np.minimum.at(least, which[hot], who[hot])
            first = hot & (who == least[which])
            rest = 1 + int(mix(ids[:1].astype(U64))[0] >> U64(40)) if len(ids) else 0
            out = []
            for some, sub, is_hot in ((~hot, 0, False), (first, 0, True), (hot, rest, True)):
                out += [(r, sub, is_hot, *x) for r, *x in _packed(flat[some], who[some], ids, bits)]
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, sent.types, strict=True)], schema=sent)

    def match(table):
        ids, n = (np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in (("ids", "<i8"), ("n", "<u4")))
        low, high = (np.frombuffer(b"".join(table[c].to_pylist()), kind).astype(U64) for c, kind in (("low", "<u4"), ("high", "<u2")))
        hot = np.repeat(np.array(table["hot"].to_pylist(), bool), [len(x) // 4 for x in table["low"].to_pylist()])
        key, node = matched(np.repeat(ids, n), U64(table["range"][0].as_py()) << U64(48) ^ (high << U64(32) | low), hot)
        return pa.table({"key": key, "node": node})

    sent = pa.schema([("range", pa.int32()), ("sub", pa.int32()), ("hot", pa.bool_()), *((c, pa.binary()) for c in ("ids", "n", "low", "high"))])
    signing = rows.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    signed = signing.mapInArrow(sign, "range int, sub int, hot boolean, ids binary, n binary, low binary, high binary")
    grouped = groups = save(signed.groupBy("range", "sub").applyInArrow(match, "key long, node long").distinct())
    sketches = nodes.select("node", F.struct("sketch", "n_shingles").alias("own"))

    def near(x, y) -> bool:
        return _may_link(np.frombuffer(x["sketch"], "<u4"), np.frombuffer(y["sketch"], "<u4"), x["n_shingles"], y["n_shingles"], percent)

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = save(pairs)
        sets = save(_sets_of(rows, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()))
        out = save(_passing(_joined(pairs, sets, "shingles"), lambda x, y: similar(np.frombuffer(x, U64), np.frombuffer(y, U64), percent)))
        save.drop(sets, pairs)
        return out

    # A star's centre is the set that is in the most groups: likely the text that the others are edits of.  A set is paired with
    # a few such centres, not with those of all its groups.
    met = groups.groupBy("node").agg(F.count("*").alias("met"))
    hubs = groups.join(met, "node").groupBy("key").agg(F.max(F.struct("met", (-F.col("node")).alias("least"))).alias("hub"))
    groups = save(groups.join(hubs, "key").select("key", "node", (-F.col("hub.least")).alias("hub"), F.col("hub.met").alias("met")))
    best = F.slice(F.sort_array(F.collect_set(F.struct("met", "hub")), asc=False), 1, CENTRES)
    stars = save(groups.where("hub <> node").groupBy("node").agg(best.alias("best")))
    pairs = save(stars.select("node", F.explode("best.hub").alias("hub")).select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct())
    links = confirmed(_passing(_joined(pairs, sketches, "own"), near))
    labels = save(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    save.drop(links)

    # Groups whose nodes are not yet in one component: pairs of different components there.
    placed = groups.join(labels.withColumnRenamed("u", "node"), "node", "left").select("key", "hub", "node", F.coalesce("component", "node").alias("component"))
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.min("node").alias("a"), F.max("node").alias("b")).where("main.n < all")
    sizes = save(sizes)
    # Those of two nodes are pairs as they are: one that the few centres of both left out is compared here.
    twos = save(sizes.where("all = 2").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"))
    mixed = save(placed.join(sizes.where("all > 2").select("key", "all"), "key"))
    save.drop(groups, grouped, sizes)
    more = save(_passing(_joined(twos, sketches, "own"), near))
    if mixed.take(1):
        cells = _cells(save, mixed, stars.select(F.col("node").alias("hub"), F.col("best")[0]["hub"].alias("top")))
        tasks = max(1, math.ceil(cells.count() / CELL_ROWS))
        task = F.pmod(F.xxhash64("hub", "key", F.when(F.col("cut"), F.col("cell"))), F.lit(tasks))
        spread = cells.select(task.alias("task"), "hub", "key", "cell.i", "cell.j", "own", "node", "component").join(nodes.select("node", "n_shingles", "sketch"), "node")
        found = save(spread.groupBy("task").applyInArrow(_compare(percent), "a long, b long").distinct())
        more = found.join(pairs, ["a", "b"], "left_anti").union(more).distinct()
        save.drop(cells)
    save.drop(stars)
    if more.take(1):
        links = confirmed(more)
        labels = save(components(labels.select("u", F.col("component").alias("v")).union(links.select("a", "b"))))
        save.drop(links)
    whole = save(nodes.select("set_key", "node").join(labels.withColumnRenamed("u", "node"), "node", "left").select("set_key", F.coalesce("component", "node").alias("component")))
    save.drop(rows, nodes, pairs, mixed, labels)
    return slim.join(whole, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def _packed(flat: np.ndarray, who: np.ndarray, ids: np.ndarray, bits: int):
    """(range, nodes, number of signatures of each, 32 and 16 bits of those) by the first bits of the signatures."""
    span = (flat >> U64(64 - bits)).astype(np.int64)
    order = np.lexsort((who, span))
    span, flat, who = span[order], flat[order], who[order]
    edges = np.flatnonzero(np.concatenate([[True], span[1:] != span[:-1], [True]])) if len(flat) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own, n = np.unique(who[a:b], return_counts=True)
        yield int(span[a]), ids[own].astype("<i8").tobytes(), n.astype("<u4").tobytes(), flat[a:b].astype("<u4").tobytes(), (flat[a:b] >> U64(32)).astype("<u2").tobytes()


def _cells(save: Saved, mixed: DataFrame, tops: DataFrame) -> DataFrame:
    """hub, key, cell, own, node, component, cut: the blocks that the sets of mixed(key, hub, node, component, all) are compared in; all: the sets of a key.

    tops(hub, top): the best centre of a set's groups, itself left out.  Groups of a centre become one (key 0), and those of
    all centres that lead to the same one (key 1), where that makes no more pairs.  cut: the group has more than CELL_ROWS rows.
    """
    hubs = save(tops.join(mixed.select("hub").distinct(), "hub", "left_semi"))
    for _ in range(JUMPS):
        further = save(hubs.join(hubs.select(F.col("hub").alias("top"), F.col("top").alias("next")), "top", "left").select("hub", F.coalesce("next", "top").alias("top")))
        save.drop(hubs)
        hubs = further
    sets = save(mixed.groupBy("hub", "node").agg(F.sum("all").alias("pairs")).join(hubs, "hub", "left").select("hub", F.coalesce("top", "hub").alias("top"), "node", "pairs"))
    by_hub = sets.groupBy("hub", "top").agg(F.count("*").alias("n"), F.sum("pairs").alias("pairs")).selectExpr("hub", "top", "n * n <= pairs AS as_one", "least(n * n, pairs) AS pairs")
    by_top = sets.select("top", "node").distinct().groupBy("top").agg(F.count("*").alias("n")).join(by_hub.groupBy("top").agg(F.sum("pairs").alias("pairs")), "top")
    as_one = save(by_hub.join(by_top.selectExpr("top", "n * n <= pairs AS at_top"), "top").where("as_one OR at_top").selectExpr("hub", "if(at_top, top, hub) AS centre", "if(at_top, 1L, 0L) AS one"))
    groups = save(mixed.join(as_one, "hub", "left").select(F.coalesce("centre", "hub").alias("hub"), F.coalesce("one", "key").alias("key"), "node", "component").distinct())
    save.drop(hubs, sets, as_one)
    sizes = groups.groupBy("hub", "key", "component").agg(F.count("*").alias("n")).groupBy("hub", "key").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("all"))
    n, rest = F.col("main.n"), F.col("all") - F.col("main.n")
    m, k = (F.ceil(x / BLOCK).cast("int") for x in (n, rest))
    sizes = sizes.select("hub", "key", F.col("main.component").alias("main"), m.alias("m"), k.alias("k"), (n * k + rest * (m + k) > CELL_ROWS).alias("cut"))
    # Blocks 0 ... m-1 have the largest component, the k after them the rest; every pair of blocks with one of the rest is a cell.
    is_main = F.col("component") == F.col("main")
    own = F.when(is_main, F.pmod(F.xxhash64("node"), F.col("m"))).otherwise(F.col("m") + F.pmod(F.xxhash64("node"), F.col("k"))).cast("int")
    others = F.sequence(F.when(is_main, F.col("m")).otherwise(0), F.col("m") + F.col("k") - 1)
    cells = F.transform(others, lambda i: F.struct(F.least(own, i).alias("i"), F.greatest(own, i).alias("j")))
    out = save(groups.join(sizes, ["hub", "key"]).select("hub", "key", F.explode(cells).alias("cell"), own.alias("own"), "node", "component", "cut"))
    save.drop(groups)
    return out


def _shared(sketches: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, value number) of the sketches' values that more than one of them has."""
    flat, row = np.concatenate(sketches), np.repeat(np.arange(len(sketches)), [len(x) for x in sketches])
    _, which, n = np.unique(flat, return_inverse=True, return_counts=True)
    some = n[which] > 1
    return row[some], np.unique(which[some], return_inverse=True)[1]


def _candidates(least: list[np.ndarray], size: np.ndarray, ones: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Which of others (places in the lists of sketches and sizes) may be linked with each of ones, by the values that their sketches share.

    Large sets that are similar enough share at least so many of their LEAST smallest values as estimate() has to find.
    """
    every, place = np.unique(np.concatenate([ones, others]), return_inverse=True)
    row, value = _shared([least[k] for k in every.tolist()])
    both, values = np.zeros((len(ones), len(others)), np.float32), int(value.max(initial=-1)) + 1
    for begin in range(0, values, WIDTH):
        some = (value >= begin) & (value < begin + WIDTH)
        there = np.zeros((len(every), min(WIDTH, values - begin)), np.float32)
        there[row[some], value[some] - begin] = 1
        both += there[place[: len(ones)]] @ there[place[len(ones) :]].T
    may = np.zeros(both.shape, bool)
    for begin in range(0, len(ones), STRIP):
        strip = slice(begin, begin + STRIP)
        n, m = size[ones[strip]][:, None], size[others][None, :]
        fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        whole = (n <= LEAST) & (m <= LEAST)
        may[strip] = fits & np.where(whole, _enough(both[strip], n, m, percent), both[strip] >= (percent / 100 - SLACK) * LEAST)
    return may


def _compare(percent: int):
    """Pairs of different components in the cells of a task that may be linked; of those that surely are, just what joins the components."""
    import pyarrow as pa

    def compare(table):
        hub, key, i, j, own = (table[c].to_numpy() for c in ("hub", "key", "i", "j", "own"))
        node, row, place = np.unique(table["node"].to_numpy(), return_index=True, return_inverse=True)
        component, size = (table[c].to_numpy()[row] for c in ("component", "n_shingles"))
        least = [np.frombuffer(table["sketch"][k].as_buffer(), "<u4") for k in row.tolist()]
        order = np.lexsort((j, i, key, hub))
        new = np.logical_or.reduce([x[order[1:]] != x[order[:-1]] for x in (hub, key, i, j)])
        edges = np.flatnonzero(np.concatenate([[True], new, [True]]))
        root = {c: c for c in set(component.tolist())}
        out = [np.zeros(0, np.int64)]

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        def near(codes):
            for code in codes.tolist():
                k, m = divmod(code, len(node))
                a, b = find(int(component[k])), find(int(component[m]))
                if a == b or not _may_link(least[k], least[m], size[k], size[m], percent):
                    continue
                # Sets that are linked even if two of their equal 32 bits belong to different shingles join components here.
                if size[k] <= LEAST and size[m] <= LEAST:
                    union = len(np.union1d(least[k], least[m]))
                    if 100 * (int(size[k] + size[m]) - union - 2) >= percent * (union + 2):
                        root[a] = b
                yield code

        def look(codes):
            for begin in range(0, len(codes), 1 << 16):
                out.append(np.fromiter(near(codes[begin : begin + (1 << 16)]), np.int64))

        # A pair can be in many cells: it is looked at once, as long as no more are held than so many.
        found, held = [np.zeros(0, np.int64)], 0
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            some = order[a:b]
            ones, others = (place[some[own[some] == x[some[0]]]] for x in (i, j))
            if not len(ones) or not len(others):
                continue
            may = _candidates(least, size, ones, others, percent)
            for begin in range(0, len(ones), STRIP):
                strip = ones[begin : begin + STRIP]
                x, y = np.nonzero(may[begin : begin + STRIP] & (component[strip][:, None] != component[others][None, :]))
                x, y = strip[x], others[y]
                found.append(np.minimum(x, y) * len(node) + np.maximum(x, y))
                held += len(x)
                if held > HELD:
                    found = [np.unique(np.concatenate(found))]
                    held = len(found[0])
                    if held > HELD // 2:
                        look(found.pop())
                        found, held = [np.zeros(0, np.int64)], 0
        look(np.unique(np.concatenate(found)))
        codes = np.concatenate(out)
        return pa.table({"a": node[codes // len(node)], "b": node[codes % len(node)]})

    return compare
