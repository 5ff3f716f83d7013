"""Near-duplicate documents: MinHash banding, verification, components by large-star and small-star.

A document is the set of its five-word shingles (lower-cased A-Z).  Equal sets
are one node.  Each set has 4 x 48 minima of universal hashes; sets that agree
in one of 48 bands of 4 minima are candidates (a pair at similarity 0.75 agrees
in none with a chance of 1e-8).  First each band value's sets are paired with
one of them, in a star; pairs whose signatures agree enough are then
confirmed on full shingle sets.  Where the sets of a band value are not in one
component after that, all its pairs of different components are compared by
signature, in blocks of bounded size, and the near ones confirmed once in the
same way: no link is lost to the choice of a star's centre, and no pairs within a
component are made.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.components import components
from glimmer.llm.tables import Saved
from glimmer.llm.text import U64, Hasher, batches, encoded, mix

ROWS, BANDS = 4, 48
#: Pairs whose signatures agree by this much less than asked are no links: 6 standard deviations of 192 minima at 0.75.
SLACK = 0.19
#: The smallest shingle hashes kept of each set, 4 bytes each: sets of no more are compared by all of theirs, larger ones by an
#: estimate that may miss the similarity asked for by so much (6 standard deviations).
LEAST, LEAST_SLACK = 512, 0.12
#: Sets of one band value that are compared within one task.
BLOCK = 2048
SHINGLE = 5
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.random.PCG64(0x31A5).random_raw(2 * n).astype(U64)
    return raw[:n] | U64(1), raw[n:]


def signatures(sets: list[np.ndarray], n: int = ROWS * BANDS) -> np.ndarray:
    """Signatures of many non-empty sets at once."""
    a, b = _multipliers(n)
    flat = np.concatenate(sets) if sets else np.zeros(0, U64)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), n), np.uint32)
    if len(sets):
        work = np.empty(len(flat), U64)
        for j in range(n):
            np.multiply(flat, a[j], out=work)
            np.add(work, b[j], out=work)
            out[:, j] = np.minimum.reduceat(work, starts) >> U64(32)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row; the band's number enters."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(U64)
    factors = np.random.PCG64(7).random_raw(ROWS).astype(U64) | U64(1)
    return mix((parts * factors).sum(axis=2, dtype=U64) + mix(np.arange(BANDS, dtype=U64) + U64(1)))


def shingle_sets(texts: list[bytes], hasher: Hasher) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, lower-cased."""
    words, counts = hasher.words([t.translate(_LOWER) for t in texts])
    return list(hasher.shingles(words, counts, SHINGLE))


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    total = np.array([shingles.sum(dtype=U64), mix(shingles ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)])
    return total.tobytes()


def agreement(one: bytes, other: bytes) -> float:
    """Share of equal minima; a byte is kept of each, so unequal ones agree once in 256."""
    return float((np.frombuffer(one, np.uint8) == np.frombuffer(other, np.uint8)).mean())


def similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    small, large = (one, other) if len(one) <= len(other) else (other, one)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(one) + len(other) - both)


def _sets_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the documents in wanted(doc_id); repeated rows give theirs once in a task."""
    import pyarrow as pa

    def make(parts):
        hasher, seen = Hasher(), set()
        for batch in batches(parts, 500):
            ids, sets = batch.column("doc_id").to_pylist(), shingle_sets(encoded(batch.column("text")), hasher)
            new = [(i, s.tobytes()) for i, s in zip(ids, sets, strict=True) if len(s) and not ((key := (i, set_key(s))) in seen or seen.add(key))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in new], pa.int64()), pa.array([s for _, s in new], pa.binary())], ["node", "shingles"])

    return rows.join(wanted, "doc_id", "left_semi").mapInArrow(make, "node long, shingles binary")


def _joined(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Adds x and y, the values of a and b."""
    one = pairs.join(values.select(F.col("node").alias("a"), F.col(name).alias("x")), "a")
    return one.join(values.select(F.col("node").alias("b"), F.col(name).alias("y")), "b").select("a", "b", "x", "y")


def _passing(both: DataFrame, test) -> DataFrame:
    import pyarrow as pa

    def run(parts):
        for batch in parts:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            yield batch.select(["a", "b"]).filter(pa.array(list(map(test, x, y)), pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75, rows_per_bucket: int = 4000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs(doc_id, text, ...).

    Documents whose shingle sets have a Jaccard similarity of percent/100 or
    more are linked; component_id is the smallest doc_id that links reach, kept
    tells whether it is the document's own.  A text with fewer than five words
    has its whole word sequence as its one shingle; null text and text without
    words have none and are linked with nothing (each its own component).

    Repeated rows are all kept or all not; if a doc_id has several texts, a
    link of any of them that stands for equal sets counts.  A null doc_id takes
    no part: its component_id is null and it is kept.  An empty table gives no
    rows; further columns aren't read.  percent should be 70 or more: the bands
    are laid out for 75.
    """
    import pyarrow as pa

    save = Saved(docs.sparkSession)
    least = percent / 100 - SLACK
    given = docs.selectExpr("cast(doc_id as bigint) AS doc_id", "cast(text as string) AS text")
    # Texts are read again by doc_id: dealt by it once, later joins need not move them.  Those without one stay where they are.
    rows = save.bucketed(given.where("doc_id IS NOT NULL"), "doc_id", max(1, math.ceil(given.count() / rows_per_bucket)))
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.binary()), ("signature", pa.binary()), ("least", pa.binary())])

    def measure(parts):
        hasher, known = Hasher(), {}
        for batch in batches(parts):
            sets = shingle_sets(encoded(batch.column("text")), hasher)
            keys = [set_key(s) if len(s) else None for s in sets]
            if len(known) > 20_000:
                known = {}  # before it is looked up: every set of this batch is in it below
            new = {k: s for k, s in zip(keys, sets, strict=True) if k and k not in known}
            found = signatures(list(new.values()))
            known |= {k: (b.tobytes(), s.tobytes(), least_hashes(x).tobytes()) for (k, x), b, s in zip(new.items(), band_keys(found), found.astype(np.uint8), strict=True)}
            more = [known.get(k, (None,) * 3) for k in keys]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, f.type) for x, f in zip(([len(s) for s in sets], keys, *([m[i] for m in more] for i in range(3))), list(schema)[1:], strict=True))], schema=schema)

    measured = save(rows.union(given.where("doc_id IS NULL")).mapInArrow(measure, "doc_id long, n_shingles long, set_key binary, bands binary, signature binary, least binary"))
    # Equal sets are one node, named by their smallest doc_id, whose text is read again where its set is needed.
    full = measured.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    nodes = save(full.groupBy("set_key").agg(F.min("doc_id").alias("node"), *[F.first(c, ignorenulls=True).alias(c) for c in ("n_shingles", "bands", "signature", "least")]))
    slim = save(measured.select("doc_id", "n_shingles", "set_key"))
    save.drop(measured)
    signed = nodes.select("node", "signature")

    def unpack(parts):
        for batch in parts:
            keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column("node").to_numpy(), BANDS))], ["band", "node"])

    banded = nodes.select("node", "bands").mapInArrow(unpack, "band long, node long")
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    groups = banded_groups = save(banded.join(shared, "band").select("band", "n", "node"))
    # A star's centre is the set that meets the most others over all its bands: likely the text that the others are edits of.
    met = groups.groupBy("node").agg(F.sum("n").alias("met"))
    groups = groups.join(met, "node").select("band", "node", "met")
    hubs = groups.groupBy("band").agg(F.max(F.struct("met", (-F.col("node")).alias("least"))).alias("hub")).select("band", (-F.col("hub.least")).alias("hub"))
    groups = save(groups.join(hubs, "band").select("band", "hub", "node"))
    save.drop(banded_groups)

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = save(pairs)
        sets = save(_sets_of(rows, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()))
        out = save(_passing(_joined(pairs, sets, "shingles"), lambda x, y: similar(np.frombuffer(x, U64), np.frombuffer(y, U64), percent)))
        save.drop(sets, pairs)
        return out

    pairs = save(groups.where("hub <> node").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct())
    links = confirmed(_passing(_joined(pairs, signed, "signature"), lambda x, y: agreement(x, y) >= least))
    labels = save(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    save.drop(links)

    # Band values whose nodes are not yet in one component: pairs of different components there.
    placed = groups.join(labels.withColumnRenamed("u", "node"), "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    sizes = placed.groupBy("band", "component").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("band").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("all")).where("main.n < all")
    sizes = sizes.select("band", F.col("main.component").alias("main"), F.ceil(F.col("main.n") / BLOCK).cast("int").alias("m"), F.ceil((F.col("all") - F.col("main.n")) / BLOCK).cast("int").alias("k"))
    mixed = save(placed.join(sizes, "band"))
    save.drop(groups)
    if mixed.take(1):
        # Blocks 0 ... m-1 have the largest component, the k after them the rest; every pair of blocks with one of the rest is a cell.
        is_main = F.col("component") == F.col("main")
        own = F.when(is_main, F.pmod(F.xxhash64("node"), F.col("m"))).otherwise(F.col("m") + F.pmod(F.xxhash64("node"), F.col("k"))).cast("int")
        others = F.sequence(F.when(is_main, F.col("m")).otherwise(0), F.col("m") + F.col("k") - 1)
        cells = F.transform(others, lambda i: F.struct(F.least("own", i).alias("i"), F.greatest("own", i).alias("j")))
        spread = mixed.withColumn("own", own).select("band", "node", "component", "own", F.explode(cells).alias("cell"))
        spread = spread.join(nodes.select("node", "signature", "bands", "least", "n_shingles"), "node").select("band", "cell.i", "cell.j", "own", "node", "component", "signature", "bands", "least", "n_shingles")
        more = save(spread.groupBy("band", "i", "j").applyInArrow(_compare(percent), "a long, b long").distinct())
        links = confirmed(more.join(pairs, ["a", "b"], "left_anti"))
        labels = save(components(labels.select("u", F.col("component").alias("v")).union(links.select("a", "b"))))
        save.drop(more, links)
    whole = save(nodes.select("set_key", "node").join(labels.withColumnRenamed("u", "node"), "node", "left").select("set_key", F.coalesce("component", "node").alias("component")))
    # What the result is read from are two tables of a small row for each document and set; the others go.
    save.drop(rows, nodes, pairs, mixed, labels)
    found = slim.join(whole, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _compare(percent: int):
    """Pairs of different components in a cell that are near; of those that are surely linked, just what joins the components."""
    import pyarrow as pa

    def compare(table):
        node, component, own, size = (table[c].to_numpy() for c in ("node", "component", "own", "n_shingles"))
        signs = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint8).reshape(len(node), -1)
        bands, band = np.frombuffer(b"".join(table["bands"].to_pylist()), np.int64).reshape(len(node), -1), table["band"][0].as_py()
        least = [np.frombuffer(x, np.uint32) for x in table["least"].to_pylist()]
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        ones, others = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if len(ones) > len(others):
            ones, others = others, ones
        root = {c: c for c in set(component.tolist())}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        pairs = set()
        for k in ones.tolist():
            at = others[component[others] != component[k]]
            at = at[(signs[at] == signs[k]).mean(axis=1) >= percent / 100 - SLACK]
            first = (bands[at] == bands[k]).argmax(axis=1)  # a pair counts under the first band that it shares
            for m in at[bands[k][first] == band].tolist():
                a, b = find(int(component[k])), find(int(component[m]))
                if a == b:
                    continue
                whole = size[k] <= LEAST and size[m] <= LEAST
                likeness = near_by_least(least[k], least[m], whole)
                # Only pairs that stay links if two of their equal 32 bits belong to different shingles join components here.
                if whole and near_by_least(least[k], least[m], whole, spare=2) >= percent / 100:
                    root[a] = b
                if likeness >= percent / 100 - (0.01 if whole else LEAST_SLACK):
                    pairs.add((min(int(node[k]), int(node[m])), max(int(node[k]), int(node[m]))))
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    return compare


def least_hashes(shingles: np.ndarray) -> np.ndarray:
    """The LEAST smallest of sorted shingle hashes, as their first 32 bits."""
    return (shingles[:LEAST] >> U64(32)).astype(np.uint32)


def near_by_least(one: np.ndarray, other: np.ndarray, whole: bool = False, spare: int = 0) -> float:
    """The Jaccard similarity of two sets by their smallest hashes: as far as 32 bits tell if both are known to be whole, or have fewer than LEAST.

    So many equal hashes as `spare` says are taken for different ones (of sets that are known to be whole)."""
    both = np.concatenate([one, other])
    both.sort()
    twice = np.flatnonzero(both[1:] == both[:-1])
    union = len(both) - len(twice)
    if whole or union <= LEAST or (len(one) < LEAST and len(other) < LEAST):
        return max(0, len(twice) - spare) / max(union + spare, 1)
    # The LEAST smallest of the union: what lies above can be unknown to the other side.
    top = both[np.delete(np.arange(len(both)), twice + 1)][LEAST - 1]
    return float((both[twice] <= top).sum()) / LEAST
