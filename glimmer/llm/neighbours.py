"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every row then goes down to a leaf.  A
query takes leaves from a priority queue, the nodes that promise the largest
inner product first: the product with the node's centre and a share of what its
spread can add.  That share, and how many leaves a query visits, are
calibrated: the true neighbours of a bounded set of queries are found by brute
force over all rows, and the visits widen until enough of those lie in visited
leaves.  Leaves are searched as blocks of rows against blocks of the queries that
visit them, and each query's best of all blocks are merged.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.tables import Saved, Shared

#: Bytes of the sample that the tree is fitted on (double precision), and queries that the visits are calibrated on, at most about.
SAMPLE_BYTES, CALIBRATION = 64 << 20, 256
#: Children of a node, rows of a leaf as fitted, rows of the sample for each leaf at least, rows of a block within a leaf, and queries of a block.
BRANCHES, LEAF_ROWS, SAMPLE_ROWS, BLOCK, QUERIES = 8, 1024, 8, 8192, 16384
#: Shares of a node's spread that are tried in its promise.
SPREADS = (0.0, 0.25, 0.5, 1.0)


class Tree:
    """Nodes with centres; node 0 is the root, leaves have numbers of their own."""

    def __init__(self, rows: np.ndarray, leaves: int, seed: int = 1) -> None:
        self.centres: list[np.ndarray] = [rows.mean(axis=0) if len(rows) else np.zeros(rows.shape[1])]
        self.spread: list[float] = [0.0]  # root mean square of the distances from the centre
        self.children: list[list[int]] = [[]]
        self.leaf_of: list[int] = [-1]
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self._split(0, rows, max(1.0, len(rows) / leaves), rng)

    def _split(self, node: int, rows: np.ndarray, leaf_rows: float, rng) -> None:
        groups = _kmeans(rows, BRANCHES, rng) if len(rows) > 1.5 * leaf_rows else []
        if len(groups) < 2:
            self.leaf_of[node] = self.leaves
            self.leaves += 1
            return
        for group in groups:
            self.children[node].append(len(self.centres))
            self.centres.append(group.mean(axis=0))
            self.spread.append(float(np.sqrt(((group - self.centres[-1]) ** 2).sum(axis=1).mean())))
            self.children.append([])
            self.leaf_of.append(-1)
        for child, group in zip(self.children[node], groups, strict=True):
            self._split(child, group, leaf_rows, rng)

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: down to the nearest centre at each node."""
        out = np.zeros(len(rows), np.int32)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if not self.children[node]:
                out[at] = self.leaf_of[node]
                continue
            centres = np.stack([self.centres[c] for c in self.children[node]])
            nearest = (rows[at] @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
            todo += [(c, at[nearest == i]) for i, c in enumerate(self.children[node])]
        return out

    def visit(self, query: np.ndarray, most: int, share: float = 0.0) -> list[int]:
        """The first leaves that a best-bin-first traversal reaches."""
        if not hasattr(self, "matrix"):
            self.matrix, self.spreads = np.stack(self.centres), np.array(self.spread)
        promise = (self.matrix @ query + share * np.sqrt(query @ query) * self.spreads).tolist()
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                out.append(self.leaf_of[node])
            for child in self.children[node]:
                heapq.heappush(queue, (-promise[child], child))
        return out


def _kmeans(rows: np.ndarray, k: int, rng, rounds: int = 8) -> list[np.ndarray]:
    """Non-empty groups of rows; one group if all are equal."""
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        nearest = (rows @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        used = np.unique(nearest)
        centres = np.stack([rows[nearest == i].mean(axis=0) for i in used])
    nearest = (rows @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
    return [rows[nearest == i] for i in np.unique(nearest)]


def best(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(numbers of queries, their hits, ids, scores): each query's k best rows but itself, in order.

    Ties go to the smaller id; scores are sums of products in a fixed order, the
    same wherever a row is.  A matrix product finds the rows that can be among
    the best; a query with many rows as good as its last is looked at by itself.
    """
    most = min(len(rows), k + 4)
    for begin in range(0, len(queries), 256):
        some, names = queries[begin : begin + 256], query_ids[begin : begin + 256]
        about = some @ rows.T
        at = np.argpartition(-about, most - 1, axis=1)[:, :most]
        picked = np.take_along_axis(about, at, axis=1)
        alone = np.zeros(len(some), bool)
        if most < len(rows):
            last = np.partition(picked, most - k - 1, axis=1)[:, most - k - 1]
            last -= 1e-9 * np.maximum(1.0, np.abs(last))
            alone = (about >= last[:, None]).sum(axis=1) > most - 1
        groups = [(np.flatnonzero(~alone), at[~alone])] + [(np.array([i]), np.flatnonzero(about[i] >= last[i])[None]) for i in np.flatnonzero(alone).tolist()]
        for mine, at in groups:
            if not len(mine):
                continue
            exact = (rows[at] * some[mine][:, None, :]).sum(axis=2)
            own = ids[at]
            exact[own == names[mine][:, None]] = -np.inf
            order = np.lexsort((own, -exact), axis=1)[:, :k]
            exact, own = np.take_along_axis(exact, order, axis=1), np.take_along_axis(own, order, axis=1)
            there = np.isfinite(exact)
            yield begin + mine, there.sum(axis=1), own[there], exact[there]


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, recall: float = 0.97) -> DataFrame:
    """The k rows nearest to each query among vectors(vec_id, embedding, ...): query_id, rank from 1, vec_id, score.

    Queries are the rows whose vec_id is divisible by `every`; candidates are
    all rows with another vec_id; nearness is the inner product in double
    precision, ties go to the smaller vec_id.  `recall` is the share of true
    neighbours that the calibration queries must find.

    Rows with a null vec_id, and vectors that are null, zero, or hold null or
    non-finite components take no part, nor do those whose length isn't the
    commonest (the greater of two equally common).  Rows that repeat a vec_id
    with the same vector count once; with other vectors, each does.  With no
    rows there are no results; further columns aren't read.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = vectors.sparkSession
    save = Saved(spark)
    fine = F.expr("exists(embedding, x -> x <> 0) AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(fine)
    found = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not found:
        return spark.createDataFrame([], schema)
    dim, n = found["dim"], found["count"]
    rows = rows.where(F.size("embedding") == dim)
    by_hash = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 40))
    share = lambda most, of: F.lit(int((1 << 40) * min(1.0, most / max(of, 1))))
    most = max(1024, SAMPLE_BYTES // (8 * dim))
    # Repeated rows are drawn together and count once.
    drawn = rows.where(by_hash < share(most, n)).distinct().orderBy("vec_id").select("embedding")
    sample = np.array([r["embedding"] for r in drawn.toLocalIterator()], np.float64).reshape(-1, dim)
    # A small table has as many leaves as a node has children, if that leaves them 64 rows.
    tree = Tree(sample, max(1, min(len(sample) // SAMPLE_ROWS, max(n // LEAF_ROWS, min(BRANCHES, n // 64)))))
    shared = Shared(spark, tree)

    def place(parts):
        tree = shared.get()
        for batch in parts:
            leaf = tree.assign(_matrix(batch.column("embedding"), dim))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column("vec_id"), batch.column("embedding")], ["leaf", "vec_id", "embedding"])

    kind = rows.schema["embedding"].dataType.simpleString()
    indexed = save(rows.mapInArrow(place, f"leaf int, vec_id long, embedding {kind}").distinct())
    asked = indexed.where(F.pmod("vec_id", F.lit(every)) == 0)
    n_asked = asked.count()

    # Calibration: where the true neighbours of some queries are.
    some = asked.where(by_hash < share(CALIBRATION, n_asked)).collect() or asked.limit(CALIBRATION).collect()
    if not some:
        return spark.createDataFrame([], schema)
    some_ids, some_rows = np.array([r["vec_id"] for r in some]), np.array([r["embedding"] for r in some], np.float64)
    wanted = spark.sparkContext.broadcast((some_ids, some_rows))

    def scan(parts):
        held: dict = {}
        for batch in parts:
            ids, leaf = batch.column("vec_id").to_numpy(), batch.column("leaf").to_numpy()
            mine = _matrix(batch.column("embedding"), dim)
            where = dict(zip(ids.tolist(), leaf.tolist(), strict=True))
            for queries, hits, found, scores in best(ids, mine, *wanted.value, k):
                ends = np.cumsum(hits).tolist()
                for i, a, b in zip(queries.tolist(), [0, *ends], ends, strict=False):
                    held[i] = sorted([*held.get(i, ()), *((-s, v, where[v]) for s, v in zip(scores[a:b].tolist(), found[a:b].tolist(), strict=True))])[:k]
        out = [(i, v, -s, leaf) for i, rest in held.items() for s, v, leaf in rest]
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(("query", "vec_id", "score", "leaf"), x, strict=True)) for x in out], pa.schema([("query", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64()), ("leaf", pa.int32())]))

    from pyspark.sql import Window

    truth = indexed.mapInArrow(scan, "query int, vec_id long, score double, leaf int")
    truth = truth.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k).select("query", "leaf").collect()
    visits, spread = calibrated(tree, some_rows, [(r["query"], r["leaf"]) for r in truth], recall)

    def visited(parts):
        tree = shared.get()
        counts = np.zeros(tree.leaves, np.int64)
        for batch in parts:
            for q in _matrix(batch.column("embedding"), dim):
                counts[tree.visit(q, visits, spread)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts), dtype=np.int32)), pa.array(counts)], ["leaf", "n"])

    def route(parts):
        tree = shared.get()
        for batch in parts:
            queries = _matrix(batch.column("embedding"), dim)
            leaves = [tree.visit(q, visits, spread) for q in queries]
            at = np.repeat(np.arange(len(queries)), [len(x) for x in leaves])
            yield pa.RecordBatch.from_arrays([pa.array([x for y in leaves for x in y], pa.int32()), batch.column("vec_id").take(pa.array(at)), batch.column("embedding").take(pa.array(at))], ["leaf", "vec_id", "embedding"])

    # Cells of a leaf: its blocks of rows by the blocks of its queries; the table is a row a leaf, so the sample bounds it.
    blocks = indexed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    queries = asked.select("embedding").mapInArrow(visited, "leaf int, n long").groupBy("leaf").agg(F.ceil(F.sum("n") / QUERIES).cast("int").alias("asks"))
    sizes = F.broadcast(save(blocks.join(queries, "leaf").select("leaf", "blocks", F.greatest("asks", F.lit(1)).alias("asks"))))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("vec_id", "embedding"), F.col(n)).cast("int")
    cell = ("leaf", "vec_id", "embedding", "block", "ask")
    stored = indexed.join(sizes, "leaf").withColumn("block", mine("blocks")).withColumn("ask", each("asks")).select(*cell)
    routed = asked.select("vec_id", "embedding").mapInArrow(route, f"leaf int, vec_id long, embedding {kind}")
    routed = routed.join(sizes, "leaf").withColumn("block", each("blocks")).withColumn("ask", mine("asks")).select(*cell)

    def search(own, queries):
        if not own.num_rows or not queries.num_rows:
            return hits.empty_table()
        own, queries = own.combine_chunks(), queries.combine_chunks()
        names = queries["vec_id"].to_numpy()
        found = list(best(own["vec_id"].to_numpy(), _matrix(own["embedding"].combine_chunks(), dim), names, _matrix(queries["embedding"].combine_chunks(), dim), k))
        at, n, ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        return pa.table([pa.array(names[at]), pa.ListArray.from_arrays(ends, pa.array(ids)), pa.ListArray.from_arrays(ends, pa.array(scores))], schema=hits)

    def merge(table):
        table = table.combine_chunks()
        lists = {c: table[c].combine_chunks() for c in ("vec_ids", "scores")}
        query = np.repeat(table["query_id"].to_numpy(), pc.list_value_length(lists["vec_ids"]).to_numpy())
        ids, scores = (x.flatten().to_numpy() for x in lists.values())
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        new = np.ones(len(query), bool)
        new[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
        query, ids, scores = query[new], ids[new], scores[new]
        starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query)))) + 1
        keep = rank <= k
        return pa.table({"query_id": query[keep], "rank": rank[keep].astype(np.int32), "vec_id": ids[keep], "score": scores[keep]})

    hits = pa.schema([("query_id", pa.int64()), ("vec_ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])
    hit = stored.groupBy("leaf", "block", "ask").cogroup(routed.groupBy("leaf", "block", "ask")).applyInArrow(search, "query_id long, vec_ids array<long>, scores array<double>")
    buckets = max(1, math.ceil(n_asked * visits * k / 1_000_000))
    return hit.withColumn("bucket", F.pmod(F.xxhash64("query_id"), F.lit(buckets))).groupBy("bucket").applyInArrow(merge, schema)


def calibrated(tree: Tree, queries: np.ndarray, truth: list[tuple[int, int]], recall: float) -> tuple[int, float]:
    """(visits, share of the spread): the fewest leaves, widening by an eighth or one, whose visit finds that share of the true (query, leaf) pairs."""
    best = (tree.leaves + 1, 0.0)
    for share in SPREADS if tree.leaves > 1 else SPREADS[:1]:
        places = [{leaf: i for i, leaf in enumerate(tree.visit(q, tree.leaves, share))} for q in queries]
        needed = np.sort([places[q][leaf] + 1 for q, leaf in truth])
        visits = 1
        while visits < tree.leaves and np.searchsorted(needed, visits, side="right") < recall * len(needed):
            visits = min(tree.leaves, max(visits + 1, visits * 9 // 8))
        best = min(best, (visits, share))
    return best
