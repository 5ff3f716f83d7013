"""Document fingerprints: the k smallest shingle hashes (a bottom-k sketch).

Sketches of parts merge into the sketch of the whole.  Two sketches tell the
resemblance (Jaccard similarity) and containment of the shingle sets, and one
tells their number.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.text import Hasher, batches

K, BYTES, SHINGLE = 256, 6, 5
SPACE = 1 << (8 * BYTES)


def sketch(shingles: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest of sorted distinct 64-bit hashes, as their first 48 bits."""
    return np.unique(shingles[: k + 8] >> np.uint64(64 - 8 * BYTES))[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of both sets."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """How many shingles the set has: exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / SPACE)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the union's sketch that is in both; 1 for two empty sets, exact where the union has fewer than k."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum()) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of a's set that is in b's; 1 if a is empty."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    return min(1.0, j / (1 + j) * (distinct(a, k) + distinct(b, k)) / distinct(a, k))


def to_string(a: np.ndarray) -> str:
    raw = np.frombuffer(a.astype(">u8").tobytes(), np.uint8).reshape(-1, 8)[:, 8 - BYTES :]
    return base64.b64encode(raw.tobytes()).decode()


def from_string(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BYTES)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, 8 - BYTES :] = raw
    return np.frombuffer(full.tobytes(), ">u8").astype(np.uint64)


def sketches(texts: list[str], hasher: Hasher, k: int = K) -> list[np.ndarray]:
    words, counts = hasher.words([t.encode("utf-8", "surrogatepass") for t in texts])
    return [sketch(s, k) for s in hasher.shingles(words, counts, SHINGLE)]


def fingerprint(docs: DataFrame, k: int = K) -> DataFrame:
    """Adds fingerprint (string) and n_distinct (double, the estimated shingle count) to docs(text, ...).

    Shingles are runs of five words; a shorter text has its whole sequence as
    its one shingle; an empty or null text has the empty fingerprint "".
    Columns of these names that docs has already are replaced.
    """
    import pyarrow as pa

    rows = docs.drop("fingerprint", "n_distinct")

    def run(parts):
        hasher = Hasher()
        for batch in batches(parts, 1000):
            found = sketches([x or "" for x in batch.column("text").to_pylist()], hasher, k)
            more = [pa.array(map(to_string, found), pa.string()), pa.array([distinct(s, k) for s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "fingerprint", "n_distinct"])

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("fingerprint", T.StringType()), T.StructField("n_distinct", T.DoubleType())]))


EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edited(docs: DataFrame, k: int = K, rows_per_bucket: int = 1000, most_buckets: int = 1 << 14) -> DataFrame:
    """Fingerprints of each text and of its edit, by the text of the next row in descending doc_id.

    The edit replaces the last floor(n/2) of a text's n code points by the
    first as many of the next text (all, if it has fewer); after the last row
    comes the first.  Rows are sorted in buckets of doc_id, each bucket by
    itself; the first row of a bucket is also sent to the bucket before it.
    Null doc_ids come last, equal ones in the order of their text hash;
    null text is empty; a single row is its own next; an empty table gives no
    rows.
    """
    import pyarrow as pa

    rows = docs.selectExpr("cast(doc_id as bigint) AS doc_id", "coalesce(cast(text as string), '') AS text")
    n, ids = rows.agg(F.count("*"), F.count("doc_id")).first()
    buckets = max(1, min(most_buckets, math.ceil(n / rows_per_bucket)))
    bounds = []
    if ids and buckets > 1:
        bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0]))
    # A binary search: the number of bounds below doc_id; the last bucket in the order has the null ids.
    table, steps = F.array(*map(F.lit, bounds)).cast("array<bigint>"), [1 << i for i in reversed(range(max(1, len(bounds).bit_length())))]
    below = F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: F.when((low + step <= len(bounds)) & (F.get(table, low + step - 1) < F.col("doc_id")), low + step).otherwise(low)
    )
    # Those without doc_id come last in the order of their text hash, in buckets by its first bits.
    none = 0 if n - ids <= rows_per_bucket else min(14, math.ceil(math.log2((n - ids) / rows_per_bucket)))
    by_hash = F.shiftright("h", 64 - none) + F.lit(1 << (none - 1)) if none else F.lit(0)
    bucket = F.when(F.col("doc_id").isNull(), len(bounds) + 1 + by_hash).otherwise(len(bounds) - below)
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("bucket", bucket.cast("int"))
    order = F.struct(F.bitwise_not("doc_id").alias("down"), "h")
    firsts = sorted((r["bucket"], r["f"]["down"], r["f"]["h"]) for r in rows.groupBy("bucket").agg(F.min(order).alias("f")).collect())  # two a bucket at most
    sent = [(None if d is None else ~d, h, firsts[i - 1][0]) for i, (_, d, h) in enumerate(firsts)]
    sent = docs.sparkSession.createDataFrame(sent, "first_id long, first_h long, to int")
    rows = rows.join(F.broadcast(sent), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")), "left")
    here, there = F.struct("bucket", F.lit(False).alias("next")), F.struct(F.col("to").alias("bucket"), F.lit(True).alias("next"))
    rows = rows.select("doc_id", "text", "h", F.explode(F.when(F.col("to").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("b")).select("doc_id", "text", "h", "b.*")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "next", F.col("doc_id").desc_nulls_last(), "h")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(parts):
        hasher, held = Hasher(), []  # held: the row whose next is still to come
        for batch in batches(parts, 500, 1 << 21):
            held += zip(*(batch.column(c).to_pylist() for c in ("bucket", "next", "doc_id", "text")), strict=True)
            own = sketches([x[3] for x in held], hasher, k)
            at = [i for i in range(len(held) - 1) if not held[i][1]]  # a bucket's rows end with one row or more that are `next`
            edits = [held[i][3][: len(held[i][3]) - len(held[i][3]) // 2] + held[i + 1][3][: len(held[i][3]) // 2] for i in at]
            edited = sketches(edits, hasher, k)
            found = [
                [held[i][2] for i in at],
                [len(held[i][3]) for i in at],
                [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits],
                [to_string(own[i]) for i in at],
                [to_string(e) for e in edited],
                [resemblance(own[i], e, k) for i, e in zip(at, edited, strict=True)],
                [resemblance(own[i], own[i + 1], k) for i in at],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(found, schema, strict=True)], schema=schema)
            del held[:-1]

    return rows.mapInArrow(run, EDITS)
