"""Target-distribution importance resampling: documents drawn by how likely a target corpus makes their n-grams.

Words and pairs of words are hashed to buckets.  A bucket's gain is the log
ratio of its shares in the target and in the corpus; a document's weight is
the mean gain of its features, looked up in one array of all gains.  Weight
plus Gumbel noise of the document's id is an integer score, and the highest
scores are a draw without replacement.  Ranks come from the exact histogram of
the scores, without a sort of all documents: the counts above a score are its
rank offset, they tell the cutoff score, and only documents from the cutoff
on are numbered, by doc_id within their score.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.llm.tables import Saved
from glimmer.llm.text import batches, encoded

#: Lower-cases A-Z and makes every ASCII byte that is no letter or digit a space; bytes of other characters stay.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Scores that share a first step of the suffix sums.
_STEP = 256


def feature_hashes(text: bytes) -> tuple[int, np.ndarray]:
    """Number of words, and the CRC-32 of each word and of each two neighbours joined by a space."""
    words = text.translate(_WORDS).split()
    if not words:
        return 0, np.zeros(0, np.uint32)
    one = list(map(crc32, words))
    # A CRC goes on from that of the first word over " second".
    two = map(crc32, [b" " + w for w in words[1:]], one)
    return len(words), np.fromiter((*one, *two), np.uint32, 2 * len(words) - 1)


def bucket_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): features of all texts of docs(text, ...) by bucket; buckets without any aren't returned."""
    import pyarrow as pa

    def count(parts):
        total = np.zeros(buckets, np.int64)
        for batch in batches(parts):
            for text in encoded(batch.column("text")):
                total += np.bincount(feature_hashes(text)[1] % buckets, minlength=buckets) if text else 0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of all buckets, from the (bucket, n) of the corpus and of the target; a row a bucket."""
    total = lambda df, name: df.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias(name))
    rows = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    rows = rows.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    rows = rows.join(F.broadcast(total(corpus, "all_s"))).join(F.broadcast(total(target, "all_t")))  # a row each
    odds = (F.col("t") + 1.0) * (F.col("all_s") + float(buckets)) / ((F.col("s") + 1.0) * (F.col("all_t") + float(buckets)))
    return rows.select("bucket", F.floor(1000 * F.log(odds)).alias("gain"))


def noise(doc_id, seed: int):
    """Gumbel noise in thousandths from the first 32 bits of a SHA-256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, values: np.ndarray, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and tie (a hash of the text) of each row, with `values` the gain of each bucket."""
    import pyarrow as pa

    def weigh(parts):
        for batch in batches(parts):
            words, weights = [], []
            for text in encoded(batch.column("text")):
                n, hashes = feature_hashes(text)
                words.append(n)
                weights.append(int(values[hashes % len(values)].sum()) // len(hashes) if n else 0)
            n = np.array(words, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(n), pa.array(np.maximum(2 * n - 1, 0)), pa.array(weights, pa.int64())], ["doc_id", "tie", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    rows = rows.mapInArrow(weigh, "doc_id long, tie long, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7, rows_per_part: int = 1 << 31) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of docs(doc_id, text, ...), drawn towards target(text, ...).

    Of the rows with at least least_words words, percent of a hundred (rounded
    down) are drawn: those with the highest scores, ties to the smaller
    doc_id.  rank counts from 1 in that order and is null for rows not drawn.

    Null text has no words, weight 0 and is not drawn; a null doc_id has noise
    of its own and comes after others of its score; rows that repeat a
    doc_id are documents of their own (equal ones are in turn, whichever is
    first); an empty table gives no rows, an empty target moves every gain
    alike; further columns aren't read.

    The gains are one array of `buckets` numbers.  Scores are whole numbers
    between about -50,000 and 70,000 whatever the input (a gain is the
    logarithm of a ratio of counts, the noise comes from 32 bits), so the
    histogram is small.  The documents of one score are cut by
    ranges of doc_id, one more for every rows_per_part documents, so that no
    task numbers more than some millions.
    """
    save = Saved(docs.sparkSession)
    corpus, wanted = (save(bucket_counts(df, buckets)) for df in (docs, target))
    counted = save(gains(corpus, wanted, buckets))
    values = np.zeros(buckets, np.int64)
    for r in counted.collect():  # one row a bucket
        values[r["bucket"]] = r["gain"]
    rows = save(scored(docs, values, seed))
    able = rows.where(F.col("n_words") >= least_words)
    n = able.count()
    parts = max(1, math.ceil(n / rows_per_part))
    cuts = able.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    part = lambda: sum((F.coalesce((F.col("doc_id") > int(c)).cast("int"), F.lit(1)) for c in sorted(set(cuts))), F.lit(0))

    # Rows above each (score, part): first those of higher steps, then those above within a step.
    counts = able.groupBy("score", part().alias("part")).agg(F.count("*").alias("n")).withColumn("step", F.floor(F.col("score") / _STEP))
    counts = save(counts)
    by_step = counts.groupBy("step").agg(F.sum("n").alias("all"))
    by_step = by_step.select("step", (F.sum("all").over(Window.orderBy(F.desc("step"))) - F.col("all")).alias("above"))  # a few hundred rows
    within = F.sum("n").over(Window.partitionBy("step").orderBy(F.desc("score"), "part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    offsets = save(counts.withColumn("within", within).join(by_step, "step").select("score", "part", (F.col("above") + F.col("within")).alias("offset")))
    drawn = percent * n // 100
    cutoff = offsets.where(F.col("offset") < drawn).agg(F.min("score")).first()[0]

    columns, none = ("doc_id", "n_features", "weight", "score"), F.lit(None).cast("long").alias("rank")
    if cutoff is None:
        return rows.select(*columns, none)
    surviving = (F.col("n_words") >= least_words) & (F.col("score") >= cutoff)
    number = F.row_number().over(Window.partitionBy("score", "part").orderBy(F.col("doc_id").asc_nulls_last(), "tie"))
    placed = rows.where(surviving).withColumn("part", part()).withColumn("number", number).join(offsets, ["score", "part"])
    place = F.col("offset") + F.col("number")
    placed = placed.select(*columns, F.when(place <= drawn, place).alias("rank"))
    return placed.unionByName(rows.where(~surviving).select(*columns, none))
