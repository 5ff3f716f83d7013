"""Mixing sources to target weights, in DataFrame functions only.

Each source is a stream of its documents in a fixed pseudo-random order,
repeated as often as its target asks.  The streams are cut into blocks of
equally many words; the exact numbers of blocks of all sources are split among
the output shards by a binary tree of multivariate hypergeometric draws, and
each shard takes its numbers of blocks from the streams, none twice, and puts
its documents into an order of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.llm.tables import Saved

WORD = r"[^\x20\x09-\x0D]+"
#: No more blocks than this in the mix, and no shorter ones: both bound the splitting tree whatever the data's size.
MOST_BLOCKS, LEAST_BLOCK = 1 << 15, 64


def order_key(*parts: Column) -> Column:
    """60 bits of an MD5: a pseudo-random order that any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, most_repeats: int = 3) -> DataFrame:
    """Adds weight and target to sources(source, source_size): one row a source, null among them.

    Weights are 1, 2, 3, 1, ... by code point order of the source, null last.
    Targets share the sum of all sizes by weight; what exceeds most_repeats
    times a source's size is shared again by weight until none is above.  That
    ends where every target is the smaller of its bound and weight x level, so
    the level is found directly: sources are sorted by bound/weight, and those
    before the first that the level doesn't fill are at their bounds.  The
    windows hold a row a source, not documents.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("long")).withColumn("bound", F.col("source_size") * most_repeats)
    by_fill = Window.orderBy(F.col("bound") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, 0)
    total, weights = F.sum("source_size").over(Window.partitionBy()), F.sum("weight").over(Window.partitionBy())
    level = (total - F.sum("bound").over(by_fill) + F.col("bound")).cast("double") / (weights - F.sum("weight").over(by_fill) + F.col("weight"))
    filled = ranked.withColumn("level", level).withColumn("full", F.col("bound") / F.col("weight") < F.col("level"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("bound") / F.col("weight"), "rank", "level"))).over(Window.partitionBy())["level"]
    return filled.withColumn("target", F.when(F.col("full"), F.col("bound").cast("double")).otherwise(F.col("weight") * level)).select("source", "rank", "source_size", "weight", "target")


def _log_gamma(x: Column) -> Column:
    """ln gamma(x) for x >= 1, to about 1e-9: Stirling's series at x + 8."""
    y, below = x + 8, x
    for i in range(1, 8):
        below = below * (x + i)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) - F.log(below)


def _log_choose(n: Column, k: Column) -> Column:
    return _log_gamma(n + 1.0) - _log_gamma(k + 1.0) - _log_gamma(n - k + 1.0)


def hypergeometric(all_blocks: Column, of_kind: Column, drawn: Column, u: Column) -> Column:
    """How many of `of_kind` blocks are among `drawn` of `all_blocks`: the inverse of the distribution at u in [0, 1).

    Sums over 12 standard deviations (and 12) around the mean; what lies beyond has no weight in doubles.
    """
    n, kind, take = (c.cast("double") for c in (all_blocks, of_kind, drawn))
    mean = take * kind / F.greatest(n, F.lit(1.0))
    wide = 12 * F.sqrt(F.greatest(mean * (1 - kind / F.greatest(n, F.lit(1.0))), F.lit(0.0))) + 12
    low = F.greatest(F.lit(0.0), take - (n - kind), F.floor(mean - wide)).cast("long")
    high = F.least(kind, take, F.ceil(mean + wide)).cast("long")
    chance = lambda k: F.exp(_log_choose(kind, k.cast("double")) + _log_choose(n - kind, take - k.cast("double")) - _log_choose(n, take))
    start = F.struct(F.lit(0.0).alias("sum"), low.alias("k"))
    step = lambda s, k: F.struct(
        (s["sum"] + chance(k)).alias("sum"), F.when(s["sum"] <= u, k).otherwise(s["k"]).alias("k")
    )
    return F.when(high <= low, low).otherwise(F.aggregate(F.sequence(low, F.greatest(low, high)), start, step)["k"])


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(leaf, quotas) for the 2**levels shards, from one row with quotas array<long>: one entry a source.

    A node gives half of its blocks to its left child: source by source, a
    hypergeometric number of those still to be given.  The halves of a node sum
    to the node, so every source's leaves sum to its quota exactly.
    """
    tree = quotas.select(F.lit(1).cast("long").alias("node"), "quotas")
    for _ in range(levels):
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x)
        tree = tree.withColumn("total", total)
        start = F.struct(F.floor(F.col("total") / 2).cast("long").alias("take"), F.col("total").alias("left"), F.array().cast("array<long>").alias("out"))

        def step(s, q):
            u = F.pmod(F.xxhash64(F.lit(seed), F.col("node"), F.size(s["out"])), F.lit(1 << 52)) / float(1 << 52)
            k = hypergeometric(s["left"], q, s["take"], u)
            # k is used three times: an array of one value keeps its expression from being written three times.
            return F.transform(F.array(k), lambda x: F.struct((s["take"] - x).alias("take"), (s["left"] - q).alias("left"), F.concat(s["out"], F.array(x)).alias("out")))[0]

        tree = tree.withColumn("l", F.aggregate("quotas", start, step)["out"])
        right = F.zip_with("quotas", "l", lambda q, x: q - x)
        tree = tree.select(F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("l").alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quotas")))).alias("x")).select("x.*")
    return tree.select((F.col("node") - (1 << levels)).cast("int").alias("leaf"), "quotas")


def block_shards(planned: DataFrame, levels: int, seed: int) -> DataFrame:
    """(rank, shards) of planned(rank, blocks): the shard of each of a source's blocks, in the order of the blocks.

    The tree's leaves say how many of a source's blocks each shard gets; the
    blocks are put into a pseudo-random order, and every shard draws the next
    so many of them.  All blocks are MOST_BLOCKS and one more for each source
    at most, so this is a small table whatever the size of the documents.
    """
    one = planned.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "blocks"))), lambda x: x["blocks"]).alias("quotas"))
    shares = split_quotas(one, levels, seed).select("leaf", F.posexplode("quotas").alias("i", "share"))
    ends = shares.withColumn("end", F.sum("share").over(Window.partitionBy("i").orderBy("leaf")))
    ends = ends.groupBy((F.col("i") + 1).alias("rank")).agg(F.transform(F.sort_array(F.collect_list(F.struct("leaf", "end"))), lambda x: x["end"]).alias("ends"))
    blocks = planned.where("blocks > 0").select("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    drawn = F.row_number().over(Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed), "rank", "block"), "block")) - 1
    blocks = blocks.withColumn("drawn", drawn).join(ends, "rank")
    blocks = blocks.select("rank", "block", F.size(F.filter("ends", lambda e: e <= F.col("drawn"))).alias("shard"))
    return blocks.groupBy("rank").agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "shard"))), lambda x: x["shard"]).alias("shards"))


def plan_mix(docs: DataFrame, levels: int = 4, seed: int = 1, most_repeats: int = 3, rows_per_bucket: int = 20_000, carry: bool = False, cut: bool = True) -> DataFrame:
    """What the mix takes of each row of docs(doc_id, text, source, ...).

    Returns doc_id, source, size (words), source_size, target, taken (words:
    the sum of the draws') and draws: array of (copy, first, words, block,
    shard), the `words` words after the first `first` of a copy, which lie in a
    block of the source's stream and go to the shard that drew this block; with
    carry also docs, the row itself as a struct.  There are 2**levels shards.

    Copies are cut where blocks end, so a shard's words of a source are those
    of the blocks that it drew: its quota of whole blocks, but for the source's
    last one, which ends with the target.  Without cut, a copy stays whole and
    goes to the shard of the block in which it begins; shards' words are then
    near their quotas only where blocks are longer than documents.  A document
    in which a source's target ends gives its first words.

    Null text has no words; a null source is a source; null and repeated
    doc_ids count as rows of their own (equal rows are in turn, whichever is
    first); an empty table gives no rows.  The sums per source equal
    round(target), so a document is never taken beyond most_repeats.
    Prefix sums within a source go over hash buckets of about rows_per_bucket
    rows, so a source with a third of all rows isn't one task's work; other
    windows hold a row a source or block.
    """
    save = Saved(docs.sparkSession)
    key = order_key(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed)))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), key.alias("h"), F.xxhash64("text").alias("tie"), *([F.struct(*docs.columns).alias("docs")] if carry else []))
    slim = save(rows.drop("docs"))  # texts are not written again but read once more
    rows = rows if carry else slim
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    most = sources.agg(F.max("rows")).first()[0] or 1
    bits = max(9, math.ceil(math.log2(most / rows_per_bucket)))

    # Block quotas, and which shard draws each block.
    planned = targets(sources, most_repeats).withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))
    width = F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.sum("quota").over(Window.partitionBy()) / MOST_BLOCKS)).cast("long")
    planned = save(planned.withColumn("width", width).withColumn("blocks", F.ceil(F.col("quota") / F.col("width")).cast("long")))
    shards = save(block_shards(planned, levels, seed))
    planned = planned.join(shards, "rank", "left").withColumnRenamed("source", "planned")

    # Each document's start in its source's stream: starts of buckets, then sums within a bucket.
    keys = ["known", "none", "bucket"]
    placed = [F.coalesce(F.col("source"), F.lit("")).alias("known"), F.col("source").isNull().alias("none"), F.shiftright("h", 60 - bits).alias("bucket")]
    starts = slim.select("size", *placed).groupBy(*keys).agg(F.sum("size").alias("n"))
    starts = starts.withColumn("start", F.sum("n").over(Window.partitionBy("known", "none").orderBy("bucket")) - F.col("n")).drop("n")
    within = Window.partitionBy(*keys).orderBy("h", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *placed).withColumn("at", F.sum("size").over(within) - F.col("size")).join(starts, keys)
    # A row a source, with its blocks' shards: bounded as said at block_shards.
    rows = rows.join(F.broadcast(planned), F.col("source").eqNullSafe(F.col("planned")))
    at, size, all_words = F.col("start") + F.col("at"), F.col("size"), F.col("source_size")

    def draw(copy, begin, low, high, block):
        return F.struct(copy.cast("int").alias("copy"), (low - begin).alias("first"), (high - low).alias("words"), block.cast("int").alias("block"), F.get("shards", block.cast("int")).alias("shard"))

    def draws_of(copy):
        begin, width = copy * all_words + at, F.col("width")
        end = F.least(begin + size, F.col("quota"))
        block = F.floor(begin / width)
        if not cut:
            return F.when(end > begin, F.array(draw(copy, begin, begin, end, block)))
        # All pieces of all rows are no more than copies and blocks together.
        pieces = F.sequence(block, F.floor((end - 1) / width))
        return F.when(end > begin, F.transform(pieces, lambda b: draw(copy, begin, F.greatest(begin, b * width), F.least(end, (b + 1) * width), b)))

    copies = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(most_repeats - 1).cast("long")), draws_of)
    draws = F.filter(F.flatten(F.filter(copies, lambda x: x.isNotNull())), lambda d: d["shard"].isNotNull())
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return rows.withColumn("draws", draws).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "draws", *(["docs"] if carry else []))


def mix(docs: DataFrame, levels: int = 4, seed: int = 1, cut: bool = False, **more) -> DataFrame:
    """The mixed documents: docs' columns and mix_shard, once for each copy taken, shards in turn and shuffled within.

    With cut, once for each draw, so that shards' words are exactly their
    quotas; else copies stay whole (see plan_mix).
    A copy that is taken in part has those words, joined by single spaces.
    A document without words takes no room in a mix of words and is kept once.
    Repeated rows are each taken as plan_mix says.  A column of docs named
    mix_shard is replaced.
    """
    docs = docs.drop("mix_shard")
    plan = plan_mix(docs, levels, seed, carry=True, cut=cut, **more)
    key = F.xxhash64("docs.doc_id", "docs.text", "docs.source")
    once = F.array(F.struct(F.lit(0).alias("copy"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("words"), F.lit(0).alias("block"), F.pmod(key, F.lit(1 << levels)).cast("int").alias("shard")))
    rows = plan.select("docs", "size", F.explode(F.when(F.col("size") == 0, once).otherwise(F.col("draws"))).alias("draw"))
    part = F.concat_ws(" ", F.slice(F.regexp_extract_all("docs.text", F.lit(WORD), F.lit(0)), (F.col("draw.first") + 1).cast("int"), F.col("draw.words").cast("int")))
    text = F.when(F.col("draw.words") < F.col("size"), part).otherwise(F.col("docs.text"))
    rows = rows.select("docs", text.alias("text"), F.col("draw.shard").alias("shard"), F.xxhash64(F.lit(seed), key, "draw.copy", "draw.first").alias("order"))
    # A shard's documents are dealt by the first bits of their order to as many tasks as a shuffle has.
    tasks = max(1 << levels, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("part", F.shiftrightunsigned("order", 64 - max(1, (tasks >> levels).bit_length())))
    rows = rows.repartition(tasks, "shard", "part").sortWithinPartitions("shard", "part", "order")
    return rows.select(*(F.col("text") if c == "text" else F.col("docs")[c].alias(c) for c in docs.columns), F.col("shard").alias("mix_shard"))
