import bisect
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.llm import fingerprints, mixing, sharding
from glimmer.llm.text import Hasher


def level_targets(sizes, most=3):
    """Targets by repeated sharing: what exceeds a source's bound is shared again by weight."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full, out = sum(sizes.values()), {}, {}
    while True:
        rest = [s for s in names if s not in full]
        out = {s: (total - sum(full.values())) * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if out[s] > most * sizes[s]]
        if not over:
            return out | full
        full |= {s: float(most * sizes[s]) for s in over}


def documents(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 40) * (1 + 9 * (i % 7 == 0)))), rng.choice(["a", "a", "a", "a", "b", "c", "é", None])) for i in range(n)]
    rows += [(n, None, "a"), (None, "x y", "b"), (3, "x", "a"), (3, "x", "a"), (n + 1, "word " * 50000, "c")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'z' AS size", "0 AS target", "7 AS h")


def test_mix_against_plain_targets(spark):
    rows, docs = documents(spark)
    got = mixing.plan_mix(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want = level_targets(sizes)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == sum(d["words"] for d in r["draws"])
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    plain = lambda found: sorted(str((r["doc_id"], r["size"], r["taken"], r["draws"])) for r in found)
    assert plain(mixing.plan_mix(docs.repartition(5)).collect()) == plain(got)


def test_blocks_are_drawn_by_exact_quotas(spark):
    """Each shard has exactly the blocks of each source that the tree's leaf says, no block is in two, and they are permuted."""
    sizes = {"a": 400, "b": 37, "c": 0, None: 90}
    planned = spark.createDataFrame([(i + 1, n) for i, n in enumerate(sizes.values())], "rank int, blocks long")
    quotas = spark.createDataFrame([(list(sizes.values()),)], "quotas array<long>")
    leaves = {r["leaf"]: r["quotas"] for r in mixing.split_quotas(quotas, 3, 1).collect()}
    drawn = {r["rank"]: r["shards"] for r in mixing.block_shards(planned, 3, 1).collect()}
    assert set(drawn) == {1, 2, 4}
    for rank, n in ((1, 400), (2, 37), (4, 90)):
        assert Counter(drawn[rank]) == Counter({leaf: q[rank - 1] for leaf, q in leaves.items() if q[rank - 1]}) and len(drawn[rank]) == n
    changes = sum(a != b for a, b in zip(drawn[1], drawn[1][1:], strict=False))
    assert changes > 250  # contiguous ranges would have 7


def test_shards_get_exactly_their_quotas(spark):
    """Cut at block edges, a shard's words of a source are those of its blocks, each of which is covered once; the leaves say how many."""
    _, docs = documents(spark, 3000, 4)
    levels, most = 3, 400
    docs = docs.where(f"doc_id < {most} OR doc_id = 3001")
    plan = mixing.plan_mix(docs, levels).select("doc_id", "source", "size", "target", "draws").collect()
    quota = {r["source"]: math.floor(r["target"] + 0.5) for r in plan}
    names = sorted(s for s in quota if s is not None) + [None]
    width = max(mixing.LEAST_BLOCK, math.ceil(sum(quota.values()) / mixing.MOST_BLOCKS))
    blocks = [math.ceil(quota[s] / width) for s in names]
    leaves = mixing.split_quotas(spark.createDataFrame([(blocks,)], "quotas array<long>"), levels, 1).collect()
    words, covered, of = Counter(), Counter(), {}
    for r in plan:
        for copy in range(3):
            pieces = sorted((d["first"], d["words"]) for d in r["draws"] if d["copy"] == copy)
            assert all(f + n == g for (f, n), (g, _) in zip(pieces, pieces[1:], strict=False)) and (not pieces or pieces[0][0] == 0)
        for d in r["draws"]:
            assert d["words"] > 0 and of.setdefault((r["source"], d["block"]), d["shard"]) == d["shard"]
            words[r["source"], d["shard"]] += d["words"]
            covered[r["source"], d["block"]] += d["words"]
    for i, s in enumerate(names):
        assert [covered[s, b] for b in range(blocks[i])] == [min(width, quota[s] - b * width) for b in range(blocks[i])]
        last = quota[s] - (blocks[i] - 1) * width
        for leaf in leaves:
            n, has_last = leaf["quotas"][i], of[s, blocks[i] - 1] == leaf["leaf"]
            assert words[s, leaf["leaf"]] == (n - 1) * width + last if has_last else words[s, leaf["leaf"]] == n * width
    assert len({d["block"] for r in plan if r["size"] == 50000 for d in r["draws"]}) > 100
    mixed = Counter()
    for r in mixing.mix(docs, levels, cut=True).select("source", "mix_shard", "text").collect():
        mixed[r["source"], r["mix_shard"]] += len((r["text"] or "").split())
    assert +mixed == +words


def test_a_cut_copy_is_its_words(spark):
    """The pieces of a document's copy, put in order, are its words."""
    docs = spark.createDataFrame([(i, " ".join(f"{i}_{k}" for k in range(150 * (i + 1))), "a" if i < 3 else "b") for i in range(5)], "doc_id long, text string, source string")
    plan = {r["doc_id"]: r for r in mixing.plan_mix(docs).collect()}
    got = Counter(w for r in mixing.mix(docs, cut=True).collect() for w in r["text"].split())
    for i, r in plan.items():
        want = Counter(k for d in r["draws"] for k in range(d["first"], d["first"] + d["words"]))
        assert {k: got[f"{i}_{k}"] for k in want} == want and sum(want.values()) == r["taken"]


def test_documents_go_where_their_blocks_go(spark):
    """Left whole, copies that begin in one block are in one shard, and shards' words are near their blocks'."""
    _, docs = documents(spark, 3000, 4)
    docs = docs.where("doc_id < 3000")
    draws = mixing.plan_mix(docs, cut=False).select("source", F.explode("draws").alias("d")).select("source", "d.*").collect()
    of = {}
    for d in draws:
        assert of.setdefault((d["source"], d["block"]), d["shard"]) == d["shard"]
    words = Counter()
    for d in draws:
        words[d["shard"]] += d["words"]
    assert len(words) == 16 and max(words.values()) < 1.6 * min(words.values())
    assert {d["shard"] for d in draws if d["source"] == "b"} == set(range(16))


def test_repeated_rows_take_what_the_plan_says(spark):
    """Equal rows, of which one is cut: each has its own draws."""
    docs = spark.createDataFrame([(1, "u v w x y", "a")] * 7 + [(2, "r s t", "b"), (3, "k l m n", "b")], "doc_id long, text string, source string")
    plan = mixing.plan_mix(docs).collect()
    got = Counter()
    for r in mixing.mix(docs.withColumn("mix_shard", F.lit("z"))).collect():
        got[r["doc_id"]] += len(r["text"].split())
    want = Counter()
    for r in plan:
        want[r["doc_id"]] += r["taken"]
    assert got == want and len({r["taken"] for r in plan if r["doc_id"] == 1}) > 1


def test_mixed_documents(spark):
    rows, docs = documents(spark, 80, 2)
    mixed = mixing.mix(docs.select("doc_id", "text", "source")).collect()
    words = sum(len((r["text"] or "").split()) for r in mixed)
    plan = mixing.plan_mix(docs).agg(F.sum("taken")).first()[0]
    assert words == plan
    assert len({r["mix_shard"] for r in mixed}) > 8


def test_split_sums_and_distribution(spark):
    quotas = spark.sql("SELECT array(1000L, 10L, 0L, 333L) AS quotas")
    leaves = mixing.split_quotas(quotas, 3, 1).collect()
    assert len(leaves) == 8 and np.sum([r["quotas"] for r in leaves], axis=0).tolist() == [1000, 10, 0, 333]
    assert {sum(r["quotas"]) for r in leaves} <= {167, 168}
    u = (F.pmod(F.xxhash64("id"), F.lit(1 << 52)) / float(1 << 52)).alias("u")
    draws = spark.range(4000).select(u).select(mixing.hypergeometric(F.lit(50), F.lit(20), F.lit(10), F.col("u")).alias("k")).collect()
    ks = np.array([r["k"] for r in draws])
    assert abs(ks.mean() - 4) < 0.1 and abs(ks.var() - 10 * 0.4 * 0.6 * 40 / 49) < 0.15


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.plan_mix(docs).collect() == [] and mixing.mix(docs).collect() == []
    empty = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.plan_mix(empty).collect()] == [0, 0]


def smallest_capacity(sizes, shards):
    low, high = max(sizes, default=0), sum(sizes)
    fits = lambda c: _fill(sizes, c) <= shards
    return low + bisect.bisect_left(range(low, high + 1), True, key=fits)


def _fill(sizes, capacity):
    used, left = 1, capacity
    for s in sizes:
        if s > left:
            used, left = used + 1, capacity
        left -= s
    return used


def test_sharding_is_the_smallest_possible(spark):
    rng = random.Random(4)
    for shards, n in ((5, 200), (24, 60), (3, 2)):
        rows = [(i, rng.choice(["same", "two words"]) if rng.random() < 0.3 else "t" * rng.randrange(0, 400) + str(i), "x") for i in range(n)] + [(None, None, "x"), (0, "é", "x")]
        docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
        got = sharding.shard(docs, shards).collect()
        assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"}
        size, place, slots = Counter(), {}, {}
        for r in got:
            size[r["shard"]] += r["size"]
            slots.setdefault(r["shard"], []).append(r["slot"])
            place.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(p) == 1 for p in place.values())
        assert all(0 <= s < shards for s in slots)
        order = spark.createDataFrame([(t,) for t in {t or "" for _, t, _ in rows}], "t string").select("t", F.xxhash64("t").alias("h")).orderBy("h").collect()
        count = Counter((t or "") for _, t, _ in rows)
        groups = [(len(r["t"].encode()) + 8) * count[r["t"]] for r in order]
        assert max(size.values()) == smallest_capacity(groups, shards)
        assert {r["text_crc32"] for r in got} == {zlib.crc32((t or "").encode()) for _, t, _ in rows}
    assert sharding.shard(docs.where("doc_id = 99"), 4).collect() == []


def test_edits_against_plain_strings(spark):
    rng = random.Random(5)
    rows = [(i * 3, " ".join(rng.choice(["aé", "bb", "日本", "d"]) + str(rng.randrange(30)) for _ in range(rng.randrange(0, 60)))) for i in range(120)] + [(7, None), (8, ""), (10, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS bucket", "2 AS next")
    ordered = sorted(rows, reverse=True, key=lambda r: r[0])
    for per_bucket in (1000, 7):
        got = {r["doc_id"]: r for r in fingerprints.compare_edited(docs, rows_per_bucket=per_bucket).collect()}
        assert len(got) == len(rows)
        for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
            text, after = text or "", after or ""
            edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
            r = got[i]
            assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            assert r["near_edited"] == pytest.approx(jaccard(text, edited)) and r["near_next"] == pytest.approx(jaccard(text, after))
    assert fingerprints.compare_edited(docs.where("doc_id = 98")).collect() == []
    assert fingerprints.compare_edited(docs.where("doc_id = 10")).first()["edited_sha256"] == hashlib.sha256(b"x").hexdigest()


def test_edits_of_rows_without_doc_id(spark):
    """They follow the others by their text hash, in one bucket or in many; repeated rows follow each other; long texts are whole."""
    rng = random.Random(8)
    rows = [(i, f"t{i} " * rng.randrange(0, 400)) for i in range(20)] + [(None, " ".join(f"n{rng.randrange(50)}" for _ in range(rng.randrange(1, 40)))) for _ in range(150)] + [(None, None)] * 3 + [(5, "z " * 400_000)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("x"))
    hashes = {r["text"]: r["h"] for r in docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1] or ""]))
    want = Counter()
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        text, after = text or "", after or ""
        want[(i, len(text), hashlib.sha256((text[: len(text) - len(text) // 2] + after[: len(text) // 2]).encode()).hexdigest())] += 1
    for per_bucket in (1000, 6):
        got = fingerprints.compare_edited(docs, rows_per_bucket=per_bucket).select("doc_id", "n_chars", "edited_sha256").collect()
        assert Counter(map(tuple, got)) == want


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sketches_merge_and_estimate():
    hasher, rng = Hasher(), random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    a, b = fingerprints.sketches([" ".join(words[:4000]), " ".join(words[2000:])], hasher)
    whole = fingerprints.sketches([" ".join(words[:4000])], hasher)[0]
    assert (a == whole).all() and (fingerprints.from_string(fingerprints.to_string(a)) == a).all()
    assert abs(fingerprints.resemblance(a, b) - 1996 / 5996) < 0.12
    assert abs(fingerprints.containment(a, b) - 0.5) < 0.15
    assert abs(fingerprints.distinct(fingerprints.merge(a, b)) - 6000) < 1200
