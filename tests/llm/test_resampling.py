import hashlib
import math
import os
import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import pytest

from glimmer.llm import registry, resampling

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def brute(rows, target, buckets=10_000, percent=25, least=20, seed=7):
    """(doc_id, n_features, weight, score, rank) by plain counts and one sort of all rows."""
    bucket = lambda f: crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in features(text)[1]) for texts in ([r[1] for r in rows], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    out = []
    for i, text in rows:
        n, all_of = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in all_of) // len(all_of) if all_of else 0
        out.append([i, len(all_of), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def result(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_query_against_brute_force_and_sql(spark):
    got = result(registry.op13_resampling(spark, SF))
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got == brute(rows, [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert got == sorted(c.sql(f"SELECT doc_id, n_features, weight, score, rank FROM ({registry.OP13_SQL})").fetchall(), key=str)


@pytest.mark.parametrize("rows_per_part", [1 << 31, 40])
def test_draw_is_the_best_by_one_sort(spark, rows_per_part):
    """Ranges of doc_id within a score, many ties (few buckets, few words), repeated ids, and clashing columns change nothing."""
    rng = random.Random(4)
    rows = [(i // 2 * 3 - 200, " ".join(rng.choice(("Ab", "cd", "é1")) for _ in range(rng.choice((3, 20, 25))))) for i in range(300)]
    rows += [(1000 + i, "same text " * 12) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS part", "'x' AS tie", "3 AS weight", "4 AS step")
    target = spark.createDataFrame([("Ab! ab, é1 " * 9, 1)], "text string, n int")
    got = result(resampling.resample(docs, target, buckets=7, rows_per_part=rows_per_part))
    want = brute(rows, ["Ab! ab, é1 " * 9], buckets=7)
    assert sum(r[4] is not None for r in want) > 60
    plain = lambda found: sorted((r[0], r[2], r[3]) for r in found)
    assert plain(got) == plain(want) and sorted(r[4] for r in got if r[4]) == sorted(r[4] for r in want if r[4])
    single = {r[0] for r in want if r[0] >= 1000}
    assert [r for r in got if r[0] in single] == [r for r in want if r[0] in single]


def test_edge_cases(spark):
    long = "word " * 60_000
    rows = [(1, None), (2, ""), (3, "..."), (4, "one"), (5, long), (5, long), (None, "a b " * 20), (7, "\x00Ünï-côde ABC" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    assert result(resampling.resample(docs, none, percent=50)) == brute(rows, [], percent=50)
    assert result(resampling.resample(docs, spark.createDataFrame([(None,), ("word",)], "text string"), percent=100)) == brute(rows, [None, "word"], percent=100)
    assert {r["rank"] for r in resampling.resample(docs, none, percent=1).collect()} == {None}
    assert resampling.resample(docs.limit(0), none).collect() == []
