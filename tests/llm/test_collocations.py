import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from glimmer.llm import collocations, registry

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=30, percent=80, top=2000):
    """All n-grams counted in one table."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                f.update((lang or "und", *words[i : i + k]) for i in range(len(words) - k + 1))
    f = {p: c for p, c in f.items() if c >= least}
    out = {}
    for (lang, *words), a in f.items():
        if len(words) < 2:
            continue
        cut = min((2_000_000 * a // (f[(lang, *words[:k])] + f[(lang, *words[k:])]), k) for k in range(1, len(words)))
        inside = lambda w: any(w[i : i + len(words)] == words for i in range(len(w) - len(words) + 1))
        if any(x == lang and len(w) > len(words) and 100 * c >= percent * a and inside(w) for (x, *w), c in f.items()):
            continue
        out.setdefault(lang, []).append((-cut[0], -a, " ".join(words).encode(), f[(lang, *words[: cut[1]])], f[(lang, *words[cut[1] :])]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for lang, found in out.items() for i, (score, a, p, left, right) in enumerate(sorted(found)[:top]))


def result(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_query_against_brute_force_and_sql(spark):
    got = result(registry.op12_collocations(spark, SF))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got and got == brute([(r["lang"], r["text"]) for r in docs.collect()])
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == sorted(c.sql(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({registry.OP12_SQL})").fetchall())


def words_of(seed, n, kinds=9):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(kinds)]
    return [(rng.choice(("aa", "bb", "und", None)), "".join(rng.choices(words, [2.0**-i for i in range(kinds)])[0] + rng.choice((" ", " ", " ", "\t ", ". ", "\n", ",")) for _ in range(rng.randrange(1, 60)))) for _ in range(n)]


@pytest.mark.parametrize("more", [{}, {"part_bytes": 2000, "bucket_bytes": 800, "hot": 0.1}])
def test_parts_buckets_and_hot_pivots_change_nothing(spark, monkeypatch, more):
    """Few words in heavy use: repeated pivots (w0 w0), phrases over all buckets, a passage that a third of the rows have."""
    if more:
        monkeypatch.setattr(collocations, "CHUNK", 300)
    rows = words_of(1, 160) + [("aa", "one very common passage, one very common passage")] * 80
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS part", "'x' AS word", "2 AS f", "3 AS rank", "4 AS n")
    want = brute(rows, 5)
    assert len(want) > 100 and len({w[0] for w in want}) == 3
    assert result(collocations.collocations(docs, 5, **more)) == want
    assert result(collocations.collocations(docs, 5, percent=30, top=7, **more)) == brute(rows, 5, 30, 7)


def test_edge_cases(spark):
    rows = [("x", None), ("x", ""), ("x", " \t ,.\n"), (None, "a b " * 20_000), ("und", "A\tB"), ("y", "é É ,é É " * 3), ("y", "A b c　d " * 3)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert result(collocations.collocations(docs, 3)) == brute(rows, 3)
    assert collocations.collocations(docs.limit(0)).collect() == []
    assert collocations.collocations(docs.where("lang = 'x'")).collect() == []


def test_each_occurrence_is_in_one_fragment():
    """The n-grams around the pivots of a chunk's fragments are all its n-grams, each as often as it is there."""
    rng = np.random.default_rng(3)
    ids = rng.integers(-1, 6, 400)
    rank = np.array([3, 0, 4, 1, 2, -1], np.int32)
    found = {tuple(r): n for rows, total in collocations.mine(*collocations.fragments(ids, rank), 1) for r, n in zip(rows.tolist(), total.tolist(), strict=True)}
    want = Counter()
    ranks = np.append(rank, -1)[ids].tolist()
    for k in (2, 3, 4):
        want.update(tuple(ranks[i : i + k]) for i in range(len(ranks) - k + 1) if min(ranks[i : i + k]) >= 0)
    assert found == dict(want)
