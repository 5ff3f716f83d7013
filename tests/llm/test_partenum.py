import os
import random

import numpy as np
import pytest

from glimmer.llm import partenum
from test_minhash import SF, brute


def result(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def want(rows, percent=80):
    return [r[:3] for r in brute(rows, percent)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert result(partenum.jaccard_components(docs)) == want([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("small", [False, True])
def test_families_against_brute_force(spark, monkeypatch, small):
    """Edits of texts that aren't there, long and short: some pairs are linked, most are just below; with small blocks, sketches and hot signatures too."""
    if small:
        for name, value in (("LEAST", 30), ("SLACK", 0.45), ("BLOCK", 7), ("SETS", 40), ("HOT", 3), ("CELL_ROWS", 50)):
            monkeypatch.setattr(partenum, name, value)
    rng = random.Random(5)
    rows = []
    for family in range(6):
        base = [f"w{family}x{rng.randrange(500)}" for _ in range((160, 160, 40, 12, 400, 7)[family])]
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randrange(1, 2 + len(words) // 30)):
                words[rng.randrange(len(words))] = f"e{rng.random()}"
            rows.append((len(rows) * 7 % 151, " ".join(words)))
    found = want(rows)
    assert 6 < sum(r[0] == r[2] for r in found) < 145
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS node", "'x' AS component_id", "3 AS hub")
    assert result(partenum.jaccard_components(docs, range_signatures=500 if small else 1 << 21)) == found


def test_large_group_of_near_copies_is_hot(spark):
    """600 edits of one text share signatures: all are linked through the first of a batch."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(600):
        words = list(base)
        words[rng.randrange(120)] = f"e{i}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000 + i, f"other words of text number {i} and more") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(partenum.jaccard_components(docs)) == want(rows)


def test_groups_of_two_are_compared_whatever_the_centres(spark):
    """The last two texts are linked, meet in groups of the two alone, and neither is among the few centres that the other is paired with."""
    one = [f"w{i}" for i in range(40)]
    two = [*one[1:38], "y0.44370900552695813", "w39", "x0.6869719531756391", "x0.5962110982339794"]
    edits = [
        {6: "e0.3188352290297036", 16: "e0.7566434921026768", 30: "e0.9257864752046526"},
        {2: "e0.5047354679649547", 18: "e0.8165840352127958", 32: "e0.21739691862933253", 36: "e0.4996199052325645", 39: "e0.46376471011871623"},
        {5: "e0.19195895296847598", 23: "e0.5584048882985104", 36: "e0.4724290268059408"},
        {0: "e0.9693606225876774", 12: "e0.48436942119950765", 27: "e0.885335253935772", 29: "e0.9206819014071564"},
        {7: "e0.02942573062240239", 8: "e0.8573031250982401", 10: "e0.14270767104047155", 22: "e0.8836176855629609"},
        {12: "e0.5459341875616391", 28: "e0.8972017263809773"},
        {7: "e0.6908162062937624", 12: "e0.588431112417003", 13: "e0.8575683410423194", 14: "e0.2692555831313792", 18: "e0.2612483414910445"},
        {5: "e0.31077684318420606", 9: "e0.09989947231962515", 10: "e0.6868271737745874", 27: "e0.11486749909072913"},
    ]
    rows = []
    for base, some in [*((one, e) for e in edits[:4]), *((two, e) for e in edits[4:]), (one, {}), (two, {})]:
        rows.append((len(rows), " ".join(some.get(i, w) for i, w in enumerate(base))))
    found = want(rows)
    assert found[8][2] == found[9][2]
    assert result(partenum.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == found


def watched(monkeypatch, test):
    """What a task compares at once has to pass test(rows, smallest set)."""
    made = partenum._compare

    def compare_of(percent):
        compare = made(percent)

        def run(table):
            rows, least = table.num_rows, min(table["n_shingles"].to_pylist())
            if not test(rows, least):
                raise ValueError(f"{rows} rows at once, sets of {least}")
            return compare(table)

        return run

    monkeypatch.setattr(partenum, "_compare", compare_of)


def test_a_large_family_is_dealt_over_tasks(spark, monkeypatch):
    """300 edits of one text that are mostly not linked meet in hundreds of groups: no task holds more than a few cells at once."""
    monkeypatch.setattr(partenum, "BLOCK", 20)
    monkeypatch.setattr(partenum, "CELL_ROWS", 80)
    watched(monkeypatch, lambda rows, least: rows <= 800)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(300):
        words = list(base)
        for place in rng.sample(range(100), 3):
            words[place] = f"e{i}x{place}"
        rows.append((i, " ".join(words)))
    found = want(rows)
    assert 2 < len({r[2] for r in found}) < 300
    assert result(partenum.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == found


def test_sets_too_small_for_links_are_not_compared(spark, monkeypatch):
    """Sets of up to three shingles are linked with equal ones only: they need not meet, however many they are."""
    for percent in (75, 80, 90, 100):
        for n in range(1, 120):
            links = [both for m in range(1, 2 * n + 2) for both in range(min(n, m) + 1) if (both < max(n, m)) and 100 * both >= percent * (n + m - both)]
            assert partenum.alone(n, percent) == (not links)
    watched(monkeypatch, lambda rows, least: least > 3)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(1 + i % 7))) for i in range(200)]
    rows += [(300 + i, " ".join([f"a{j}" for j in range(8)] + [f"b{i}"] * (i % 3))) for i in range(6)]
    assert result(partenum.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == want(rows)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 6, 9, 20, 45, 130, 700])
def test_linked_sets_share_a_signature(size):
    """Pairs at the bound, of any sizes that can be linked, share one; whatever hashes their features have."""
    rng = np.random.default_rng(size)
    for _ in range(60 if size < 100 else 15):
        other = int(rng.integers(size, size * 100 // 80 + 1))
        both = -(-80 * (size + other) // 180)  # the least intersection that links
        if both > size:
            continue
        values = rng.integers(0, 1 << 63, size + other - both, dtype=np.int64).astype(np.uint64) << np.uint64(1)
        if rng.random() < 0.3:
            values >>= np.uint64(3)  # crowded: many parts are empty
        one, two = np.unique(values[:size]), np.unique(values[size - both :])
        assert len(np.intersect1d(partenum.signatures(one, 80), partenum.signatures(two, 80)))


def test_bands_hold_what_can_be_linked():
    for n in range(1, 400):
        number, high = partenum.band(n, 80)
        assert n <= high and partenum.band(high, 80)[0] == number and partenum.band(high + 1, 80)[0] == number + 1
        assert partenum.band(n * 100 // 80, 80)[0] <= number + 1


def test_edge_cases(spark):
    text = "One two three four five six seven"
    rows = [(5, text, 1), (3, text.upper(), 1), (9, None, 1), (8, "", 1), (7, " \n ", None), (6, "one two", 1), (4, "ONE\ttwo", 1), (2, "one two three", 1), (2, "one two three", 1), (None, text, 1), (1, "word " * 30000, 1), (11, " ".join(map(str, range(60_000))), 1), (10, " ".join(map(str, range(59_000))), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int")
    got = sorted(map(tuple, partenum.jaccard_components(docs).collect()), key=str)
    found = [(5, 3, 3), (3, 3, 3), (9, 0, 9), (8, 0, 8), (7, 0, 7), (6, 1, 4), (4, 1, 4), (2, 1, 2), (2, 1, 2), (None, 3, None), (1, 1, 1), (11, 59_996, 10), (10, 58_996, 10)]
    assert got == sorted(found, key=str)
    assert partenum.jaccard_components(docs.where("doc_id = 99")).collect() == []
