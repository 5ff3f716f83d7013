import os
import random

import numpy as np
import pytest

from glimmer.llm import components, minhash

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=75):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def result(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert result(minhash.near_duplicates(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("least, block", [(512, 2048), (40, 7)])
def test_family_without_its_centre_against_brute_force(spark, monkeypatch, least, block):
    """Edits of a text that isn't there itself: some pairs are linked, most are just below."""
    monkeypatch.setattr(minhash, "LEAST", least)
    monkeypatch.setattr(minhash, "LEAST_SLACK", 0.12 if least == 512 else 0.4)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(least)
    rows = []
    for family in range(3):
        base = [f"w{family}x{rng.randrange(500)}" for _ in range(160)]
        for _ in range(30):
            words = list(base)
            for _ in range(rng.randrange(1, 7)):
                words[rng.randrange(160)] = f"e{rng.random()}"
            rows.append((len(rows) * 3 % 91, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert 3 < sum(r[3] for r in want) < 90
    assert result(minhash.near_duplicates(docs)) == want


def test_edge_cases(spark):
    text = "One two three four five six seven"
    rows = [(5, text, 1), (3, text.upper(), 1), (9, None, 1), (8, "", 1), (7, " \n ", None), (6, "one two", 1), (4, "ONE\ttwo", 1), (2, "one two three", 1), (2, "one two three", 1), (None, text, 1), (1, "word " * 30000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=str)
    want = [(5, 3, 3, False), (3, 3, 3, True), (9, 0, 9, True), (8, 0, 8, True), (7, 0, 7, True), (6, 1, 4, False), (4, 1, 4, True), (2, 1, 2, True), (2, 1, 2, True), (None, 3, None, True), (1, 1, 1, True)]
    assert got == sorted(want, key=str)
    assert minhash.near_duplicates(docs.where("doc_id = 99")).collect() == []


def test_copy_after_more_sets_than_a_task_remembers(spark):
    """The copy's set was met in a row without a doc_id, and 20,000 other sets lie between."""
    text = "concat_ws(' ', 'a', 'b', 'c', 'd', if(id IN (0, 20500, 21500), 'x', concat('w', id)))"
    docs = spark.range(0, 24_000, 1, 1).selectExpr("if(id = 0, NULL, id) AS doc_id", f"{text} AS text")
    found = minhash.near_duplicates(docs, rows_per_bucket=100_000).where("NOT kept OR doc_id = 20500 OR doc_id IS NULL OR component_id <> doc_id")
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(None, 1, None, True), (20500, 1, 20500, True), (21500, 1, 20500, False)], key=str)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(200, i) for i in range(201, 260)] + [(5, 5), (None, 3)]
    root = {}
    for a, b in edges:
        if a is None or a == b:
            continue
        for x in (a, b):
            root.setdefault(x, x)
        x, y = root[a], root[b]
        for k in root:
            root[k] = min(x, y) if root[k] in (x, y) else root[k]
    got = {r["u"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in root.items() if k != v}


def test_signature_estimates():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2300])
    want = 1500 / 2300
    s = minhash.signatures([a, b]).astype(np.uint8)
    assert abs(minhash.agreement(s[0].tobytes(), s[1].tobytes()) - want) < 0.15
    assert abs(minhash.near_by_least(minhash.least_hashes(a), minhash.least_hashes(b)) - want) < 0.1
    assert minhash.near_by_least(minhash.least_hashes(a[:100]), minhash.least_hashes(a[:150])) == pytest.approx(100 / 150)


def test_sets_of_just_as_many_hashes_as_are_kept_are_compared_exactly():
    """Two sets of 512 that share 439 (0.7504): the first half of their union shares fewer."""
    pa = pytest.importorskip("pyarrow")
    n, shared = minhash.LEAST, 439
    low, high = np.arange(2 * (n - shared), dtype=np.uint32), np.arange(10_000, 10_000 + shared, dtype=np.uint32)
    sets = [np.concatenate([low[i::2], high]) for i in (0, 1)]
    assert minhash.near_by_least(*sets, True) == shared / (2 * n - shared)
    same = {"node": [1, 2], "component": [1, 2], "own": [0, 0], "i": [0, 0], "j": [0, 0], "n_shingles": [n, n], "band": [7, 7]}
    table = pa.table(same | {"signature": [b"s" * 192] * 2, "bands": [np.full(minhash.BANDS, 7, np.int64).tobytes()] * 2, "least": [s.tobytes() for s in sets]})
    assert minhash._compare(75)(table).to_pylist() == [{"a": 1, "b": 2}]
