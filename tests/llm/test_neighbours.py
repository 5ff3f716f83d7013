import math

import numpy as np
import pytest

from glimmer.llm import neighbours


def brute(rows, every, k):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, q in fine:
        if i % every == 0:
            out[i] = sorted((-(q * v).sum(), j) for j, v in {(j, tuple(v)): (j, v) for j, v in fine}.values() if j != i)[:k]
    return out


def table(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


@pytest.mark.parametrize("block, queries", [(8192, 16384), (100, 7)])
def test_recall_against_brute_force(spark, monkeypatch, block, queries):
    """Blocks of rows and of queries within a leaf change nothing."""
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 50)
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "QUERIES", queries)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    data = [(i, (centres[i % 12] + 0.4 * rng.normal(size=16)).astype(np.float32).astype(float).tolist()) for i in range(2000)]
    data += [(3000 + i, data[0][1]) for i in range(30)]  # equal vectors: ties go to the smaller vec_id
    found = table(neighbours.nearest(spark.createDataFrame(data, "vec_id long, embedding array<float>")))
    want = brute(data, 20, 20)
    assert set(found) == set(want) and all(len(x) == 20 for x in found.values())
    scores = {i: {j: -s for s, j in x} for i, x in found.items()}
    hits = sum(len({j for _, j in want[i]} & set(scores[i])) for i in want)
    assert hits >= 0.95 * 20 * len(want)
    vectors = {i: np.array(v) for i, v in data}
    for i, x in found.items():
        assert x == sorted(x)
        assert all(s == pytest.approx(-(vectors[i] * vectors[j]).sum(), abs=1e-12) for s, j in x)


def test_many_leaves_at_the_default_sizes():
    """On 20,000 rows in clusters the tree has tens of leaves, few of them are visited, and those have nine of ten true neighbours."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(150, 24))
    rows = centres[rng.integers(0, 150, 20_000)] + 0.3 * rng.normal(size=(20_000, 24))
    tree = neighbours.Tree(rows, len(rows) // neighbours.LEAF_ROWS)
    leaf = tree.assign(rows)
    assert tree.leaves > 30
    near = [(q, np.argsort(-(rows @ rows[q]))[1:21]) for q in range(300)]
    visits, spread = neighbours.calibrated(tree, rows[:150], [(q, leaf[i]) for q, ids in near[:150] for i in ids], 0.97)
    assert visits < tree.leaves / 3
    found = [np.isin(leaf[ids], tree.visit(rows[q], visits, spread)).mean() for q, ids in near[150:]]
    assert np.mean(found) >= 0.9


def test_edge_cases(spark):
    nan, inf = math.nan, math.inf
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [2.0]), (8, []), (None, [1.0, 1.0]), (20, [0.0, 2.0]), (40, [0.0, 0.0]), (9, [-1.0, 0.5])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "2 AS score")
    assert table(neighbours.nearest(df)) == {0: [(-1.0, 1), (0.0, 20), (1.0, 9)], 20: [(-1.0, 9), (0.0, 0), (0.0, 1)]}
    assert neighbours.nearest(df.where("vec_id = 99")).collect() == []
    assert neighbours.nearest(df.where("vec_id = 1")).collect() == []
    assert neighbours.nearest(df.where("vec_id = 0")).collect() == []
