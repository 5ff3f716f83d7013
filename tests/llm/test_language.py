import itertools
import os

import numpy as np
import pytest

from glimmer.llm import language

SF = "/root/testdata/sf0.01"


def enumerated(scores, step):
    """Posteriors and expected pairs by summing over all label sequences."""
    n, s = scores.shape
    p, pairs, total = np.zeros((n, s)), np.zeros((s, s)), 0.0
    for path in itertools.product(range(s), repeat=n):
        # The first word follows a uniform label.
        w = np.exp(sum(scores[i, y] for i, y in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:]))) * np.exp(step[:, path[0]]).sum()
        total += w
        for i, y in enumerate(path):
            p[i, y] += w
        for a, b in zip(path, path[1:]):
            pairs[a, b] += w
    return p / total, pairs / total


def test_forward_backward_against_enumeration(monkeypatch):
    rng = np.random.default_rng(1)
    step = rng.normal(size=(3, 3))
    counts = np.array([1, 0, 6, 4])
    scores = rng.normal(size=(11, 3)) * 2
    for chain in (64, 2):
        monkeypatch.setattr(language, "CHAIN", chain)
        pairs = np.zeros((3, 3))
        got = language.forward_backward(scores, counts, step, pairs)
        at, want_pairs = 0, np.zeros((3, 3))
        for n in counts:
            if n:
                p, q = enumerated(scores[at : at + n], step)
                assert np.allclose(got[at : at + n], p)
                want_pairs += q
            at += n
        if chain == 64:
            assert np.allclose(pairs, want_pairs)


def test_grams_of_a_piece():
    features = language.Features()
    text = b"ab  c"
    buf = np.frombuffer(text, np.uint8)
    starts, ends = features.hasher.bounds(buf)
    slots, begins, _ = features.grams(buf, starts, ends)
    pairs = slots[0]
    want = {0: b" a", 1: b"ab", 2: b"b ", 4: b" c", 5: b"c "}
    assert {i: (x[0] << 8) | x[1] for i, x in want.items()} == {i: v for i, v in enumerate(pairs.tolist()) if v >= 0}
    assert (slots[1] >= 0).sum() == 3 and (slots[2] >= 0).sum() == 1  # " ab", "ab ", " c " and " ab "
    assert begins.tolist() == [0, 4]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.predict_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    assert len(rows) == docs.count()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_switches_and_edge_cases(spark):
    words = {"xx": "aba baba abab bab".split(), "yy": "oto tok kott otok".split()}
    rng = np.random.default_rng(4)
    make = lambda lang, n: " ".join(rng.choice(words[lang], n))
    labelled = spark.createDataFrame([(make(lang, 30), lang) for lang in ("xx", "yy") for _ in range(40)] + [(None, "xx"), ("aba", None)], "text string, lang string")
    field = language.learn(labelled)
    long = make("xx", 3000)
    texts = [(1, make("xx", 10) + " " + make("yy", 5)), (2, None), (3, ""), (4, "12 !! 3"), (5, long), (5, long)]
    docs = spark.createDataFrame([(i, t, "z", 1.0) for i, t in texts], "doc_id long, text string, lang_pred string, score double")
    got = sorted(language.identify(docs, field, spans=True).collect(), key=lambda r: r["doc_id"])
    assert [r["lang_pred"] for r in got] == ["xx", "und", "und", "und", "xx", "xx"]
    assert [(s["start"], s["end"], s["lang"]) for s in got[0]["lang_spans"]] == [(0, 10, "xx"), (10, 15, "yy")]
    assert got[1]["score"] == 0.0 and 0.5 < got[0]["score"] <= 1.0
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}
    assert language.learn(labelled.where("lang = 'none'")) is None
    assert language.identify(docs.where("doc_id = 9"), field).collect() == []
