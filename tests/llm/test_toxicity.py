import collections
import math
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.llm import toxicity

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = toxicity.predict_held_out(docs, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == docs.count()
    rows = found.join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").where("held_out").collect()
    assert sum(r["toxic"] == r["predicted"] for r in rows) >= 0.93 * len(rows)


def beginnings(text):
    """For each word, its beginnings by length, the whole word first."""
    for word in re.findall(rb"[a-z\x80-\xff]+", text.lower().encode("utf-8", "replace")):
        yield [(n, word[:n] if n else word) for n in toxicity.STEMS if len(word) >= n]


def hashed(n, stem):
    return int(next(toxicity.Reader().stems([stem], (n,)))[2][0])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_query_against_brute_force(spark, monkeypatch):
    """The lexicon, every measure and every score of the query, counted again by loops over whole texts."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    models = []
    learn = toxicity.learn
    monkeypatch.setattr(toxicity, "learn", lambda *a: models.append(learn(*a)) or models[-1])
    got = {r["doc_id"]: r for r in toxicity.predict_held_out(docs, labels).collect()}
    model = models[0]
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}
    toxic_of = {}
    for r in labels.collect():
        if r["doc_id"] in texts and not held[r["doc_id"]] and r["toxic"] is not None:
            toxic_of[r["doc_id"]] = max(r["toxic"], toxic_of.get(r["doc_id"], 0))
    counts = [collections.Counter(), collections.Counter()]
    for i, y in toxic_of.items():
        counts[y].update({b for word in beginnings(texts[i]) for b in word})
    toxic = sum(toxic_of.values())
    clean, lexicon = len(toxic_of) - toxic, set()
    for b, n in counts[1].items():
        m, share = counts[0][b], toxic / len(toxic_of)
        ratio = 2 * (n * math.log(n / ((n + m) * share)) + (m * math.log(m / ((n + m) * (1 - share))) if m else 0))
        if n >= toxicity.LEAST_DOCUMENTS and n / toxic >= toxicity.LIFT * (m + 0.5) / clean and ratio >= toxicity.SURE:
            lexicon.add(b)
    codes = {b: hashed(*b) for b in lexicon}
    assert lexicon and sorted(codes.values()) == sorted(model.lexicon.tolist())
    assert got.keys() == texts.keys() and {i: r["held_out"] for i, r in got.items()} == held
    for i, text in texts.items():
        hits = [found[-1] for word in beginnings(text) if (found := [b for b in word if b in lexicon])]
        banks = collections.Counter(int(toxicity.mix(np.array([codes[b]], np.uint64))[0] % np.uint64(toxicity.BANKS)) for b in hits)
        row = [len(text.split()), len(hits), len(set(hits)), text.count("!"), sum(map(str.isupper, text)) / max(1, len(text)), text.count("\n") + 1]
        x = toxicity.features(np.array([row + [banks[b] for b in range(toxicity.BANKS)]], float))[0]
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(x @ model.weights)))))
        assert abs(p - got[i]["score"]) < 1e-9 and got[i]["predicted"] == (got[i]["score"] >= 0.5), i


def test_lexicon_keeps_the_surest_beyond_its_size(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEXICON", 3)
    labelled = spark.createDataFrame([("zorg" + (" plim" if i < 6 else "") + " and", 1) for i in range(30)] + [("and nothing", 0)] * 300, "text string, toxic int")
    model = toxicity.learn(labelled)
    assert len(model.lexicon) == 3 and learned(model, "zorg") and not learned(model, "plim")


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(1)
    y = (rng.random(4000) < 0.3).astype(int)
    vote = lambda accuracy, shown: np.where(rng.random(4000) < shown, np.where(rng.random(4000) < accuracy, 2 * y - 1, 1 - 2 * y), 0)
    one = vote(0.7, 1.0)
    v = np.stack([vote(0.9, 0.8), vote(0.85, 0.7), vote(0.8, 0.9), one, one, one], axis=1).astype(np.int8)
    model = toxicity.LabelModel(v, 0.3)
    right = model.tables[1, :, 2] / (model.tables[1, :, 2] + model.tables[1, :, 0])
    assert np.allclose(right[:4], [0.9, 0.85, 0.8, 0.7], atol=0.08)
    # The copies of a voter hang together.
    edges = {frozenset(x) for x in enumerate(model.parents) if x[1] >= 0}
    assert len(edges & {frozenset(x) for x in ((3, 4), (3, 5), (4, 5))}) == 2
    assert model.information[3, 4] > 0.3 > 0.03 > model.information[0, 1]
    assert ((model.posterior(v) > 0.5) == y).mean() > 0.9
    # By enumeration: the posterior is the share of the class in the joint probability of the votes.
    at = v[:50].astype(int) + 1
    joint = [np.prod([model.joint[j, c, at[:, k], at[:, j]] if (k := model.parents[j]) >= 0 else model.tables[c, j][at[:, j]] for j in range(6)], axis=0) for c in (0, 1)]
    assert np.allclose(model.posterior(v[:50]), 0.3 * joint[1] / (0.3 * joint[1] + 0.7 * joint[0]))


def test_bloom_filter_keeps_all_labelled_documents(spark, monkeypatch):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'x' AS bloom_word")
    ids = spark.range(0, 20_000, 10).selectExpr("id AS doc_id")
    found = toxicity.labelled_only(docs, ids)
    assert found.columns == docs.columns and found.join(ids, "doc_id").count() == 2000 and found.count() < 4000
    monkeypatch.setattr(toxicity, "BLOOM_BITS", 1 << 10)
    assert toxicity.labelled_only(docs, ids).join(ids, "doc_id").count() == 2000
    assert toxicity.labelled_only(docs, ids.where("doc_id < 0")).count() == 0


def test_regression_against_gradient():
    rng = np.random.default_rng(2)
    x = np.concatenate([np.ones((300, 1)), rng.normal(size=(300, 3))], axis=1)
    p = rng.random(300)
    w = toxicity.regress(x, p)
    q = 1 / (1 + np.exp(-x @ w))
    assert np.abs(x.T @ (p - q) - np.array([1e-3, 1, 1, 1]) * w).max() < 1e-6


def learned(model, word):
    """Whether the lexicon has the word as a whole."""
    return bool(np.isin(next(toxicity.Reader().stems([word.encode()], (0,)))[2], model.lexicon).all())


def test_rare_terms_of_many_documents_are_learned(spark):
    """Ten of 5,000 toxic documents have a term, and no clean one; a word of a few documents of both kinds isn't toxic."""
    text = "CASE WHEN toxic = 1 AND id % 500 = 1 THEN 'a zorgwump here' WHEN id % 500 = 2 THEN 'a plimbled here' ELSE 'nothing to see' END"
    labelled = spark.range(15_000).selectExpr("id", "int(id < 5000) AS toxic").selectExpr(f"concat({text}, ' ', id) AS text", "toxic")
    model = toxicity.learn(labelled)
    assert learned(model, "zorgwump") and not learned(model, "plimbled") and not learned(model, "nothing")


def test_terms_rarer_than_many_others_are_learned(spark):
    """More than 20,000 word beginnings are in all documents of both kinds; a term in nine of ten toxic ones comes after them."""
    rng = np.random.default_rng(3)
    common = " ".join("".join(map(chr, x)) for x in rng.integers(97, 123, (6000, 9)))
    labelled = spark.createDataFrame([(common + (" zorgwump" if i < 9 else ""), int(i < 10)) for i in range(40)], "text string, toxic int")
    assert learned(toxicity.learn(labelled), "zorgwump")


def test_capitals_are_counted_over_the_whole_text():
    texts = ["aB" * 2000, "Ba" * 2000, "a" * 600_000 + "ÄЖB\U0001d400 ß9", "", "Ab"]
    found = toxicity.Reader().measure(texts)[:, toxicity.MEASURES.index("capitals")]
    assert found.tolist() == [sum(map(str.isupper, t)) / max(1, len(t)) for t in texts]


def test_edge_cases(spark):
    good, bad = "the quiet house by the sea", "you stupid moron, what trash"
    labelled = spark.createDataFrame([(good + f" {i}", 0) for i in range(30)] + [(bad + f" {i}", 1) for i in range(30)] + [(None, 0), (good, None), (good, 7)], "text string, toxic int")
    model = toxicity.learn(labelled)
    docs = spark.createDataFrame([(1, good, 5.0), (2, bad, 5.0), (3, None, None), (4, "", 5.0), (5, "house " * 20000 + bad, 5.0), (5, "house " * 20000 + bad, 5.0)], "doc_id long, text string, score double")
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert {i: r["predicted"] for i, r in got.items()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 1}
    assert all(0 <= r["score"] <= 1 for r in got.values())
    for none in (labelled.where("toxic = 9"), labelled.where("toxic = 0"), labelled.where("toxic = 1")):
        assert toxicity.score(docs, toxicity.learn(none)).count() == 6
    assert toxicity.score(docs.where("doc_id = 9"), model).collect() == []
