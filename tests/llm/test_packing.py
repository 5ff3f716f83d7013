import itertools
import random
import zlib

import numpy as np
import pytest

from glimmer.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference_ids(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


TEXTS = ["", " ", "a", "Hello, world!  It's 12.5 \n\n über—naïve 日本語 <|endoftext|> x", "<|endoftext|>", "a <|endoftext|><|endoftext|>  b <|endoftext| >\n", "end. Next? Yes!\nNo.", None, "  lead", "trail  ", "é" * 50, "word " * 5000, "don't 've we'll\t\tx"]


def test_encoder_equals_the_tokenizers_library(monkeypatch):
    encoder = packing.Encoder(open(PATH).read())
    for part in (1 << 20, 7):
        monkeypatch.setattr(packing, "PART", part)
        ids, counts, stops = encoder([t or "" for t in TEXTS])
        want = [reference_ids(t) for t in TEXTS]
        assert ids.tolist() == [x for w in want for x in w]
        assert counts.tolist() == [len(w) for w in want]
        assert len(stops) == len(ids)


def test_round_trip(spark):
    rng = random.Random(3)
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(rng.choice(["so.", "it", "goes!", "on\n", "and"]) for _ in range(rng.randrange(0, 3000)))) for i in range(40)] + [(None, "x"), (0, "a"), (0, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS start", "1 AS length")
    pieces = packing.pack(docs.coalesce(2), PATH).collect()
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    for doc_id, text in rows:
        ids = np.array(reference_ids(text), "<u4")
        if doc_id in (None, 0):
            continue
        mine = sorted(by_doc[doc_id], key=lambda p: p["start"])
        at = 0
        for p in mine:
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    assert len(by_doc[0]) == 3 and len(by_doc[None]) == 1
    padded = tokens = 0
    for _, group in itertools.groupby(sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])), lambda p: p["sequence_id"]):
        at = 0
        for p in group:
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= 2048
        tokens += at
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    assert padded <= 0.02 * tokens + 2 * 2048


def test_best_cuts_against_exhaustive_search():
    rng = np.random.default_rng(5)
    for _ in range(200):
        length = int(rng.choice([4, 8, 16]))
        n = int(rng.integers(1, 9))
        places = np.cumsum(rng.integers(1, length + 1, n))
        penalties = rng.integers(0, 5, n).astype(float)
        penalties[-1] = 0
        cuts, cost = packing.best_cuts(places, penalties, length, True)

        def price(chosen):
            total, start = 0.0, 0
            for i in chosen:
                size = int(places[i]) - start
                if size > length:
                    return float("inf")
                total += penalties[i] + (0 if size & (size - 1) == 0 else length - size)
                start = int(places[i])
            return total

        best = min(price([*c, n - 1]) for k in range(n) for c in itertools.combinations(range(n - 1), k))
        assert price(cuts) == pytest.approx(cost) == pytest.approx(best)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
