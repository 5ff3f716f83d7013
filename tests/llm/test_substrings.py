import hashlib
import random

import numpy as np
import pytest

from glimmer.llm import substrings


def brute(rows, length):
    words = [(text or "").split() for _, text in rows]
    seen = {}
    for w in words:
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone |= set(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), kept))
    return sorted(out, key=str)


def test_levels():
    assert substrings.levels(35, 18) == [18, 35] and substrings.levels(35, 5) == [5, 9, 18, 35] and substrings.levels(4, 9) == [4]
    assert all(b <= 2 * a for a, b in zip(substrings.levels(1000, 3), substrings.levels(1000, 3)[1:]))


@pytest.mark.parametrize("length, first", [(35, 9), (35, 18), (6, 2), (1, 1)])
def test_against_brute_force(spark, length, first):
    rng = random.Random(length)
    passages = [" ".join(f"p{rng.randrange(9)}" for _ in range(rng.randrange(3, 60))) for _ in range(6)]
    rows = [(i, " ".join(rng.choice(passages) if rng.random() < 0.4 else f"u{rng.randrange(400)} \t" for _ in range(rng.randrange(0, 25)))) for i in range(50)]
    rows += [(50, rows[3][1]), (51, rows[3][1]), (52, None), (53, ""), (54, " \n"), (None, rows[4][1]), (50, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kept", "2 AS key", "3 AS part")
    for part_bytes, range_words in ((8 << 20, 1 << 21), (500, 40)):
        got = substrings.remove_repeats(docs, length, first, part_bytes=part_bytes, range_words=range_words).collect()
        want = brute(rows, length)
        assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str) == want
        assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)
    digest = substrings.remove_repeats(docs, length, first, as_digest=True).select("kept_sha256").collect()
    assert sorted(r[0] for r in digest) == sorted(hashlib.sha256(w[3].encode()).hexdigest() for w in want)


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeated():
    values = np.array([3, 1, 3, 2, 1, 9], "<u4")
    assert substrings._repeated(values).tolist() == [True, True, True, False, True, False]
    assert substrings._repeated(values[:0]).tolist() == []


def test_a_range_gets_each_hash_once_from_a_part():
    """A part that is one passage over and over sends each of its windows once, as repeated."""
    from glimmer.llm.text import Hasher

    text = b" ".join(b"p%d" % (i % 50) for i in range(5000))
    w = substrings.Windows([text], Hasher(), 35)
    sent = list(substrings._sent(w, [18, 35], [], 1))
    assert sum(int.from_bytes(p[:4], "little") for _, p in sent) == 50
    assert all(f.all() for _, p in sent for f in substrings._answers([p], np.dtype("<u4")))
    alone = substrings.Windows([b" ".join(b"q%d" % i for i in range(100))], Hasher(), 35)
    found = [substrings._answers([p], np.dtype("<u4"))[0] for _, p in substrings._sent(alone, [18, 35], [], 1)]
    assert not np.concatenate(found).any() and sum(map(len, found)) == 83
