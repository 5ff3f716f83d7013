import hashlib
import os
import random

import numpy as np
import pytest

from glimmer.llm import lines
from glimmer.llm.text import Hasher

SF = "/root/testdata/sf0.001"


def brute(rows, percent=75):
    """(doc_id, n_lines, n_removed, hash) by comparing every line with all earlier ones."""
    flat = []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        for number, line in enumerate([] if text is None else text.split("\n")):
            flat.append((doc_id, number, frozenset(line.encode().split()), line))
    removed = set()
    earlier: list[frozenset] = []
    seen: set[frozenset] = set()
    for doc_id, number, words, _ in flat:
        if not words:
            continue
        if words in seen or any(100 * (o := len(words & e)) >= percent * (len(words) + len(e) - o) for e in earlier):
            removed.add((doc_id, number))
        if words not in seen:
            seen.add(words)
            earlier.append(words)
    out = []
    for doc_id, text in rows:
        split = [] if text is None else text.split("\n")
        left = [x for i, x in enumerate(split) if (doc_id, i) not in removed]
        out.append((doc_id, len(split), len(split) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((r["doc_id"], r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert result(lines.dedup_lines(docs, as_digest=True)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def edits(seed, documents, vocabulary, length):
    """Lines that are edits of 25 others."""
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(1, length))] for _ in range(25)]
    rows = []
    for doc_id in range(documents):
        text = []
        for _ in range(rng.randrange(0, 6)):
            words = list(rng.choice(base))
            for _ in range(rng.randrange(0, 3 + len(words) // 8)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(vocabulary)}"
            text.append(" ".join(words))
        rows.append((doc_id, "\n".join(text)))
    return rows


@pytest.mark.parametrize("percent, first, part_bytes, vocabulary, length", [(60, (2, 4, 4), 900, 60, 14), (75, (1, 1, 1), 300, 60, 14), (75, (2, 16, 256), 1 << 23, 400, 60), (90, (1, 2, 3), 2000, 200, 40)])
def test_random_lines_against_brute_force(spark, percent, first, part_bytes, vocabulary, length, monkeypatch):
    """One part or many, with sketches of all widths, words compared in blocks, and sets that come to later rounds."""
    monkeypatch.setattr(lines, "SIZES", (3, 5, 9))
    monkeypatch.setattr(lines, "FIRST", first)
    monkeypatch.setattr(lines, "HOT", 40)
    rows = edits(percent, 60, vocabulary, length)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(lines.dedup_lines(docs, percent, as_digest=True, part_bytes=part_bytes, range_entries=100)) == brute(rows, percent)


def test_a_cell_against_all_pairs():
    """The candidates of one cell have all similar pairs whose first shared word is there, and keep to low and high."""
    rows = edits(5, 80, 30, 30)
    parsed = lines.Lines.whole([t.encode() for _, t in rows], Hasher())
    places = np.arange(len(rows))
    table = np.full(1 << lines.TABLE_BITS, 9, np.uint8)
    cells = [p for e, s in lines.index_entries(parsed, places, places, table, 75) for _, _, p in lines.cells(e, s, 1)]
    found = lines.candidates(cells, 75, 0, 1 << 20)
    sets = {(d, n): frozenset(x.split()) for d, t in rows for n, x in enumerate(t.split("\n")) if x.split()}
    names = sorted(sets)
    near = {(y, x) for i, y in enumerate(names) for x in names[:i] if 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])}
    pairs = {((r, n), (r2, n2)) for r, n, r2, n2, _, _ in found.tolist()}
    assert near and near <= pairs and not found["more"].any() and len(pairs) == len(found)
    some = lines.candidates(cells, 75, 0, 1)
    assert {tuple(x)[:2] for x in some[["row", "line"]].tolist()} == {y for y, _ in pairs} and some["more"].any()


def test_lines_of_texts_longer_than_a_piece():
    """Word hashes and line numbers are those of each line by itself."""
    rng = random.Random(6)
    texts = [b"\n".join(b" ".join(b"v%d" % rng.randrange(10**6) for _ in range(rng.randrange(0, 30))) for _ in range(n)) for n in (3, 9000, 1, 40)]
    texts[2:2] = [b"", b"\n", b" x\n\ny ", b"z" * (3 << 19) + b" q\n" + b"r \n" * 70000]
    whole, hasher = lines.Lines.whole(texts, Hasher()), Hasher()
    split = [(i, n, x) for i, t in enumerate(texts) for n, x in enumerate(t.split(b"\n"))]
    assert whole.doc.tolist() == [i for i, _, _ in split] and whole.number.tolist() == [n for _, n, _ in split]
    words, counts = hasher.words([x for _, _, x in split])
    assert (whole.words == words).all() and (whole.line == np.repeat(np.arange(len(split)), counts)).all()
    some = lines.Lines.some(texts, hasher, np.array([0, 1, 1]), np.array([2, 5, 8000]))
    assert some.words.tolist() == hasher.words([split[2][2], split[8][2], split[8003][2]])[0].tolist()


def test_edge_cases(spark):
    rows = [(1, "a b c d", "x"), (2, None, "x"), (3, "", None), (4, "a b c d\n\n \nq", "x"), (4, "a b c d\n\n \nq", "x"), (None, "q\nz", "x"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed string").withColumnRenamed("removed", "kept")
    found = lines.dedup_lines(docs)
    assert found.columns == ["doc_id", "n_lines", "n_removed", "removed", "kept"]
    got = sorted(found.collect(), key=str)
    want = [(1, 1, 0, [], "a b c d"), (2, 0, 0, [], None), (3, 1, 0, [], ""), (4, 4, 1, [0], "\n \nq"), (4, 4, 2, [0, 3], "\n "), (None, 0, 0, [], None), (None, 2, 1, [0], "z")]
    assert got == sorted([type(got[0])(*w) for w in want], key=str)
    assert lines.dedup_lines(docs.where("doc_id > 9")).collect() == []


def test_entries_do_not_depend_on_the_batch():
    """A line has the same index entries alone, among a few lines and among more than are sorted at once."""
    rng = random.Random(3)
    line = b" ".join(b"w%d" % rng.randrange(500) for _ in range(130))
    table, hasher = np.ones(1 << lines.TABLE_BITS, np.uint8), Hasher()
    found = []
    for before, after in ((0, 0), (0, 7), (9000, 9000), (70000, 3)):
        text = b"\n".join([b"x y"] * before + [line] + [b"", b"z"] * after)
        entries, sketch = lines.index_entries(lines.Lines.whole([text], hasher), np.array([5]), np.array([7]), table, 75)[2]
        mine = entries["line"] == before
        entries["line"] = 0
        found.append((entries[mine].tolist(), sketch[mine].tolist()))
        packed = lines.unpack(lines.pack({c: entries[c] for c in entries.dtype.names}, sketch), lines.ENTRY)
        assert (packed[0] == entries).all() and (packed[1] == sketch).all()
    assert len(found[0][0]) > 20 and all(f == found[0] for f in found)


def test_batches_of_very_different_line_counts(spark, monkeypatch):
    """Each text fills a part of its own, of 32 to 9,030 lines; sets come to later rounds."""
    monkeypatch.setattr(lines, "FIRST", (1, 1, 1))
    rng = random.Random(4)
    base = [[f"w{rng.randrange(300)}" for _ in range(12)] for _ in range(12)]

    def edited():
        words = list(rng.choice(base))
        words[rng.randrange(12)] = f"w{rng.randrange(300)}"
        return " ".join(words)

    short = [(i, "\n".join(edited() for _ in range(30))) for i in range(4)]
    # long words that are like no other line
    rows = [(i, "\n".join([text, *(f"q{i}x{j}" + "z" * (6_400_000 // n) for j in range(n))])) for (i, text), n in zip(short, (2, 9000, 200, 40), strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_lines"] - n, r["n_removed"]) for r, n in zip(lines.dedup_lines(docs, as_digest=True).orderBy("doc_id").collect(), (2, 9000, 200, 40), strict=True))
    assert got == [r[:3] for r in brute(short)]


def test_later_rounds_read_the_texts_twice(spark, monkeypatch):
    """A later round reads all texts for its entries and once for its pairs; what it asks for comes from words that are there."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    passes, plain = [], PandasCogroupedOps.applyInArrow
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", lambda self, f, schema: passes.append(f.__name__) or plain(self, f, schema))
    monkeypatch.setattr(lines, "FIRST", (1, 1, 1))
    rows = edits(75, 60, 60, 14)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(lines.dedup_lines(docs, as_digest=True)) == brute(rows)
    assert passes[-1] == "finish" and passes.count("send") > 1
    assert set(passes) == {"send", "give", "finish"} and len(passes) <= 2 * passes.count("send") + 2, passes
