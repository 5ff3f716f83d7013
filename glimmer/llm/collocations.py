"""Phrase collocations: frequent n-grams mined by pivot partitioning, scored by how their words keep together.

Each language is mined by itself.  Words too rare to be in a frequent phrase
are gaps.  Every n-gram belongs to its rarest word, the pivot (the leftmost one,
where it is there twice), so each place of a text sends one fragment to its
word: the neighbours on either side as far as they are no rarer.  A word's
fragments meet in one bucket, where all n-grams around the pivot are counted
locally; no other bucket counts them.  The commoner a pivot, the fewer words can
stand beside it, so fragments of common words are few, equal and counted
before they are sent.

The frequencies come back to the texts part by part: a part sends its distinct
words once and gets the frequent ones back, so no word list is broadcast.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.llm.tables import Saved
from glimmer.llm.text import encoded

#: Lower-cases A-Z; breaks between pieces are line feeds, a tab is a space.
_TABLE = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of text whose words are looked at at once.
CHUNK = 4 << 20
LONGEST = 4
#: The n-grams of a fragment: so many words before and after the pivot.
SPANS = {n: [(n - 1 - after, after) for after in range(n)] for n in range(2, LONGEST + 1)}


def chunks(texts: list[bytes]) -> Iterator[bytes]:
    """The texts, translated and joined by breaks, in chunks of about CHUNK bytes that end with pieces; a longer piece is a chunk of its own."""
    held, size = [], 0
    for text in texts:
        text = text.translate(_TABLE)
        while len(text) > CHUNK:
            cut = text.rfind(b"\n", 0, CHUNK)
            cut = cut if cut >= 0 else text.find(b"\n", CHUNK)
            if cut < 0:
                break
            yield text[:cut]
            text = text[cut + 1 :]
        held.append(text)
        size += len(text) + 1
        if size >= CHUNK:
            yield b"\n".join(held)
            held, size = [], 0
    if held:
        yield b"\n".join(held)


def tokens(chunk: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Word numbers of a chunk in order, -1 at a break, and the words by number."""
    import pyarrow as pa

    parts = chunk.replace(b"\n", b" \n ").split(b" ")
    coded = pa.array(parts, pa.binary()).dictionary_encode()
    words, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    number = np.full(len(words), -2, np.int32)
    real = [i for i, w in enumerate(words) if w not in (b"", b"\n")]
    number[real] = np.arange(len(real), dtype=np.int32)
    if len(real) < len(words) and b"\n" in words:
        number[words.index(b"\n")] = -1
    ids = number[ids]
    return ids[ids > -2], [words[i] for i in real]


def word_counts(texts: list[bytes]) -> Counter:
    total: Counter = Counter()
    for chunk in chunks(texts):
        ids, words = tokens(chunk)
        total.update(dict(zip(words, np.bincount(ids[ids >= 0], minlength=len(words)).tolist(), strict=True)))
    return total


def _moved(ranks: np.ndarray, by: int, gap: int) -> np.ndarray:
    """Each place's neighbour so many places before (after, if negative)."""
    out = np.full(len(ranks), gap, ranks.dtype)
    if abs(by) < len(ranks):
        if by > 0:
            out[by:] = ranks[:-by]
        else:
            out[:by] = ranks[-by:]
    return out


def fragments(ids: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fragments of a chunk, and how often each is there.

    rank: by word number, from 0 for the commonest; -1 for gaps.  A fragment
    is a row of 2 * LONGEST - 1 ranks with its pivot in the middle, and -1 where no
    n-gram of the pivot reaches.  Words before a pivot are commoner than it,
    words after it no rarer, so an n-gram is around the leftmost of its rarest words.
    """
    ranks = np.append(rank, np.int32(-1))[ids]
    gap = np.int32(np.iinfo(np.int32).max)
    kept = np.where(ranks < 0, gap, ranks).astype(np.int32)
    columns = {0: ranks}
    for side in (1, -1):
        fine = ranks >= 0
        for k in range(1, LONGEST):
            beside = _moved(kept, side * k, gap)
            fine = fine & ((beside < ranks) if side > 0 else (beside <= ranks))
            columns[-side * k] = np.where(fine, beside, np.int32(-1))
    some = np.flatnonzero((columns[-1] >= 0) | (columns[1] >= 0))
    rows = np.stack([columns[k][some] for k in range(1 - LONGEST, LONGEST)], axis=1)
    return _summed(rows, np.ones(len(rows), np.int64))


def _summed(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of numbers from -1 on, and the sums of their counts.

    A row becomes one number of 64 bits, column by column; where the next column wouldn't fit, the numbers so far are numbered anew.
    """
    if not len(rows):
        return rows, counts
    key, most = np.zeros(len(rows), np.int64), 1
    for k in range(rows.shape[1]):
        values = int(rows[:, k].max()) + 2
        if most * values >= 1 << 62:
            distinct, key = np.unique(key, return_inverse=True)
            most = len(distinct)
        key, most = key * values + rows[:, k] + 1, most * values
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    return rows[first], np.bincount(which, weights=counts, minlength=len(first)).astype(np.int64)


def mine(fragment: np.ndarray, counts: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, frequencies) of each length around the pivots of fragments, those of `least` occurrences or more."""
    middle = LONGEST - 1
    for n, spans in SPANS.items():
        rows, of = [], []
        for before, after in spans:
            has = (fragment[:, middle - before] >= 0) & (fragment[:, middle + after] >= 0)
            rows.append(fragment[has, middle - before : middle + after + 1])
            of.append(counts[has])
        found, total = _summed(np.concatenate(rows), np.concatenate(of))
        kept = total >= least
        yield found[kept], total[kept]


def _by_language(table) -> Iterator[tuple[str, list[bytes]]]:
    langs, texts = table["lang"].to_pylist(), encoded(table["text"])
    for lang in sorted(set(langs)):
        yield lang, [t for t, x in zip(texts, langs, strict=True) if x == lang]


def frequent_phrases(docs: DataFrame, least: int = 30, part_bytes: int = 8 << 20, bucket_bytes: int = 16 << 20, hot: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f), (lang, n)): the word sequences of 1 to LONGEST words that occur `least` times or more, and all words, of each language.

    A bucket gets the pivots of about bucket_bytes of text.  A pivot whose
    occurrences alone would be `hot` of a bucket is dealt to several by its
    fragments; their counts are added up afterwards.
    """
    import pyarrow as pa

    save = Saved(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    parts, buckets = max(1, math.ceil(size / part_bytes)), max(1, math.ceil(size / bucket_bytes))
    # Rows are dealt by their place in the input, whatever they hold: copies of one document are in all parts.
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int").alias("part")
    rows = docs.where("text IS NOT NULL").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    texts = save.bucketed(rows.select(part, "lang", "text"), "part", max(1, math.ceil(parts / 3)))

    def count(table):
        part, found = table["part"][0].as_py(), {"part": [], "lang": [], "word": [], "n": []}
        for lang, mine_ in _by_language(table):
            words = word_counts(mine_)
            words[b""] = sum(words.values())  # no word is empty: this is the number of all
            found["part"] += [part] * len(words)
            found["lang"] += [lang] * len(words)
            found["word"] += words.keys()
            found["n"] += words.values()
        return pa.table([pa.array(v, t) for v, t in zip(found.values(), (pa.int32(), pa.string(), pa.binary(), pa.int64()), strict=True)], names=list(found))

    counted = texts.groupBy("part").applyInArrow(count, "part int, lang string, word binary, n long")
    counted = counted.withColumn("f", F.sum("n").over(Window.partitionBy("lang", "word")))
    known = save(counted.where((F.col("f") >= least) | (F.octet_length("word") == 0)).select("part", "lang", "word", "f"))
    words = known.groupBy("lang", "word").agg(F.max("f").alias("f"))
    n_of = save(words.where("octet_length(word) = 0").select("lang", F.col("f").alias("n")))
    single = words.where("octet_length(word) > 0").select("lang", F.col("word").cast("string").alias("phrase"), F.lit(1).alias("words"), "f")
    # A word is hot by its share of all words of all languages: buckets hold about as many words each.
    most = max(1.0, hot * (n_of.agg(F.sum("n")).first()[0] or 0) / buckets)

    sent = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("hot", pa.bool_()), ("words", pa.list_(pa.binary())), ("fragments", pa.binary()), ("counts", pa.binary())])

    def send(table, known):
        if not table.num_rows:
            return sent.empty_table()
        out = []
        langs, words, f = known["lang"].to_pylist(), known["word"].to_pylist(), known["f"].to_pylist()
        for lang, mine_ in _by_language(table):
            # From the commonest on, ties by the word: every part puts the words that it has into the same order.
            order = sorted((-n, w) for x, w, n in zip(langs, words, f, strict=True) if x == lang and w)
            rank_of = {w: i for i, (_, w) in enumerate(order)}
            for chunk in chunks(mine_):
                ids, here = tokens(chunk)
                rank = np.array([rank_of.get(w, -1) for w in here], np.int32)
                fragment, counts = fragments(ids, rank)
                out += _packed(lang, fragment, counts, [w for _, w in order], np.array([-n for n, _ in order], np.int64), buckets, most)
        return pa.Table.from_pylist(out, sent)

    packed = texts.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(send, "lang string, bucket int, hot boolean, words array<binary>, fragments binary, counts binary")

    def count_phrases(table):
        lang, is_hot = table["lang"][0].as_py(), table["hot"][0].as_py()
        fragment, counts, words = _unpacked(table)
        found = {"phrase": [], "words": [], "f": []}
        for rows, total in mine(fragment, counts, 1 if is_hot else least):
            found["phrase"] += [b" ".join([words[i] for i in row]).decode("utf-8", "replace") for row in rows.tolist()]
            found["words"] += [rows.shape[1]] * len(rows)
            found["f"] += total.tolist()
        return pa.table([pa.array([lang] * len(found["f"]), pa.string()), pa.array(found["phrase"], pa.string()), pa.array(found["words"], pa.int32()), pa.array(found["f"], pa.int64())], names=["lang", *found])

    mined = packed.groupBy("lang", "bucket", "hot").applyInArrow(count_phrases, "lang string, phrase string, words int, f long")
    mined = mined.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    phrases = save(single.unionByName(mined))
    save.drop(texts, known)
    return phrases, n_of


def _packed(lang: str, fragment: np.ndarray, counts: np.ndarray, words: list[bytes], f: np.ndarray, buckets: int, most: float) -> list[dict]:
    """The fragments of a chunk by bucket, each with the words that it needs; numbers are into those."""
    import zlib

    if not len(fragment):
        return []
    pivot = fragment[:, LONGEST - 1]
    used = np.unique(pivot)
    place = np.zeros(len(words), np.int64)
    place[used] = [zlib.crc32(words[i]) for i in used.tolist()]
    shares = np.ceil(f / most).astype(np.int64)  # over how many buckets a pivot is dealt
    # By what stands beside it, told by words' hashes: the same fragment goes to the same bucket from everywhere.
    hot = shares[pivot] > 1
    salt = np.zeros(len(fragment), np.int64)
    if hot.any():
        hashes = np.array([*map(zlib.crc32, words), 0], np.uint64)
        factors = np.random.PCG64(11).random_raw(2 * LONGEST - 1).astype(np.uint64) | np.uint64(1)
        mixed = (hashes[fragment[hot]] * factors).sum(axis=1, dtype=np.uint64) >> np.uint64(33)
        salt[hot] = mixed.astype(np.int64) % shares[pivot[hot]]
    bucket = (place[pivot] + salt) % buckets
    order = np.lexsort((hot, bucket))
    key = (bucket * 2 + hot)[order]
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        rows = fragment[order[a:b]]
        own, number = np.unique(rows, return_inverse=True)
        own = own[own >= 0]
        number = number.reshape(rows.shape) - (1 if (rows < 0).any() else 0)
        kind = np.dtype("<i2") if len(own) < 1 << 15 else np.dtype("<i4")
        # Column by column: most of an outer column is -1 and takes next to nothing once compressed.
        out.append({"lang": lang, "bucket": int(key[a] // 2), "hot": bool(key[a] % 2), "words": [words[i] for i in own.tolist()], "fragments": number.T.astype(kind).tobytes(), "counts": counts[order[a:b]].astype("<u4").tobytes()})
    return out


def _unpacked(table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The distinct fragments of a bucket with their counts, as numbers into one list of words."""
    lists = table["words"].combine_chunks()
    coded = lists.flatten().dictionary_encode()
    words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int32)
    rows, counts, begin = [], [], 0
    for own, raw, n in zip(lists.value_lengths().to_pylist(), table["fragments"].to_pylist(), table["counts"].to_pylist(), strict=True):
        counts.append(np.frombuffer(n, "<u4").astype(np.int64))
        kind = np.dtype("<i2") if own < 1 << 15 else np.dtype("<i4")
        number = np.append(at[begin : begin + own], np.int32(-1))[np.frombuffer(raw, kind).reshape(2 * LONGEST - 1, -1).T]
        rows.append(number)
        begin += own
    return np.concatenate(rows), np.concatenate(counts), words


def _cuts(rows: DataFrame) -> DataFrame:
    """(lang, phrase, a, k, first, rest): a row for each cut of a phrase of two words or more."""
    word = F.split("phrase", " ")
    parts = lambda k: F.struct(k.alias("k"), F.concat_ws(" ", F.slice(word, F.lit(1), k)).alias("first"), F.concat_ws(" ", F.slice(word, k + 1, F.lit(LONGEST))).alias("rest"))
    return rows.select("lang", "phrase", F.col("f").alias("a"), F.inline(F.transform(F.sequence(F.lit(1), F.col("words") - 1), parts)))


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words or more: floor(2000000 a / (l + r)) of the cut where that is lowest."""
    f = phrases.select("lang", F.col("phrase").alias("part"), "f")
    cuts = _cuts(phrases.where("words > 1"))
    cuts = cuts.join(f.withColumnsRenamed({"part": "first", "f": "l"}), ["lang", "first"]).join(f.withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"])
    score = F.expr("CAST(2000000 AS DECIMAL(20, 0)) * CAST(a AS DECIMAL(18, 0)) div CAST(l + r AS DECIMAL(20, 0))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def covered(phrases: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase): phrases that lie in a longer one with percent/100 of their frequency or more."""
    word = F.split("phrase", " ")
    inner = lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.concat_ws(" ", F.slice(word, i, n)))
    every = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), inner))
    longer = phrases.where("words > 2").select("lang", F.explode(every).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    return longer.join(phrases.select("lang", "phrase", "f"), ["lang", "phrase"]).where(F.col("within").cast("decimal(20,0)") * 100 >= F.col("f").cast("decimal(20,0)") * percent).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = 30, percent: int = 80, top: int = 2000, **more) -> DataFrame:
    """The `top` collocations of each language of docs(text, lang, ...): lang, rank, phrase, a, l, r, n, score.

    Words are runs without spaces and tabs within pieces that end at .,;:!? and
    line ends, A-Z lower-cased.  Candidates are sequences of 2 to LONGEST
    words that occur a >= least times; see scored() for the score, covered() for those
    that are dropped.  Ties of the score go to the larger a, then to the
    phrase that is first in byte order; l and r are the frequencies of the two
    parts of the lowest cut, n that of all words.

    Null text has no words; a null lang counts as `und`, together with that; rows
    that repeat count as often as they are there; a language without candidates
    and an empty table give no rows; further columns aren't read.
    """
    phrases, n_of = frequent_phrases(docs, least, **more)
    kept = scored(phrases).join(covered(phrases, percent), ["lang", "phrase"], "left_anti")
    best = (F.desc("score"), F.desc("a"), "phrase")
    # The best of each share first, so no task sorts a language's phrases.
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    kept = kept.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return kept.join(n_of, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
