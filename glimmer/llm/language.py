"""Language identification: a linear-chain conditional random field over the words of a text.

Every word gets a label by forward-backward, so text that switches between
languages is labelled piece by piece; a document's language is the one with the
largest sum of its words' probabilities.

A word's features are the byte n-grams (2 to 4) of the lower-cased word between
separators; those that touch a separator are its affixes.  A lexicon adds how
much more frequent the word is in one language than in the others.
The lexicon is counted over all labelled documents, in a hash table of fixed
size; the weights and the transitions are fitted on a bounded sample of word
windows.  The labels of documents are those of their words at first; then the
words are labelled anew by what was learned, and it is learned again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.tables import Shared
from glimmer.llm.text import U64, Hasher, batches, pieces

#: Entries of the lexicon and of the weights for each n-gram length; documents of a language and words of a window in the training sample.
LEXICON_BITS, GRAM_BITS, SAMPLE, WINDOW = 16, 16, 600, 64
#: Words that are chained before their ends are joined, so that long texts take as many steps as short ones.
CHAIN = 64
#: The lexicon has words that were counted this often.
LEAST_COUNT = 20
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_SALT = (0, 0x9E3779B1, 0x85EBCA77)


def lowered(texts: list[str]) -> list[bytes]:
    return [t.lower().encode("utf-8", "replace") for t in texts]


class Features:
    """What the field sees of words."""

    def __init__(self) -> None:
        self.hasher = Hasher()
        self.closing = np.zeros(256, bool)
        self.closing[list(b".,;:!?\"')]")] = True
        self.lettered = np.zeros(256, bool)
        self.lettered[[*range(97, 123), *range(128, 256)]] = True

    def words(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(number of the first text, bytes with single separators kept, starts, ends, words of each text) of pieces."""
        for first, buf, edges in pieces(texts):
            starts, ends = self.hasher.bounds(buf)
            yield first, buf, starts, ends, np.diff(np.searchsorted(starts, edges))

    def slots(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each word's place in the lexicon; closing marks don't count."""
        last = np.maximum(ends - 1, 0)
        ends = np.where((ends - starts > 1) & self.closing[buf[last]], ends - 1, ends)
        return (self.hasher.span(self.hasher.prefix(buf), starts, ends) >> U64(64 - LEXICON_BITS)).astype(np.int64)

    def grams(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions' slots of 2-, 3- and 4-grams (-1: none), shape (3, positions); where each word's positions begin; those of no word come before the first."""
        text = buf.copy()
        text[self.hasher.space[buf]] = 32
        text = np.concatenate([np.array([32], np.uint8), text, np.array([32] * 4, np.uint8)]).astype(np.uint32)
        n = len(buf) + 1  # position p stands before byte p - 1 of buf; a word's positions go from the separator before it to its last byte
        limit = np.zeros(n, np.int64)  # the separator after the word that a position belongs to
        at = np.zeros(n + 1, np.int64)
        at[starts] += 1
        at[ends + 1] -= 1
        inside = np.cumsum(at)[:n] > 0
        which = np.cumsum(np.bincount(starts, minlength=n)[:n]) - 1
        limit[inside] = (ends + 1)[which[inside]]
        here = np.arange(n)
        out = np.full((3, n), -1, np.int64)
        code = text[:n] << 8 | text[1 : n + 1]
        for i in range(3):
            ok = inside & (here + i + 1 <= limit)
            slot = code if i == 0 else ((code ^ np.uint32(_SALT[i])) * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)
            out[i][ok] = slot[ok].astype(np.int64) + (i << GRAM_BITS)
            code = code << 8 | text[i + 2 : n + i + 2]
        return out, starts, inside


class Field:
    """The trained field: labels, weights (n-gram slots x labels), lexicon (slots x labels), its weight, transitions."""

    def __init__(self, labels: list[str], lexicon: np.ndarray) -> None:
        s = len(labels)
        self.labels, self.lexicon = labels, lexicon.astype(np.float32)
        self.weights = np.zeros((3 << GRAM_BITS, s), np.float32)
        self.trust, self.step = 0.5, np.eye(s) * 2.0

    def emissions(self, features: Features, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of all words of all texts, the number of words of each text, and whether a word has a letter."""
        scores, lettered, counts = [], [], np.zeros(len(texts), np.int64)
        for first, buf, starts, ends, each in features.words(texts):
            counts[first : first + len(each)] += each
            if not len(starts):
                continue
            slots, begins, _ = features.grams(buf, starts, ends)
            sums = np.zeros((slots.shape[1], len(self.labels)), np.float32)
            for row in slots:
                ok = np.flatnonzero(row >= 0)
                sums[ok] += self.weights[row[ok]]
            scores.append(np.add.reduceat(sums, begins, axis=0) + self.trust * self.lexicon[features.slots(buf, starts, ends)])
            lettered.append(np.add.reduceat(features.lettered[buf].astype(np.int32), starts) > 0)
        s = len(self.labels)
        return (np.concatenate(scores) if scores else np.zeros((0, s), np.float32)), counts, (np.concatenate(lettered) if lettered else np.zeros(0, bool))


def forward_backward(scores: np.ndarray, counts: np.ndarray, step: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """The probability of each label for each word, exactly, given the whole text it is in.

    pairs, if given, gets the expected numbers of neighbouring labels within chains added.

    Texts are cut into chains of CHAIN words.  A chain's product of step
    matrices joins what comes before it to what comes after; with the ends
    known, all chains go forward and backward at once.
    """
    n, s = scores.shape
    if not n:
        return np.zeros((0, s))
    e = np.exp(scores.astype(np.float64) - scores.max(axis=1, keepdims=True)) + 1e-30
    a = np.exp(step - step.max())
    chains = -(-counts // CHAIN)
    total, first = int(chains.sum()), np.cumsum(chains) - chains
    doc = np.repeat(np.arange(len(counts)), chains)
    number = np.arange(total) - first[doc]
    begin = (np.cumsum(counts) - counts)[doc] + number * CHAIN
    size = np.minimum(CHAIN, counts[doc] - number * CHAIN)
    long = np.flatnonzero(chains[doc] > 1)
    product = np.tile(np.eye(s), (len(long), 1, 1))
    steps = int(size.max())
    for t in range(steps if len(long) else 0):
        some = np.flatnonzero(size[long] > t)
        now = (product[some].reshape(-1, s) @ a).reshape(-1, s, s) * e[begin[long[some]] + t][:, None, :]
        product[some] = now / now.max(axis=(1, 2), keepdims=True)
    index = np.full(total, -1)
    index[long] = np.arange(len(long))
    head, tail = np.full((total, s), 1.0 / s), np.ones((total, s))
    most = int(chains.max())
    for k in range(1, most):
        mine = first[chains > k] + k
        head[mine] = _scaled(np.einsum("ni,nij->nj", head[mine - 1], product[index[mine - 1]]))
        back = (first + chains - 1 - k)[chains > k]
        tail[back] = _scaled(np.einsum("nij,nj->ni", product[index[back + 1]], tail[back + 1]))
    out = np.empty((n, s))
    forward = head
    for t in range(steps):
        some = np.flatnonzero(size > t)
        forward[some] = _scaled((forward[some] @ a) * e[begin[some] + t])
        out[begin[some] + t] = forward[some]
    backward = tail
    for t in range(steps - 1, -1, -1):
        some = np.flatnonzero(size > t)
        out[begin[some] + t] *= backward[some]
        ahead = backward[some] * e[begin[some] + t]
        if pairs is not None and t:
            joint = out[begin[some] + t - 1][:, :, None] * a * ahead[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        backward[some] = _scaled(ahead @ a.T)
    return out / out.sum(axis=1, keepdims=True)


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.max(axis=1, keepdims=True)


def fit(field: Field, windows: list[bytes], labels: np.ndarray, rounds: int = 2, epochs: int = 20, rate: float = 0.1, decay: float = 1e-4) -> Field:
    """Maximum likelihood of the windows' word labels by Adam on exact gradients; later rounds take the words' labels from the field itself."""
    features, s = Features(), len(field.labels)
    slots, word, sizes, lexical = [], [], [], []
    at = 0
    for i in range(0, len(windows), 256):
        for _, buf, starts, ends, each in features.words(windows[i : i + 256]):
            grams, begins, inside = features.grams(buf, starts, ends)
            owner = np.cumsum(np.bincount(begins, minlength=grams.shape[1])[: grams.shape[1]]) - 1 + at
            for row in grams:
                ok = np.flatnonzero(row >= 0)
                slots.append(row[ok])
                word.append(owner[ok])
            lexical.append(field.lexicon[features.slots(buf, starts, ends)])
            sizes.append(each)
            at += len(starts)
    if not at:
        return field
    slots, word, counts = np.concatenate(slots), np.concatenate(word), np.concatenate(sizes)
    lexical = np.concatenate(lexical).astype(np.float64)
    order = np.argsort(slots, kind="stable")
    used, begins = np.unique(slots[order], return_index=True)
    by_slot = word[order]
    target = np.eye(s)[np.repeat(labels, counts)]
    weights = np.zeros((len(used), s))
    place = np.searchsorted(used, slots)
    by_word = np.argsort(word, kind="stable")
    place, word_starts = place[by_word], np.searchsorted(word[by_word], np.arange(at))
    ends = np.cumsum(counts)
    follows = np.ones(at, bool)
    follows[(ends - counts)[counts > 0]] = False  # words with one before them
    parameters = [weights, np.array([field.trust]), field.step.copy()]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in parameters]
    time = 0
    for round_ in range(rounds):
        for _ in range(epochs):
            weights, trust, step = parameters
            scores = np.add.reduceat(weights[place], word_starts, axis=0) + trust[0] * lexical
            joint = np.zeros((s, s))
            p = forward_backward(scores, counts, step, joint)
            off = (target - p) / at
            seen = np.einsum("ni,nj->ij", target[np.flatnonzero(follows) - 1], target[follows])
            gradients = [np.add.reduceat(off[by_slot], begins, axis=0) - decay * weights / 100, np.array([(off * lexical).sum()]), (seen - joint) / at - decay * step]
            time += 1
            for q, g, m in zip(parameters, gradients, moments, strict=True):
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.01 * (g * g - m[1])
                q += rate * (m[0] / (1 - 0.9**time)) / (np.sqrt(m[1] / (1 - 0.99**time)) + 1e-9)
        if round_ + 1 < rounds:
            weights, trust, step = parameters
            p = forward_backward(np.add.reduceat(weights[place], word_starts, axis=0) + trust[0] * lexical, counts, step)
            target = np.eye(s)[p.argmax(axis=1)]
    field.weights[used], field.trust, field.step = parameters[0], float(parameters[1][0]), parameters[2]
    return field


def window(text: bytes, seed: int) -> bytes:
    """WINDOW consecutive words from a place that the seed names."""
    words = text.split()
    at = seed % max(1, len(words) - WINDOW + 1)
    return b" ".join(words[at : at + WINDOW])


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Field | None:
    """The field from labelled(text, lang): the lexicon from all of it, the rest from about `sample` windows a language.

    Rows with a null text or label don't count; None if there are no others.
    """
    import pyarrow as pa

    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return None
    labels = sorted(sizes)
    number = {lang: i for i, lang in enumerate(labels)}

    def count(parts):
        features, held = Features(), {}
        for batch in batches(parts):
            langs = batch.column("lang").to_pylist()
            texts = lowered(batch.column("text").to_pylist())
            for lang in set(langs):
                total = held.setdefault(lang, np.zeros(1 << LEXICON_BITS, np.int64))
                for _, buf, starts, ends, _ in features.words([t for t, own in zip(texts, langs, strict=True) if own == lang]):
                    total += np.bincount(features.slots(buf, starts, ends), minlength=len(total))
        for lang, total in held.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([number[lang]] * len(at), pa.int32()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "slot", "n"])

    counts = np.zeros((1 << LEXICON_BITS, len(labels)))
    found = rows.mapInArrow(count, "lang int, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()  # a row a slot and language at most
    counts[found["slot"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
    odds = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(counts)))
    lexicon = np.clip(odds - odds.mean(axis=1, keepdims=True), -5, 5) * (counts.sum(axis=1, keepdims=True) >= LEAST_COUNT)

    share = F.create_map(*[F.lit(x) for lang in labels for x in (lang, int((1 << 40) * min(1.0, sample / sizes[lang])))])
    draw = F.xxhash64("text")

    def cut(parts):
        for batch in batches(parts):
            texts = [window(t, h) for t, h in zip(lowered(batch.column("text").to_pylist()), batch.column("h").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("lang"), pa.array(texts, pa.binary())], ["h", "lang", "text"])

    some = rows.withColumn("h", F.pmod(draw, F.lit(1 << 40))).where(F.col("h") < share[F.col("lang")])
    drawn = sorted((r["h"], r["lang"], bytes(r["text"])) for r in some.select("h", "lang", "text").dropDuplicates(["h"]).mapInArrow(cut, "h long, lang string, text binary").collect())
    return fit(Field(labels, lexicon), [t for _, _, t in drawn], np.array([number[lang] for _, lang, _ in drawn], np.int64))


def identify(docs: DataFrame, field: Field | None, spans: bool = False) -> DataFrame:
    """Adds lang_pred and score (and with spans, lang_spans) to docs(text, ...).

    A document's language has the largest share of its words' probabilities,
    over words with a letter; the score is that share.  A text that is null or
    has no letter is `und` with score 0, as is every text if there is no
    field.  lang_spans lists runs of words of one language: array of (start,
    end, lang), in words.  Columns of these names that docs has are replaced.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    names = ["lang_pred", "score"] + ["lang_spans"] * spans
    rows = docs.drop(*names)
    shared = Shared(docs.sparkSession, field)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(parts):
        features, field = Features(), shared.get()
        for batch in batches(parts):
            texts = [t or "" for t in batch.column("text").cast("string").to_pylist()]
            known = [field is not None and bool(_LETTER.search(t)) for t in texts]
            labels, scores, runs = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            if any(known):
                emitted, counts, lettered = field.emissions(features, lowered(texts))
                p = forward_backward(emitted, counts, field.step)
                ends = np.cumsum(counts)
                sums = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p * lettered[:, None], axis=0)])
                sums = sums[ends] - sums[ends - counts]
                best = sums.argmax(axis=1)
                shares = sums.max(axis=1) / np.maximum(sums.sum(axis=1), 1e-12)
                word = p.argmax(axis=1)
                for i in np.flatnonzero(known).tolist():
                    labels[i], scores[i] = field.labels[best[i]], min(1.0, float(shares[i]))
                    if spans:
                        mine = word[ends[i] - counts[i] : ends[i]]
                        at = [0, *(np.flatnonzero(np.diff(mine)) + 1).tolist(), len(mine)]
                        runs[i] = [{"start": a, "end": b, "lang": field.labels[mine[a]]} for a, b in zip(at, at[1:], strict=False) if b > a]
            more = [pa.array(labels, pa.string()), pa.array(scores, pa.float64())] + [pa.array(runs, span)] * spans
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])

    kinds = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if spans:
        kinds.append(T.StructField("lang_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *kinds]))


def predict_held_out(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of docs(doc_id, text, lang): learned from rows whose crc32(doc_id) mod 4 is not 2.

    A row with a null doc_id is held out of learning, though its held_out is false.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    field = learn(docs.where(F.col("doc_id").isNotNull() & ~held))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), field).select("doc_id", "held_out", "lang_pred", "score")
