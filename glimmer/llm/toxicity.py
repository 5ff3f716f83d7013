"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its labels.

Voters look at hits of a lexicon and at patterns.  The lexicon is mined from
labelled documents: word beginnings that are far commoner in toxic ones,
counted over all of them; of more than LEXICON such, those that a ratio test
is surest of.  The label model is generative: the class draws the
votes (toxic, clean or none), each voter's by a table of its own (its accuracy)
or, where two voters agree beyond what the class explains, by a table given the
class and the other's vote (their correlation).  Such pairs form a tree, the
one that explains most; tables, tree and the class of each document are
estimated together by expectation-maximisation, beginning with the majority of
the votes.  A logistic regression learns the posterior labels.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.tables import Saved
from glimmer.llm.text import PIECE, U64, Hasher, batches, mix, pieces

#: Lengths in bytes of the word beginnings; 0 is the whole word.
STEMS = (0, 3, 4, 5, 6, 7, 8)
#: Documents that the label model and the classifier see, and banks of the lexicon, at most.
SAMPLE, BANKS = 20_000, 12
#: A word beginning is toxic if it is in so many toxic documents, so many times commoner there, and a likelihood ratio test
#: against equal shares passes (chi squared of one degree of freedom, 0.001), whatever the number of documents.
LEAST_DOCUMENTS, LIFT, SURE = 4, 20.0, 10.83
#: Word beginnings of the lexicon at most, a parameter of the model's size (2 MB): those that the ratio test is surest of.
LEXICON = 1 << 18
#: Bits of the table that tells which word beginnings to count in clean documents.
TABLE_BITS = 22
MEASURES = ("words", "hits", "kinds", "marks", "capitals", "lines")
#: A Bloom filter of the labelled documents' ids: bits for each id, and bits at most (2 MB).
BLOOM_EACH, BLOOM_BITS = 16, 1 << 24
#: Mutual information, in nats given the class, from which on two voters' correlation is a parameter.
CORRELATED = 0.02


def slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(64 - TABLE_BITS)).astype(np.int64)


@functools.cache
def _upper() -> np.ndarray:
    """Whether each code point is an upper-case character."""
    return np.fromiter((chr(i).isupper() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def capitals_in(text: str) -> int:
    """The upper-case characters of the whole text, counted a piece at a time."""
    return sum(int(_upper()[np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "replace"), "<u4")].sum()) for at in range(0, len(text), PIECE))


class Reader:
    """Reads hits of a lexicon and other measures off texts."""

    def __init__(self, lexicon: np.ndarray | None = None) -> None:
        self.hasher = Hasher()
        self.hasher.space = np.ones(256, bool)
        self.hasher.space[[*range(97, 123), *range(128, 256)]] = False
        self.lexicon = np.unique(lexicon) if lexicon is not None else np.zeros(0, U64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.lexicon >> U64(44)).astype(np.int64)] = True

    def stems(self, texts: list[bytes], lengths=STEMS):
        """(texts' numbers, words' numbers, hashes) of the words' beginnings; a word of fewer bytes than a length has none of it."""
        words = 0
        for first, buf, edges in pieces(texts):
            starts, ends = self.hasher.bounds(buf)
            owner = first + np.searchsorted(edges, starts, side="right") - 1
            prefix, number = self.hasher.prefix(buf), words + np.arange(len(starts))
            for n in lengths:
                ok = np.flatnonzero(ends - starts >= n)
                end = starts[ok] + n if n else ends[ok]
                yield owner[ok], number[ok], self.hasher.span(prefix, starts[ok], end) ^ mix(np.array([n + 1], U64))[0]
            words += len(starts)

    def measure(self, texts: list[str]) -> np.ndarray:
        """One row for each text: MEASURES, and the hits of each bank."""
        n = len(texts)
        out = np.zeros((n, len(MEASURES) + BANKS))
        found = []
        for owner, number, hashes in self.stems([t.lower().encode("utf-8", "replace") for t in texts]):
            at = np.flatnonzero(self.filter[(hashes >> U64(44)).astype(np.int64)])
            if len(at):
                place = np.minimum(np.searchsorted(self.lexicon, hashes[at]), len(self.lexicon) - 1)
                at = at[self.lexicon[place] == hashes[at]]
            found.append((owner[at], number[at], hashes[at]))
        owner, number, hashes = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64))
        # A word is hit once, by the longest of its beginnings: those come last.
        order = np.lexsort((np.arange(len(number)), number))
        last = np.ones(len(order), bool)
        last[:-1] = number[order][1:] != number[order][:-1]
        at = order[last]
        out[:, 1] = np.bincount(owner[at], minlength=n)
        for i in np.unique(owner[at]).tolist():
            mine = hashes[at][owner[at] == i]
            out[i, 2] = len(np.unique(mine))
        banks = len(MEASURES) + (mix(hashes[at]) % U64(BANKS)).astype(np.int64)
        np.add.at(out, (owner[at], banks), 1)
        for i, t in enumerate(texts):
            out[i, 0], out[i, 3], out[i, 5] = len(t.split()), t.count("!"), t.count("\n") + 1
            out[i, 4] = capitals_in(t) / max(1, len(t))
        return out


def votes(m: np.ndarray) -> np.ndarray:
    """1 for toxic, -1 for clean, 0 for none: one column a voter."""
    words, hits, kinds, marks, capitals, lines = m[:, : len(MEASURES)].T
    dense = hits / np.maximum(words, 1)
    columns = [np.where(hits >= 2, 1, -1), np.where(kinds >= 2, 1, np.where(kinds == 0, -1, 0))]
    columns += [np.where((dense > 0.01) & (hits > 1), 1, np.where(dense == 0, -1, 0))]
    columns += [np.where(marks >= 5, 1, 0), np.where((marks == 0) & (hits == 0), -1, 0), np.where(capitals > 0.5, 1, 0), np.where((lines > 3) & (hits < 2), -1, 0)]
    columns += [np.where(bank > 1, 1, 0) for bank in m[:, len(MEASURES) :].T]
    return np.stack(columns, axis=1).astype(np.int8)


def features(m: np.ndarray) -> np.ndarray:
    words, hits, kinds, marks, capitals, lines = m[:, : len(MEASURES)].T
    steps = [hits >= n for n in (1, 2, 3, 5)] + [kinds >= n for n in (1, 2, 3)]
    rest = [np.log1p(hits), hits / np.maximum(words, 1), np.log1p(words), np.log1p(marks), capitals, np.log1p(lines)]
    return np.stack([np.ones(len(m)), *map(np.asarray, steps), *rest, *np.minimum(m[:, len(MEASURES) :].T, 2)], axis=1).astype(float)


class LabelModel:
    """p(class, votes) = p(class) x the product of p(vote | class), or of p(vote | class, the vote of the voter's parent).

    `tables[class, voter, vote + 1]` are the voters' own distributions;
    `parents` is the tree of correlated voters (-1: none); and
    `joint[voter, class, parent's vote + 1, vote + 1]` are the distributions
    given the parent.
    """

    def __init__(self, v: np.ndarray, prior: float, rounds: int = 15) -> None:
        self.prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
        # Where the estimation begins: the majority of the votes, those of voters that vote alike counting together.
        spread = np.sqrt(v.var(axis=0)) + 1e-9
        alike = (v - v.mean(axis=0)).T @ (v - v.mean(axis=0)) / len(v) / np.outer(spread, spread)
        weight = 1 / (1 + (alike**2).sum(axis=1) - np.diag(alike) ** 2)
        p = np.clip(0.5 + v @ weight / (2 * np.maximum((v != 0) @ weight, 1e-9)), 0.02, 0.98)
        one_hot = (v[:, :, None] == np.array([-1, 0, 1])).reshape(len(v), -1).astype(float)
        n = v.shape[1]
        for _ in range(rounds):
            counts = np.stack([(one_hot * q[:, None]).T @ one_hot for q in (1 - p, p)]).reshape(2, n, 3, n, 3)
            own = np.stack([[counts[y, j, :, j, :].diagonal() for j in range(n)] for y in (0, 1)])
            self.tables = (own + 0.5) / (own + 0.5).sum(axis=2, keepdims=True)
            self.parents, self.information = self._tree(counts)
            self.joint = np.empty((n, 2, 3, 3))
            for j, parent in enumerate(self.parents):
                # A pair of votes that isn't seen falls back on the voter's own distribution.
                given = (counts[:, parent, :, j, :] if parent >= 0 else 0) + 0.5 * self.tables[:, j, None, :]
                self.joint[j] = given / given.sum(axis=2, keepdims=True)
            p = self.posterior(v)

    @staticmethod
    def _tree(counts: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Each voter's parent in the tree with the most mutual information given the class, and that of all pairs."""
        n = counts.shape[1]
        share = (counts.transpose(0, 1, 3, 2, 4) + 1e-3) / (counts.sum() / n**2 + 18e-3)  # class, voter, voter, votes
        alone, other, whole = share.sum(axis=4, keepdims=True), share.sum(axis=3, keepdims=True), share.sum(axis=(3, 4), keepdims=True)
        information = (share * np.log(share * whole / (alone * other))).sum(axis=(0, 3, 4))
        parents, done = [-1] * n, [0]
        while len(done) < n:  # Prim's algorithm
            rest = [j for j in range(n) if j not in done]
            i, j = max(((i, j) for i in done for j in rest), key=lambda x: information[x])
            parents[j] = i if information[i, j] > CORRELATED else -1
            done.append(j)
        return parents, information

    def posterior(self, v: np.ndarray) -> np.ndarray:
        at = v.astype(np.int64) + 1
        total = np.full(len(v), np.log(self.prior / (1 - self.prior)))
        for j, parent in enumerate(self.parents):
            odds = np.log(self.joint[j, 1] / self.joint[j, 0])
            total += odds[at[:, parent], at[:, j]] if parent >= 0 else np.log(self.tables[1, j] / self.tables[0, j])[at[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def regress(x: np.ndarray, p: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method; the first column is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(penalty), x.T @ (p - q) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, lexicon: np.ndarray, weights: np.ndarray, label_model: LabelModel | None) -> None:
        self.lexicon, self.weights, self.label_model = lexicon, weights, label_model


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labelled(text, toxic): 1 and 0 in toxic; others and null don't count, null text is empty.

    The lexicon is mined over all rows; the label model and the classifier see
    about `sample` of them, equal texts once.  With no toxic or no clean row
    the lexicon is empty.
    """
    import pyarrow as pa

    save = Saved(labelled.sparkSession)
    rows = save(labelled.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1)"))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)

    def count(wanted):
        def run(parts):
            reader, held = Reader(), []
            for batch in batches(parts):
                texts = [t.lower().encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
                found = [np.zeros((2, 0), U64)]
                for owner, _, hashes in reader.stems(texts):
                    at = slice(None) if wanted is None else wanted.value[slot(hashes)]
                    found.append(np.stack([owner[at].astype(U64), hashes[at]]))
                both = np.concatenate(found, axis=1)
                order = np.lexsort(both)
                both = both[:, order]
                new = np.ones(both.shape[1], bool)
                new[1:] = (both[:, 1:] != both[:, :-1]).any(axis=0)
                held.append(np.unique(both[1, new], return_counts=True))
                if sum(len(h) for h, _ in held) > 1 << 20:
                    held = [_merged(held)]
            if held:
                hashes, n = _merged(held)
                for i in range(0, len(hashes), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[i : i + (1 << 16)].view(np.int64)), pa.array(n[i : i + (1 << 16)])], ["stem", "n"])

        return run

    def slots(parts):
        marked = np.zeros(1 << TABLE_BITS, bool)
        for batch in parts:
            marked[slot(batch.column("stem").to_numpy().view(U64))] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(marked))], ["slot"])

    mined = np.zeros(0, U64)
    if toxic and clean:
        # What is too rare among toxic documents even if no clean one has it needs no count there.
        least = max(LEAST_DOCUMENTS, LIFT * 0.5 * toxic / clean)
        top = save(rows.where("toxic = 1").mapInArrow(count(None), "stem long, n long").groupBy("stem").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
        marked = np.zeros(1 << TABLE_BITS, bool)
        marked[top.mapInArrow(slots, "slot long").distinct().toArrow()["slot"].to_numpy()] = True  # the table's slots at most
        wanted = labelled.sparkSession.sparkContext.broadcast(marked)
        other = rows.where("toxic = 0").mapInArrow(count(wanted), "stem long, n long").groupBy("stem").agg(F.sum("n").alias("m"))
        both = top.join(other, "stem", "left").select("stem", "n", F.coalesce("m", F.lit(0)).alias("m"))
        share, n, m = toxic / (toxic + clean), F.col("n"), F.col("m")
        ratio = 2 * (n * F.log(n / ((n + m) * share)) + F.when(m > 0, m * F.log(m / ((n + m) * (1 - share)))).otherwise(0.0))
        both = both.where((n / toxic >= LIFT * (m + 0.5) / clean) & (ratio >= SURE))
        surest = both.orderBy(ratio.desc(), "stem").limit(LEXICON)
        mined = surest.select("stem").toArrow()["stem"].to_numpy().view(U64)
        save.drop(top)
    lexicon = labelled.sparkSession.sparkContext.broadcast(mined)

    def read(parts):
        reader = Reader(lexicon.value)
        for batch in batches(parts):
            m = reader.measure(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([x.tobytes() for x in m], pa.binary())], ["toxic", "measures"])

    share = int((1 << 40) * min(1.0, sample / max(1, toxic + clean)))
    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < share).groupBy("text").agg(F.max("toxic").alias("toxic"))
    seen = drawn.mapInArrow(read, "toxic int, measures binary").collect()
    save.drop(rows)
    if not seen:
        return Model(mined, np.array([-1.0]), None)
    m = np.stack([np.frombuffer(r["measures"]) for r in seen])
    model = LabelModel(votes(m), toxic / max(1, toxic + clean))
    return Model(mined, regress(features(m), model.posterior(votes(m))), model)


def _merged(held):
    hashes, where = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
    return hashes, np.bincount(where, np.concatenate([n for _, n in held]), len(hashes)).astype(np.int64)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 where score >= 0.5) to docs(text, ...); null text is empty and gets a score too.

    Columns of these names that docs has are replaced.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    rows = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.weights))

    def run(parts):
        lexicon, weights = shared.value
        reader = Reader(lexicon)
        for batch in batches(parts):
            x = features(reader.measure([t or "" for t in batch.column("text").cast("string").to_pylist()]))
            p = 1 / (1 + np.exp(-np.clip(x[:, : len(weights)] @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def labelled_only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, ...) that a Bloom filter of ids(doc_id) lets pass: all whose doc_id is among them, and some others.

    The filter is a table of words of 64 bits, at most BLOOM_BITS in all
    whatever the number of ids, so it is broadcast; a join after it moves
    hardly more than the rows it keeps.
    """
    n = ids.count()
    bits = min(BLOOM_BITS, 1 << max(10, (BLOOM_EACH * n).bit_length()))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits))
    word, bit = F.shiftright(place, 6).alias("bloom_word"), (place % 64).cast("int").alias("bloom_bit")
    table = ids.select(word, bit).groupBy("bloom_word").agg(F.bit_or(F.expr("shiftleft(1L, bloom_bit)")).alias("bloom_bits"))
    found = docs.select(F.struct(*docs.columns).alias("row"), word, bit).join(F.broadcast(table), "bloom_word")
    return found.where(F.getbit("bloom_bits", "bloom_bit") == 1).select("row.*")


def predict_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of docs(doc_id, text), learned from labels(doc_id, toxic) of rows whose crc32(doc_id) mod 5 is not 0.

    A document with several labels is toxic if one says so; a row with a null
    doc_id isn't learned from, and its held_out is false.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    known = labels.where(F.col("doc_id").isNotNull() & ~held).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic IS NOT NULL")
    save = Saved(docs.sparkSession)
    known = save(known)
    texts = labelled_only(docs.select("doc_id", "text").where("doc_id IS NOT NULL"), known)
    # By a shuffle at every size, as the labels grow with the documents.
    model = learn(texts.join(known.hint("shuffle_merge"), "doc_id").select("text", "toxic"))
    save.drop(known)
    return score(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
