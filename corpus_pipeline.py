"""The corpus pipeline: language identification, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next one's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.llm import language, lines, minhash, mixing, packing
from glimmer.llm.registry import tokenizer_path
from glimmer.llm.tables import Saved, documents, own_tables_dropped

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document stays whose language has at least this share of its words.
LEAST_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those in which no language has half of the words; fills in a null lang."""
    found = language.identify(docs.select(*COLUMNS), language.learn(docs))
    stay = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return stay.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that repeat earlier ones; a document that has no word left goes."""
    left = lines.dedup_lines(docs, carry=("lang", "source")).withColumnRenamed("kept", "text")
    return left.where(F.col("text").rlike(mixing.WORD)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near-duplicates."""
    found = minhash.near_duplicates(docs).where("kept").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's share of words, repeating documents up to three times, in shuffled shards."""
    mixed = mixing.mix(docs.select(*COLUMNS))
    return mixed.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenizes and packs the documents into sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language identification is a trained model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again, and what only it needs is dropped then."""
    save, docs, before = Saved(spark), documents(spark, sf_dir), []
    for _, stage in STAGES[:-1]:
        with own_tables_dropped(spark):
            docs = save(stage(spark, docs, sf_dir))
        save.drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
