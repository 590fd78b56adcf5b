"""Corpus pipeline: from raw documents to packed training sequences.

STAGES run in order; each takes (spark, docs, sf_dir), is written as Parquet below the
shared folder and is read again as the documents of the next one. All but the last return
the columns of documents.

Every stage takes null and empty texts, null ids and other columns, repeated rows and empty
tables; what it does with them is said below. Ties don't occur or are decided by hashes of
ids and texts, so a rerun gives the same rows. Extra columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm import mixing, ngram_jaccard, secret_scan, sequence_packing, toxicity
from tremor.llm.common import crc_mod, stage, table, unstage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from four of five labels.

    Null and empty texts have no toxic passage and the score of such texts; they stay, unless most labels are toxic.
    Equal rows go or stay together. Without labels of both classes all stay.
    """
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0)
    return toxicity.drop_toxic(docs, labels)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, Jaccard 0.8 or more.

    It is the one of the least id (then of the least text hash; null ids last). Texts without
    words are linked with nothing and all stay.
    """
    return ngram_jaccard.drop_near_copies(docs, n=5, num=80, den=100)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark and n_chars follows. Null texts and counts stay null."""
    return secret_scan.redact_secrets(docs, words=secret_scan.learn_words(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 times. A text without words is taken as often as the whole part of its source's share says (0, 1 or 2); a null source is one, the last."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its place in a sequence; texts without words have none."""
    return sequence_packing.pack_documents(docs)


STAGES = [
    ("drop_toxic", drop_toxic),
    ("drop_near_copies", drop_near_copies),
    ("redact_secrets", redact_secrets),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: The model, the draws and the packing are not SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = None
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
        if done is not None:  # nothing reads the stage before any more
            unstage(done)
        done = docs
    return docs
