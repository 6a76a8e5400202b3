"""Corpus cleaning in four stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

1. toxicity: documents that the classifier rejects go.
2. n-gram Jaccard join: one document of each group of near-duplicates stays.
3. secret scans: secrets are replaced by a mark; every document stays.
4. best-fit packing: the documents' tokens, in sequences.

All but the last return the columns of ``documents``, whatever other columns there are and however they are named.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from revquarry.llm import common, ngramjoin, packing, secretscan, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier, fitted on ``docs`` and the labels, doesn't take for toxic.

    Rows with null or empty texts stay, as do rows without key; repeated rows are judged alike. Labels of keys that
    aren't there count for nothing; without labels of both kinds nothing goes. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group joined by links: that of the smallest key, of several rows of that key the first by text.

    Rows with null, empty or blank texts link with nothing and stay; a row without key stays where its group has no
    other. An empty table stays empty.
    """
    return ngramjoin.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, each secret in its text replaced by a mark and ``n_chars`` renewed; null texts stay null."""
    return secretscan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document and its place in a sequence; a null text is its end token alone.

    Rows that repeat a key or have none are documents of their own. An empty table gives no pieces.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]

#: Tokenizers and a trained classifier are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
