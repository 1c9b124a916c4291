"""From raw documents to token ids: five stages over whole tables.

Each stage is ``f(spark, docs, sf_dir) -> DataFrame``; its result is written and read again before
the next.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import langid, mixing, pieces, queries, simhash, suffix
from gridloom.session import settle

MODEL = "piece_bpe_32k.model"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes and passages of over 50 words that start at two places are cut out."""
    return suffix.without_passages(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out, repeated or ended early as the schedule's spans hold them, so that
    the sources meet their target weights to the word."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of the ids and of the text they decode to."""
    model = pieces.read_model(public_tokenizers.path(MODEL))
    return queries.piece_digests(
        pieces.decode_documents(pieces.encode_documents(docs, model), model), "ids"
    )


STAGES = [
    ("language identification", language),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing to target weights", mixture),
    ("SentencePiece encoding", tokens),
]

#: Automata, fingerprint components, suffix arrays and piece merges are not SQL; the tests compare
#: each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
