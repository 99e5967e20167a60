"""From documents to packed sequences in five stages, each over all rows that the one before kept.

language_id drops the documents that the language model rejects; exact_dedup
keeps the largest doc_id of equal texts; jaccard_join keeps the smallest
doc_id of each group of near duplicates; mixing samples what is left to the
target weights; packing returns one row for each piece of a sequence, with its
token ids. A table without rows stays one through every stage, columns that
the stages do not name pass unread, and none of them may clash with what a
stage needs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from quillon.llm.common import stored, table
from quillon.llm.queries import MIX, WORD_BPE


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the model, fit on this table, rejects: texts that are null or without a letter, and texts of no learned language.

    Repeated rows are judged alike, long texts by all of their subwords. Without labelled rows nothing is rejected.
    """
    return language_id.keep_known(docs, language_id.fit(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the largest doc_id of texts equal after lower-casing A-Z; null counts as empty, rows that repeat id and text stay or go together."""
    return exact_dedup.keep_last(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of near duplicates; texts without words are like no other, a null id goes if its component has another."""
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples to the target shares of source, language and form; a missing value is a value of its own, rows of one id share their draw."""
    return mixing.sample(docs, MIX)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a sequence; a null or empty text is one end token, a long text is cut, each row is packed for itself."""
    return packing.pack(docs, public_tokenizers.path(WORD_BPE), with_ids=True)


STAGES = [
    ("language_id", keep_known_language),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The trained model and the differencing are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
