"""From documents to token ids: quality rules, line dedup, near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import bpe, line_chunks, mixing, near_dups, quality
from tallyforge.llm.common import documents, kept, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that an earlier document holds go."""
    return line_chunks.without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, by the texts as they were given and by what line dedup has left of them."""
    left = kept(near_dups.keep_one_of_originals(docs, documents(spark, sf_dir), k=5, percent=80), "one-of-originals")
    return near_dups.keep_one(left, k=5, percent=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted mixture takes stay, each once."""
    return mixing.take(docs, table(spark, sf_dir, "labels"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, decoded again for a check."""
    return bpe.token_documents(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("source mixing", source_mixing), ("byte-level BPE", byte_bpe)]
#: SQL can't express the repetition verdict, MinHash links, the fitted rates and BPE; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
