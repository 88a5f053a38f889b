"""A corpus pipeline: each stage reads what the one before it wrote.

Documents are (doc_id, text, lang, source, n_chars) and any others. Language ID drops documents
whose language is not told clearly; the n-gram join leaves one document of each group of near
copies; mixing repeats or leaves out documents until the sources have their target weights; packing
gives the token pieces of what remains with their sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumaspec.llm import jaccard, langid, mixing, packing
from lumaspec.llm._store import cut


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told clearly; a null or letterless text goes."""
    return langid.drop_rejected(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each component of documents with a similarity of 80 % over five-word shingles."""
    return jaccard.one_of_each(docs, jaccard.Jaccard(words=5, percent=80))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents until each source has its share of the words."""
    return mixing.take_mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives the token pieces of what is left, each with its sequence and place in it."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("ngram_jaccard", ngram_jaccard), ("source_mixing", source_mixing), ("best_fit_packing", best_fit_packing)]

#: Compression sizes, byte-pair encoding and best fit are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
