"""Corpus pipeline: toxicity, language identification, near-duplicates, packing; part of the llm subpackage.

Each stage takes (spark, docs, sf_dir), reads what the stage before it kept, and returns a DataFrame; all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lifeloom.llm import languages, ngram_join, packing, toxicity
from lifeloom.llm.common import durable, table
from lifeloom.llm.queries import packed_digest


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; null, empty and letterless ones are not toxic."""
    return toxicity.keep_ordinary(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_no_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one language holds half at least: letterless and evenly mixed ones go."""
    return languages.keep_known(docs, languages.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group of near-duplicates; rows with a null id stay."""
    return ngram_join.keep_one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens, their ids as a CRC-32."""
    return packed_digest(packing.pack_documents(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_no_language),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models have no SQL form; tests/llm/test_pipeline.py runs the stages against plain Python.
ORACLE_SQL = None
