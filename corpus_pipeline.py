"""A training-data pipeline over `documents`: STAGES, each written as Parquet and read again by run().

Quality classifier and toxicity drop what they reject, near duplicates leave one document of each group,
decontamination drops documents that hold test items, and the last stage encodes what is left.

Defined cases, for every stage: rows are judged one by one, ids may be null or repeated; a null or empty text, or one
without words, goes in the first stage, and is clean, unlike any other and free of test items for the next three; equal
rows are judged alike, and the third stage leaves one of them; ties there go to the smallest id, then content; columns
of any other name pass by untouched up to the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storyloom.llm import registry
from storyloom.llm._common import drop, scope, table
from storyloom.llm.decontam import without_hits
from storyloom.llm.neardup import one_of_each
from storyloom.llm.pieces import encode_documents
from storyloom.llm.quality import keep_good
from storyloom.llm.toxicity import keep_clean


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the weakly supervised scorer keeps."""
    return keep_good(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the ordinal regression, fitted on the labelled ones among them, grades 0."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8, whatever their ids."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark item is found."""
    return without_hits(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids and round trip of every document left."""
    return encode_documents(docs, registry.piece_model())


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("sentencepiece", encode)]

#: The classifiers, the densified signatures and the piece agenda are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each one's scratch tables and broadcasts go once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scope() as own:
            before, docs = docs, own.finish(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(before)
    return docs
