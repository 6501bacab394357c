"""From raw documents to packed training sequences, in five stages over the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamarack.llm import packing, private_data, quality_classifier, simhash_similar, substrings
from tamarack.llm.common import materialize, table
from tamarack.llm.queries import vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, doesn't reject."""
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by SimHash: five-word shingles, similarity 0.8 or more."""
    return simhash_similar.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes and more that occur elsewhere."""
    return substrings.remove(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced and terms that disclose it generalised or removed."""
    return private_data.sanitise(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality_classifier", good_quality),
    ("simhash", near_duplicates),
    ("suffix_array", repeated_passages),
    ("personal_data", personal_data),
    ("packing", sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
