"""From raw documents to packed training sequences: five stages, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
Labels and the tokenizer are read from beside the documents and from the public vocabulary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmurate.llm import mixing, packing, quality_model, quality_rules, simhash
from murmurate.llm.scratch import stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, scores at 0.5 or more.

    Null and empty texts have the score of the bias; without labels all documents stay; repeated rows stay or go alike; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality_model.fit(docs, labels, learn=quality_model.learnable(1, 3))
    return quality_model.scored(docs, weights, least=0.5)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not mostly lines that many of their host's documents share.

    Null and empty texts go, as too short; a null source is a host of its own; repeated rows stay or go alike; an empty table stays empty.
    """
    return quality_rules.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, the one of smallest id.

    Null and empty texts are alike; of repeated rows one stays; rows without an id give way to those that have one; an empty table stays empty.
    """
    return simhash.deduplicated(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, those with little markup earlier.

    The mix is native, so the classifier, whose scores the columns of documents can't carry this far, is not asked again here.
    Documents without a word go; a null source is a source of its own; repeated rows count as often as they occur; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence.

    Null and empty texts are one piece of the end id; repeated rows and null ids are packed like any other; an empty table gives no piece.
    """
    return packing.pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("simhash_near_dedup", near_dedup),
    ("mixing_sources", mixing_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Scores of a trained model and token ids are beyond SQL; tests hold the pipeline against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; what a stage keeps is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
