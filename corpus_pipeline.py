"""A corpus pipeline over documents; each stage calls one operator of orderkeep.llm and works on what the one before kept.

A document's words as a model reads them come last: the last stage returns each document's token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderkeep.llm import bpe, mixing, ngram_join, quality_model, quality_rules
from orderkeep.session import own_folder, remove


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_model.stage(spark, docs, sf_dir)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.stage(spark, docs, sf_dir)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays."""
    return ngram_join.stage(spark, docs, sf_dir)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that each source's words come near its target."""
    return mixing.stage(spark, docs, sf_dir)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids binary): the token ids of each document."""
    return bpe.stage(spark, docs, sf_dir)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("n-gram Jaccard join", deduplicate),
    ("mixing to target weights", mix),
    ("byte-level BPE", encode),
]

#: SQL has no trained model; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet into the shared folder and read again; what a stage has read goes
    once it is written, and the last stage's rows when the driver ends."""
    folder = own_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
