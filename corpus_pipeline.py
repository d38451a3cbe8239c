"""A corpus pipeline of five stages over ``documents``; each stage is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import jaccard_join, mixing, piece_bpe, quality, stage, substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the co-trained classifier rejects."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group linked by a Jaccard similarity of 0.75 or more."""
    return jaccard_join.keep_first(docs, k=5, percent=75).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 13 words and more that a document with a smaller id has."""
    out = substring_dedup.remove_repeats(docs, k=13, more=("lang", "source"))
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents so that sources reach their target weights; a row for each copy."""
    return mixing.take(docs, weights=(5, 2, 1), share=1.5, cap=2.0).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    import public_tokenizers

    return piece_bpe.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", good_documents), ("near_copies", one_of_near_copies), ("repeats", without_repeats), ("mix", mixed), ("encode", encoded)]

#: Trained models, hashes and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, place = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{stage.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, step) in enumerate(STAGES):
        step(spark, docs, sf_dir).write.parquet(f"{place}/{k}-{name}")
        docs = spark.read.parquet(f"{place}/{k}-{name}")
    return docs
