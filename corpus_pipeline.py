"""The training-data pipeline: quality rules, near-duplicates, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on every row that the stage
before it kept, and is written as Parquet and read again for the next one.  All
but the last return the columns of ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from reqlens.llm import minhash, packing, quality_rules, secret_scan
from reqlens.llm.common import stage

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current quality policy keeps."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, at a similarity of 0.8."""
    return minhash.drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets masked and ``n_chars`` set anew."""
    return secret_scan.redact(docs, TOKENIZER, path_col="source", size_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of at most 4096 tokens."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("quality_rules", quality), ("near_dedup", near_duplicates), ("secret_scan", secrets), ("packing", pack)]

#: Tokenisation and the forest can't be said in SQL; tests/llm holds the
#: pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; between them the rows are Parquet in the
    shared folder.  Nulls, repeated rows and ids are as the stages say; an empty
    table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{name}")
    return docs
