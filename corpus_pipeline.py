"""From documents to training tokens: five stages, each over all rows that the one before kept."""

from __future__ import annotations

import public_tokenizers
from attest.llm.decontaminate import decontaminate
from attest.llm.mixing import mixed
from attest.llm.near_dedup import deduplicated
from attest.llm.quality import kept
from attest.llm.token_files import read_tokens, with_crc32, write_tokens
from attest.session import written
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a block of the mix: most documents of a source that is not taken whole come or go as a whole.
BLOCK_WORDS = 256


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained classifier does not reject."""
    return kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of near-duplicates."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a benchmark passage."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, once for each pass; n_chars is that of the new text."""
    return mixed(docs, block_words=BLOCK_WORDS).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the ids of each document lie in the token files, and their checksum."""
    path = write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return with_crc32(read_tokens(spark, path)).withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: SQL cannot express the trained classifier, the permutations or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
