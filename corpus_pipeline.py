"""Corpus pipeline: toxicity, near duplicates, secrets, mixing, encoding. Every stage's result is written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessella.llm import mixing, pieces, secrets, simhash, toxicity
from tessella.llm.common import new_folder
from tessella.operators.layout import spread

DOCUMENTS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in DOCUMENTS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.keep_clean(_documents(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that resemble each other (five-word shingles, similarity of 0.8 or more) the row with the smallest id stays.

    Rows that repeat an id with texts that don't resemble each other are of different groups. Null ids come last.
    """
    return simhash.first_of_groups(_documents(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; n_chars follows."""
    return secrets.redact(_documents(docs), path="source").withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the raked probabilities stay."""
    return mixing.mixed(_documents(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether decoding them gives its text back."""
    return pieces.encode(_documents(docs), public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_pieces", "ids", "round_trip")


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("mixing", mix_sources), ("pieces", encode_pieces)]

#: SQL can express neither the label model nor the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each on what the one before has written."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    folder = new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
