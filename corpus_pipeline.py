"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next one's ``docs``. All but the last
give the columns of ``documents``. Nulls, empty texts, repeated rows and empty tables go through each stage as its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.llm import mixing, packing, pii_surrogates, quality_classifier, simhash_dedup
from sigframe.llm.common import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on this table's labels, does not reject."""
    return quality_classifier.keep_good(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more."""
    return simhash_dedup.deduplicate(docs.select(COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced; ``n_chars`` follows the new text."""
    out = pii_surrogates.replace(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed(docs.select(COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2,048 tokens. Workers of the stages before still live, so the word table is smaller than by itself."""
    return packing.pack_documents(docs, pieces=200_000)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]
ORACLE_SQL = None  # the stages train, tokenize and hash as SQL cannot


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
