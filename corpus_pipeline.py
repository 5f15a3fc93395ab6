"""A corpus run: each stage reads what the stage before it kept and writes Parquet for the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsrank.llm import decontaminate, kernels, neardup, pieces, suffix_dedup, toxicity
from newsrank.session import BATCH_BYTES, SHUFFLE_CLEANUP, drop_folder


def freeing(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs``, whose write frees what it has shuffled and takes small batches: a stage is read again only from its Parquet."""
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    spark.conf.set(*BATCH_BYTES)
    return docs


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is 0.3 or more."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return freeing(spark, neardup.drop_near_duplicates(docs))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes byte runs of 150 and more (passages of fifty words start at about that length) that occur elsewhere out of the texts.

    Every copy goes, the first one too: what stays behind of a passage is nothing.
    """
    return freeing(spark, suffix_dedup.drop_repeats(docs, length=150, cover_order=7))


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece numbers of each text, and whether they decode to it."""
    return pieces.encode(docs, check=True)


STAGES = [("toxicity", harmless), ("minhash_near_dedup", single), ("suffix_dedup", repeats), ("decontamination", untested), ("sentencepiece", encoded)]

#: The stages are not expressible in SQL; tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), {key: spark.conf.get(key) for key in (SHUFFLE_CLEANUP, BATCH_BYTES[0])}
    try:
        path = None
        for _, stage in STAGES:
            last, path = path, kernels.scratch(spark)
            docs = kernels.stored(stage(spark, docs, sf_dir), path)
            if last:
                drop_folder(spark, last)
        return docs
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
