"""A training corpus from documents: filters, deduplication and packing, each stage written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyroom.llm import exact_dedup, ngram_jaccard, packing, quality, toxicity, word_bpe
from tallyroom.llm.common import Scratch, rows_by_id


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs but the rows whose ids are rejected; rows without an id stay."""
    return rows_by_id(docs, "doc_id", rejected.where("doc_id is not null").select("doc_id"), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours of their terms don't call toxic."""
    return _without(docs, toxicity.score(docs, _labels(spark, sf_dir)).where("predicted = 1"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model calls good."""
    return _without(docs, quality.score(docs, _labels(spark, sf_dir)).where("predicted = 0"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8."""
    return ngram_jaccard.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2,048 tokens."""
    return packing.pack(docs, word_bpe.default_path(), 1)


STAGES = [("toxicity", drop_toxic), ("quality", drop_low_quality), ("exact_dedup", drop_exact_copies), ("near_copies", drop_near_copies), ("packing", pack)]

#: Learnt filters, similarity components and token ids are outside SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Every stage works on all that its predecessor kept."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = scratch.keep(stage(spark, docs, sf_dir), name)
        docs = out
    return docs
