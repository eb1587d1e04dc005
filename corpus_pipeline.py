"""A corpus made ready for training: toxic documents out, copies out, near copies out, sources mixed, texts encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treespark.llm import exact_dedup, mixing, pieces, simhash, toxicity
from treespark.session import cut_lineage

#: Fingerprints of near copies: seeds, over the set of words. Any one of them links at two differing bits or fewer.
NEAR_SEEDS = (42, 43, 44, 45, 46, 47, 48, 49)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine does not reject. Rows stay or go by their own text."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the smallest id."""
    return exact_dedup.without_copies(docs, keep="smallest")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return simhash.without_near_copies(docs, seeds=NEAR_SEEDS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; documents of small sources up to twice, by the weights of the mixture."""
    return mixing.mixed(docs, max_repeat=2.0)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip) of every document of the mixture."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("mixing", mixed_sources),
    ("sentencepiece", encoded),
]

#: The fitted machine and the fingerprints are beyond SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
