"""From raw documents to token digests: language, exact and near duplicates, benchmark passages, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept; its result is written
as Parquet and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempolith.llm import bpe, contamination, digests, jaccard, language, store


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells; those that it rejects go."""
    return language.identified(docs, language.learn(docs.where(~language.held_out())))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    return digests.survivors(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by links of five-word shingles at a similarity of 0.8, the smallest id."""
    return jaccard.representatives(docs, words=5, threshold=(8, 10))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return contamination.clean(docs, store.read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of each document's tokens, and the digest of what they decode to."""
    return bpe.encode_decode_digests(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = store.read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = store.materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        store.discard(before)
        before = docs
    return docs
