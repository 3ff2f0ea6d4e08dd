"""The corpus pipeline: quality classifier, exact and near deduplication, mixing sources, encoding.

Each stage takes what its predecessor kept and returns the columns of documents, but for the last, which returns
doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row that the mix takes (a document it takes twice has two rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.llm import bpe, exact_dedup, ngram_join, quality, source_mix
from ledgerlake.llm.common import n_written, release, staged, table

#: Shingles of five words; 100 * intersection >= 80 * union.
SHINGLE, NUM, DEN = 5, 80, 100


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior probability of being good is 0.5 or more."""
    return quality.good_only(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of texts that are equal but for white space."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of documents that are linked by similar sets of shingles."""
    return ngram_join.one_each(docs, SHINGLE, NUM, DEN)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as the mix of sources takes them, none, once or twice."""
    return source_mix.mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text and the bytes they decode to, as digests."""
    return bpe.encoded_digests(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mix", mix_sources),
    ("byte_bpe", encode_texts),
]

#: A fitted classifier and merges of words can't be stated in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage wrote is removed as soon as its result, and with it the former one's, isn't read any more."""
    docs, since = table(spark, sf_dir, "documents"), n_written()
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, since)
    return STAGES[-1][1](spark, docs, sf_dir)
