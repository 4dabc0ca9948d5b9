"""From raw documents to a tokenised training mix: STAGES in order, each over all rows its predecessor kept.

1. quality_rules: rows that the base rules or the isolation forest reject go.
2. near_dedup: one document of each near-duplicate component stays.
3. secret_scans: secrets in the texts are masked.
4. mixing: each document is there as often as the mix takes it (not at all, once or twice).
5. bpe: the texts' token counts and digests of ids and decoded text.

All stages but the last return the columns of ``documents``, whatever they are
named besides doc_id, text and source.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillflow.llm import bpe, dedup, mixing, quality, secrets
from rillflow.llm.common import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass.  A null, empty or short text fails; repeated rows are judged alike; without labels of both kinds the base rules decide alone."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, that of the smallest id; rows of null or repeated ids are told apart by their place, and equal rows are one."""
    return dedup.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; secrets in texts become a mark and n_chars follows; a null text stays null."""
    return secrets.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; a row without words goes; a null source is a source; rows of one id are drawn apart by their texts."""
    return mixing.mixed_documents(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of digests for each row; a null text has no tokens; a null id is carried through."""
    return bpe.encoded_digests(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

ORACLE_SQL = None  # an isolation forest, sketches and byte-pair merges are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
