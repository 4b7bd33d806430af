"""The corpus pipeline: documents in, token sequences out, five stages.

Each stage is a function of (spark, docs, sf_dir), works on all that the one
before kept, and (but for the last) returns the columns that it got.  ``run``
writes each stage's result as Parquet in the shared folder and reads it again
for the next one, so a lost executor costs at most the running stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talkweave.llm import bloom_dedup, bpe, common, langid, mixing, simhash_forest
from talkweave.sources import shared


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised with calibrated confidence."""
    return langid.predict(docs, langid.fit(docs), keep_columns=True)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text."""
    return bloom_dedup.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return simhash_forest.near_dedup(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws each document as often as the source weights and its size ask for: a row for each copy."""
    return mixing.mix(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every document, with its decoding checked: doc_id, n_tokens, tokens, exact."""
    return bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("bpe_tokens", bpe_tokens),
]

#: Language ID, SimHash and BPE can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token sequences of the documents that stay; what a stage wrote for itself goes when the next one's input is written."""
    docs = common.table(spark, sf_dir, "documents")
    since = shared.mark()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            at = shared.path(spark, "stage")
            docs = shared.materialise(docs, at)
            shared.release(spark, since, at)
    return docs
