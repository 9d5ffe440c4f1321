"""A corpus pipeline: quality, exact copies, near copies, mixing by source, packing. Part of the subpackage ``llm``.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; its result is written, and read again as the
next one's ``docs``. All but the last return the columns of ``docs``. Empty input gives empty output throughout.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkbars.llm import exact_dedup, mixing, packing, quality, simhash
from sparkbars.llm.common import settled, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels in ``sf_dir``, held-out rows aside."""
    return quality.keep_quality(docs, quality.train_quality(docs, table(spark, sf_dir, "labels")))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the largest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (shingles of five words, similarity 0.8) the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack_documents(docs, packing.word_bpe_encoder(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality", keep_quality), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("mixing", mix_sources), ("packing", pack)]
#: Trees, fingerprints and packing are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settled(docs, f"stage-{name}")
    return docs
