"""From raw documents to packed training sequences, in stages.

A stage takes the documents its predecessor kept; between stages they are written as Parquet to
the shared folder and read again, so a lost executor costs no more than the stage it is in.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from taquilla.llm import near_dedup, packing, quality_model, quality_rules, substring_dedup
from taquilla.llm.common import prepare, table, written

# The stage's own rule. A pair right at 0.8 shares no key with a chance of 3.8e-7.
NEAR_COPY = near_dedup.Rule(shingle=5, percent=80, symbols=80, chunks=18)


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good."""
    prepare(spark)
    machine = quality_model.train(docs, table(spark, sf_dir, "labels"))
    return quality_model.without_rejected(docs, machine)


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    prepare(spark)
    return quality_rules.without_rejected(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 of their five-word runs, that with the least id."""
    prepare(spark)
    return near_dedup.without_copies(docs, NEAR_COPY)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long passages that a document with a smaller id holds too."""
    prepare(spark)
    return substring_dedup.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in full-length training sequences."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classified),
    ("quality_rules", ruled),
    ("minhash_near_dedup", without_near_copies),
    ("substring_dedup", without_passages),
    ("best_fit_packing", packed),
]

# Neither a trained classifier nor a tokenizer can be put as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for position, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if position == 0 else written(docs), sf_dir)
    return docs
