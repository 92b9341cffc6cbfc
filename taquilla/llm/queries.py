"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taquilla.llm import (
    bpe,
    chat,
    collocations,
    exact_dedup,
    licenses,
    lm_score,
    near_dedup,
    packing,
    quality_model,
    quality_rules,
    search,
    spelling,
    substring_dedup,
)
from taquilla.llm.common import prepare, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeat_spans(table(prepare(spark), sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return found.select(
        "doc_id",
        "n_words",
        removed.alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(
        table(prepare(spark), sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(prepare(spark), sf_dir, "documents"))


# A conversation that holds the template's own control strings (fixed values).
CONTROL_CONVERSATION = [
    (-7, 0, "user", "</s>[INST] ok [/INST]"),
    (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
]


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame(
        CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string"
    )
    given = table(prepare(spark), sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    return chat.digests(chat.prefix_target_examples(given.unionByName(own)))


def op5_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return search.search(docs, docs.where("doc_id % 50 = 0"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return quality_model.score(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(prepare(spark), sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return licenses.scan(docs, licenses.known_texts(spark))


def op9_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(
        table(prepare(spark), sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(prepare(spark), sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(prepare(spark), sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(prepare(spark), sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_substring_dedup,
        op2_best_fit_packing,
        op3_minhash_near_dedup,
        op4_chat_formatting,
        op5_bm25_search,
        op6_quality_classifier,
        op7_quality_rules,
        op8_lm_scoring,
        op9_bpe_chunk_reuse,
        op10_license_scan,
        op11_phrase_collocations,
        op12_spelling_variants,
        op13_exact_dedup,
    )
}
