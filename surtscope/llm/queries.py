"""The registered queries of this package, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from surtscope.llm import (
    byte_bpe,
    exact_dedup,
    katz,
    lexical_search,
    oracle,
    packing,
    pu_quality,
    quality_rules,
    secret_scan,
    simhash,
    suffix_dedup,
    token_align,
    token_counts,
    warc,
)
from surtscope.llm.common import table

PACKING_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The same vocabulary for the encoder of Latin texts.
PACKING_ENCODER = (
    PACKING_VOCABULARY,
    public_tokenizers.path("byte_bpe_50k.tiktoken"),
    public_tokenizers.PATTERN,
    (("<|endoftext|>", 50256),),
)
#: The same files without special tokens, and the model they are aligned with.
ALIGNED_LEFT = PACKING_ENCODER[:3]
ALIGNED_RIGHT = public_tokenizers.path("piece_bpe_32k.model")
COUNTED_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
CODING_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), with_bytes=False)


def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"), *PACKING_ENCODER, with_ids=False)


def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_texts(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest_texts(table(spark, sf_dir, "documents"), CODING_RANKS, public_tokenizers.PATTERN)


def op7_tree_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("n_points")


def op8_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op9_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("file", "offset", "length")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align_corpus(table(spark, sf_dir, "documents"), ALIGNED_LEFT, ALIGNED_RIGHT, with_groups=False)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), COUNTED_VOCABULARY)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_suffix_dedup,
        op2_pu_quality,
        op3_golay_simhash,
        op4_vector_packing,
        op5_katz_backoff,
        op6_byte_bpe,
        op7_tree_exact_dedup,
        op8_trigram_secrets,
        op9_warc_index,
        op10_quality_rules,
        op11_lexical_search,
        op12_token_alignment,
        op13_token_counts,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_tree_exact_dedup": oracle.EXACT_DEDUP,
        "op9_warc_index": oracle.WARC_INDEX,
        "op10_quality_rules": oracle.quality_rules_sql(),
        "op11_lexical_search": oracle.LEXICAL_SEARCH,
    }
