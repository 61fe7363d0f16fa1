"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read_documents
from .sql import SQL  # noqa: F401  (read by the entry point)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_table

    return toxicity_table(read_documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_count import token_table

    return token_table(read_documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_table

    return license_table(read_documents(spark, sf_dir, "doc_id", "text"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_table

    return quality_table(read_documents(spark, sf_dir, "doc_id", "text"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score_table

    return score_table(read_documents(spark, sf_dir, "doc_id", "text"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicate_table

    return near_duplicate_table(read_documents(spark, sf_dir, "doc_id", "text"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination_table

    return contamination_table(read_documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeat_table

    return repeat_table(read_documents(spark, sf_dir, "doc_id", "text"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_mix import mix_table

    return mix_table(read_documents(spark, sf_dir, "doc_id", "text", "source"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_table

    return line_table(read_documents(spark, sf_dir, "doc_id", "text"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_table

    return pii_table(read_documents(spark, sf_dir, "doc_id", "text"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitening_table

    return whitening_table(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import trie_table

    return trie_table(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_token_count, op3_license_scan, op4_quality_rules, op5_lm_score, op6_near_dedup, op7_decontaminate, op8_suffix_dedup, op9_source_mix, op10_line_dedup, op11_pii, op12_embedding_whitening, op13_prefix_trie)
}
