"""The queries of this subpackage, by name, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, mixing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import removed

    return removed(table(spark, sf_dir, "documents")).drop("kept")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import html_query

    return html_query(table(spark, sf_dir, "pages"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokenize import token_output

    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secrets_query

    return secrets_query(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"), budget_share=1.0, repeats=4.0).select("doc_id", "source", "epoch", "n_tokens", "before")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import redact_query

    return redact_query(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import removed

    return removed(table(spark, sf_dir, "documents")).drop("kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_suffix": op2_suffix,
    "op3_html": op3_html,
    "op4_tokens": op4_tokens,
    "op5_secrets": op5_secrets,
    "op6_decontaminate": op6_decontaminate,
    "op7_mixing": op7_mixing,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_substring": op10_substring,
}

ORACLE_SQL: dict[str, str] = {
    "op6_decontaminate": decontaminate.SQL,
    "op7_mixing": mixing.SQL,
}
