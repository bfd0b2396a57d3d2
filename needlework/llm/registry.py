"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from needlework.llm import bpe, embedding_dedup, html_text, importance, language, mixing, oracles, quality_rules, simhash, token_file, url_filter
from needlework.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_file.digests(table(spark, sf_dir, "documents"), path, end_id=2, vocabulary=50_257)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_html_text": op1_html_text,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_quality_rules": op3_quality_rules,
        "op4_simhash": op4_simhash,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_token_file": op6_token_file,
        "op7_url_filter": op7_url_filter,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_language": op9_language,
        "op10_mixing": op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    """SQL has no tokenizer, HTML parser or XXH64, and no hash draws: the other queries are held against plain versions in tests."""
    return {"op3_quality_rules": oracles.OP3, "op7_url_filter": oracles.OP7, "op8_embedding_dedup": oracles.OP8}
