"""The training corpus, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written
as Parquet and read again.  All but the last return the columns of ``documents``:

1. quality rules: documents that fail go
2. quality classifier: documents that the importance resampling leaves out go
3. SimHash near-duplicates: the document of the smallest doc_id of each group stays
4. mixing: each document as often as its source's target wants
5. byte-level BPE: a row for each copy, with the digests of its ids and of the decoded text

Defined results: a null text has no words and goes in stage 1, as very short texts do; very long texts are taken
whole everywhere; a null source is a source and a host; a null doc_id is a key like others, last among the ids of
a group; repeated rows are one group of copies; an empty table gives an empty result; other columns, whatever
their names, ride along to stage 4.  Each stage's own staged tables go once its result is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from needlework.llm import bpe, importance, mixing, quality_rules, simhash
from needlework.llm.common import table
from needlework.plans.staging import drop, kept, scratch


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return importance.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mixture),
    ("byte_bpe", tokens),
]

#: SQL has no XXH64 and no tokenizer: tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        with scratch(spark):
            before, docs = docs, kept(apply(spark, docs, sf_dir), f"pipeline-{name}")
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
