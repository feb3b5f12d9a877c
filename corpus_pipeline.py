"""A corpus pipeline of five stages, from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet to the shared folder and read again as the next one's docs. All stages
but the last return the columns of documents, extra ones included.

1. quality_rules: documents that fail the base rules or are depleted go; lines
   that many documents of their host share are cut out of the others.
2. near_duplicates: one document of each class of near copies stays.
3. repeated_passages: passages of an earlier document are cut out of later ones.
4. source_mix: documents are taken, and taken again, by their source's target.
5. pieces: documents are encoded and decoded; one row per row of the mix.

NULL texts and empty texts fail the first stage's base rules. A document whose
text the third stage empties stays, with size 0, and is not taken by the mix.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from runledger.llm import chunk_dedup, line_rules, mixing, near_dedup, piece_spans
from runledger.llm.common import kept_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_rules.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.distinct_documents(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chunk_dedup.dedup_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_spans.piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("pieces", pieces),
]

#: Weighted sampling, gear hashes and the tokenizer have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
