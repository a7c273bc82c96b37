"""The corpus pipeline: a chain of operators over ``documents``.

A stage's own tables lie in a folder that goes when the next stage begins: its
result is a table of its own by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import mixing, near_dedup, pieces, quality, suffix_dedup
from pagemill.llm.shared import begin_stage, saved

#: The stages' joint rows can't be told in SQL: they rest on an estimated model and keyed permutations.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior rejects go."""
    begin_stage(docs, "quality_rules")
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    begin_stage(docs, "near_dedup")
    return near_dedup.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes and more that stand further up go; documents of which nothing is left go too."""
    begin_stage(docs, "suffix_dedup")
    return suffix_dedup.cut(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document and epoch with the words that the mix takes."""
    begin_stage(docs, "mix_sources")
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids_sha256, decoded_sha256, ids of every row."""
    begin_stage(docs, "sentencepiece")
    return pieces.encode_table(docs, keys=("doc_id", "source", "lang"), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeated_strings),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
