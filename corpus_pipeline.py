"""A training corpus from ``documents``: language, copies, near copies, mix, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept and is written
as Parquet before the next one reads it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm import exact_dedup, jaccard_join, language, mixing, packing
from logwarden.llm.common import ROW, keep_rows, materialise, release, table, with_rows
from logwarden.llm.queries import tokenizer_path
from logwarden.sources.scratch import temporary_tables


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go."""
    return language.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join, the one with the smallest doc_id stays; every row is a document."""
    rows, key = with_rows(docs)
    joined = jaccard_join.join_rows(rows.select(F.col(key).alias("doc_id"), "text"))
    groups = joined.select(F.col("doc_id").alias(ROW), F.col("component_id").alias("group"))
    return keep_rows(rows, key, groups, F.struct(F.col("doc_id").isNull(), "doc_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those that it does not take go."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix in sequences of 2048 tokens; a repeated document has pieces for each use."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: The kernel scores, the hash order of the mix and the tokenizer have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; tables that only an earlier stage needed are deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with temporary_tables(f"stage-{name}"):
            docs = materialise(stage(spark, before, sf_dir), f"stage-{name}")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
