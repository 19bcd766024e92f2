"""The training corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Each stage keeps the columns of its documents (the last returns pieces), whatever further columns there are. Null texts count as empty, rows that
repeat are rows of their own until a stage says otherwise, texts of any length are read whole, and an empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import discard, keep, materialise, scope, table
from tributary.llm.line_dedup import dedup_lines
from tributary.llm.pack import pack
from tributary.llm.simhash_dedup import keep_one
from tributary.llm.source_mix import take_mix
from tributary.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity reaches the bar go. Null and empty texts, and without labels of both classes all texts, stay."""
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first that has them; n_chars, where there is one, follows. Null texts stay null."""
    clean = dedup_lines(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id; rows without an id stay. Texts without words are one group."""
    return keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken so that each source (null is one) comes near its target; one taken twice is two rows. Texts without words are not taken."""
    return take_mix(docs)


def best_fit_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document. An empty text is one piece, its end id."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("source_mix", source_mix),
    ("best_fit_pack", best_fit_pack),
]

#: SQL has no tokenizer, fitted model or bin completion; tests/llm/test_pipeline_by_force.py compares every stage with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        past = docs
        with scope(spark):  # a stage's own tables go when its result is written, and that when the next one's is
            docs = keep(materialise(stage(spark, past, sf_dir), name))
        discard(past)
    return STAGES[-1][1](spark, docs, sf_dir)
