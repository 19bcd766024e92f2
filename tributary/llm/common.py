"""Helpers that the corpus operators share: table access, expressions, and the library's durable intermediate tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, keep, materialise, scope

__all__ = ["LOWER", "UPPER", "WORD", "discard", "keep", "let", "lower_ascii", "materialise", "scope", "table", "word_count"]

#: ASCII letters, for the lower-casing that touches A-Z only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a maximal run of characters other than space and U+0009-U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII strings take the engine's fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: a lambda's outer expressions are otherwise evaluated for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
