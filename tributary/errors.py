"""Error kinds, lanes and accounting.

Rows carry _error_kind and _error_message (null: ok). Validation and Domain errors stay in the data stream, marked;
all other kinds leave it for the error lane. Operators never process marked rows, they pass them on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KIND, MESSAGE = "_error_kind", "_error_message"
KINDS = ("Timeout", "Remote", "RateLimited", "PermanentFailure", "Deserialization", "Validation", "Domain", "Unknown")
IN_STREAM = ("Validation", "Domain")


class HandlerError(Exception):
    """An error with a kind; the row that caused it goes where its kind is routed."""

    def __init__(self, message: str, kind: str = "Unknown"):
        if kind not in KINDS:
            raise ValueError(f"no error kind {kind!r}")
        super().__init__(message)
        self.kind = kind


class FatalError(Exception):
    """The stage fails, and with it the run."""


@dataclass(frozen=True)
class Lanes:
    """The parts of a stage's output: data (marked rows included) and errors."""

    data: DataFrame
    errors: DataFrame


def marked(df: DataFrame) -> DataFrame:
    """df with the error columns, null where they were missing."""
    for c in (KIND, MESSAGE):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def is_ok() -> Column:
    return F.col(KIND).isNull()


def ok_rows(df: DataFrame) -> DataFrame:
    return df.filter(is_ok()) if KIND in df.columns else df


def error_rows(df: DataFrame) -> DataFrame:
    return marked(df).filter(~is_ok())


def route(df: DataFrame) -> Lanes:
    """Split by kind: the error lane takes what does not stay in the stream."""
    df = marked(df)
    stays = is_ok() | F.col(KIND).isin(*IN_STREAM)
    return Lanes(df.filter(stays), df.filter(~stays))


def error_totals(df: DataFrame) -> DataFrame:
    """error_kind, n over the marked rows of df."""
    return error_rows(df).groupBy(F.col(KIND).alias("error_kind")).agg(F.count(F.lit(1)).alias("n"))
