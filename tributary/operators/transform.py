"""Stateless transforms. Built from Column expressions, so filters and columns reach the scan.

Every operator passes marked rows (see errors) through untouched where its output has their columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import KIND, MESSAGE, Lanes, is_ok, marked, route
from .fold import arrow_rows, arrow_schema

Exprs = Mapping[str, Column | str]


def _columns(exprs: Exprs) -> list[Column]:
    return [(F.expr(e) if isinstance(e, str) else e).alias(name) for name, e in exprs.items()]


def _envelope(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("_")]


def map_rows(df: DataFrame, exprs: Exprs) -> DataFrame:
    """One output row per input row: the given columns, and the envelope's."""
    return df.select(*_columns(exprs), *(c for c in _envelope(df) if c not in exprs))


def filter_rows(df: DataFrame, predicate: Column | str) -> DataFrame:
    """Rows for which predicate is true; null counts as false. Marked rows pass."""
    test = F.coalesce(F.expr(predicate) if isinstance(predicate, str) else predicate, F.lit(False))
    return df.filter(test | ~is_ok()) if KIND in df.columns else df.filter(test)


def filter_map(df: DataFrame, predicate: Column | str, exprs: Exprs) -> DataFrame:
    return map_rows(filter_rows(df, predicate), exprs)


def try_map(df: DataFrame, exprs: Exprs, error: Column | str, kind: str = "Unknown") -> Lanes:
    """map_rows where `error` (a message) is null; other rows become errors of the given kind with their input columns.

    Returns the lanes: ok rows and in-stream errors, and the error lane.
    """
    df = marked(df)
    message = F.expr(error) if isinstance(error, str) else error
    tried = df.withColumn(MESSAGE, F.when(is_ok(), message).otherwise(F.col(MESSAGE))).withColumn(KIND, F.when(is_ok() & F.col(MESSAGE).isNotNull(), kind).otherwise(F.col(KIND)))
    lanes = route(tried)
    return Lanes(map_rows(lanes.data, exprs), lanes.errors)


def emit_many(df: DataFrame, facts: Column, name: str = "fact") -> DataFrame:
    """0 to n outputs per input: `facts` is an array; envelope columns and the element stay."""
    return df.select(*_envelope(df), F.explode(facts).alias(name))


def custom(df: DataFrame, process: Callable[[dict], list[dict]], schema: T.StructType) -> DataFrame:
    """A row handler in Python: 0 to n outputs per input, in Arrow batches. Expressions are the fast path.

    Rows come as Arrow gives them: exact integers, None for null.
    """
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield arrow_rows([out for row in batch.to_pylist() for out in process(row)], arrow)

    return df.mapInArrow(run, schema)


def tagged(df: DataFrame, kinds: Mapping[str, Column | str], name: str = "event_type") -> DataFrame:
    """df with the name of the first kind whose test holds (null: none), as a tagged union."""
    out = None
    for kind, test in kinds.items():
        test = F.expr(test) if isinstance(test, str) else test
        out = (F if out is None else out).when(test, kind)
    return df.withColumn(name, out)


def port(df: DataFrame, *types: str, name: str = "event_type") -> DataFrame:
    """The rows that a subscriber to these types sees."""
    return df.filter(F.col(name).isin(*types))


def fan_out(df: DataFrame, *branches: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """Each branch reads the whole input. Spark shares the scan only if the input is persisted: see persist_shared."""
    return [branch(df) for branch in branches]


def persist_shared(df: DataFrame) -> DataFrame:
    """Keep a subplan that several sinks read (memory, then disk)."""
    from pyspark import StorageLevel

    return df.persist(StorageLevel.MEMORY_AND_DISK)
