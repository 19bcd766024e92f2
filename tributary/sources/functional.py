"""Functional sources: single rows, iterators, generators, fallible producers, unbounded batches."""

from __future__ import annotations

import asyncio
from collections.abc import Awaitable, Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Lanes, route
from ..operators.fold import arrow_rows, arrow_schema

Schema = T.StructType | str


def _type(schema: Schema) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _frame(spark: SparkSession, rows: Iterable, schema: Schema) -> DataFrame:
    kind = _type(schema)
    full = T.StructType([*kind.fields, T.StructField("_seq", T.LongType(), False)])
    data = [(*(r.get(n) for n in kind.names), i) if isinstance(r, dict) else (*r, i) for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(data, full)


def once(spark: SparkSession, row: dict | tuple, schema: Schema) -> DataFrame:
    return _frame(spark, [row], schema)


def finite(spark: SparkSession, rows: Iterable[dict | tuple], schema: Schema) -> DataFrame:
    """Rows of an iterable with _seq from 1. The driver holds them: for fixtures and small catalogues."""
    return _frame(spark, rows, schema)


def finite_from_fn(spark: SparkSession, make: Callable[[int], dict | tuple | None], schema: Schema) -> DataFrame:
    """Rows make(0), make(1), ... up to the first None."""

    def rows() -> Iterator:
        i = 0
        while (row := make(i)) is not None:
            yield row
            i += 1

    return _frame(spark, rows(), schema)


def generated(spark: SparkSession, n: int, **columns: Column | str) -> DataFrame:
    """n rows from expressions over `i` (from 0), made in parallel where they are used."""
    exprs = ((F.expr(e) if isinstance(e, str) else e).alias(name) for name, e in columns.items())
    return spark.range(n).withColumnRenamed("id", "i").select(*exprs, (F.col("i") + 1).alias("_seq"))


def produced(spark: SparkSession, parts: int, produce: Callable[[int], Iterable[dict]], schema: Schema) -> DataFrame:
    """Rows of produce(part) for each part, made on the executors; _seq orders by part, then place."""
    kind = _type(schema)
    full = T.StructType([*kind.fields, T.StructField("_seq", T.LongType())])

    arrow = arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                rows = ({**r, "_seq": (part << 40) + i} for i, r in enumerate(produce(part)))
                while some := list(islice(rows, 10_000)):
                    yield arrow_rows(some, arrow)

    return spark.range(0, parts, 1, parts).mapInArrow(run, full)


def async_finite(spark: SparkSession, batch: Callable[[int], Awaitable[list | None]], schema: Schema) -> DataFrame:
    """Batches of an async producer up to the first None."""

    async def drain() -> list:
        rows, i = [], 0
        while (part := await batch(i)) is not None:
            rows += part
            i += 1
        return rows

    return _frame(spark, asyncio.run(drain()), schema)


def fallible(spark: SparkSession, make: Callable[[int], dict | None], schema: Schema) -> Lanes:
    """finite_from_fn whose producer may raise: such rows are null but for their error, and the source goes on."""
    kind = _type(schema)
    full = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in kind.fields), T.StructField("_error_kind", T.StringType()), T.StructField("_error_message", T.StringType())])

    def rows() -> Iterator[dict]:
        i = 0
        while True:
            try:
                row = make(i)
            except Exception as error:
                yield {"_error_kind": getattr(error, "kind", "Unknown"), "_error_message": str(error)}
            else:
                if row is None:
                    return
                yield row
            i += 1

    return route(_frame(spark, rows(), full))


def infinite(spark: SparkSession, rows_per_second: int = 10, **columns: Column | str) -> DataFrame:
    """An unbounded stream of rows from expressions over `value` (a counter) and `timestamp`."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rate.select(*((F.expr(e) if isinstance(e, str) else e).alias(n) for n, e in columns.items()), F.col("value").alias("_seq"))
