"""Ordered folds in Python: state machines that read rows in order and emit.

Used where an operator is sequential by definition. Rows are dealt by key and sorted within partitions, so
each task streams its keys with one key's state in memory, never a key's rows.

Without keys there is one sequence. Rows are range-partitioned by the order and written in parallel; then the ranges are folded one after
another, several small ones together: a task sorts and folds at most about CHAIN_ROWS rows, and hands its state (pickled, bounded by the operator) on to the
next. No task ever sorts the whole sequence, and no order rests on how Spark merges partitions. One range of rows is the common case, and then the result is lazy.

Values arrive as Arrow gives them: exact integers, None for null, timestamps as datetimes.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..order import as_columns
from ..storage import materialise

#: step(state, row) -> (state, outputs); finish(state) -> outputs, after a key's last row.
Step = Callable[[object, dict], tuple[object, Iterable[dict]]]
#: The same for a whole batch of rows in order, for folds that numpy can do.
BatchStep = Callable[[object, pa.RecordBatch], tuple[object, Iterable[dict]]]

CHAIN_ROWS = 4_000_000
#: Output rows gathered before they are sent on.
_SENT = 10_000


def struct_type(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def arrow_rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """rows as a batch; columns that a row lacks are null."""
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def arrow_schema(kind: T.StructType) -> pa.Schema:
    return to_arrow_schema(kind)


def _sent(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out: list[dict] = []
    for row in rows:
        out.append(row)
        if len(out) >= _SENT:
            yield arrow_rows(out, schema)
            out = []
    if out:
        yield arrow_rows(out, schema)


def range_parts(df: DataFrame, order: str | Column | Sequence[str | Column], name: str = "ranges") -> DataFrame:
    """df, written, with _p: the number of its range of the order. All rows of a lower range come before those of a higher one."""
    by = as_columns(order)
    return materialise(df.repartitionByRange(*by).withColumn("_p", F.spark_partition_id()), name)


def _chains(parts: DataFrame) -> list[tuple[int, int]]:
    """First and last range of each task: consecutive ranges of at most CHAIN_ROWS rows together."""
    counts = sorted((r["_p"], r["count"]) for r in parts.groupBy("_p").count().collect())  # a row a partition
    out: list[tuple[int, int]] = []
    rows = 0
    for p, n in counts:
        if out and rows + n <= CHAIN_ROWS:
            out[-1], rows = (out[-1][0], p), rows + n
        else:
            out.append((p, p))
            rows = n
    return out


def global_fold(parts: DataFrame, order: str | Column | Sequence[str | Column], initial: Callable[[], object], step: Step | None, schema: T.StructType | str, finish: Callable[[object], Iterable[dict]] = lambda state: (), batch_step: BatchStep | None = None) -> DataFrame:
    """Outputs of the fold of parts, as range_parts gives them, in the order."""
    by, kind = as_columns(order), struct_type(schema)
    arrow, spark = arrow_schema(kind), parts.sparkSession
    chains = _chains(parts)
    carried_arrow = pa.schema([*arrow, pa.field("_state", pa.binary())])
    carried = T.StructType([*(T.StructField(f.name, f.dataType, True, f.metadata) for f in kind), T.StructField("_state", T.BinaryType())])  # all null beside a state

    def folded(batches: Iterator[pa.RecordBatch], state: object, over: list) -> Iterator[dict]:
        for batch in batches:
            if batch_step:
                state, emitted = batch_step(state, batch) if batch.num_rows else (state, ())
                yield from emitted
            else:
                for row in batch.to_pylist():
                    state, emitted = step(state, row)
                    yield from emitted
        over.append(state)

    def last(first_state: bytes | None) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            over: list = []
            yield from _sent(folded(batches, pickle.loads(first_state) if first_state else initial(), over), arrow)
            yield from _sent(finish(over[0]), arrow)

        return run

    def inner(first_state: bytes | None) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            over: list = []
            yield from _sent(folded(batches, pickle.loads(first_state) if first_state else initial(), over), carried_arrow)
            # As the step itself: a class that travelled here by value cannot be pickled by name.
            yield arrow_rows([{"_state": cloudpickle.dumps(over[0])}], carried_arrow)

        return run

    def of(chain: tuple[int, int]) -> DataFrame:
        rows = parts.filter(F.col("_p").between(*chain))
        return rows.coalesce(1).sortWithinPartitions(*by).drop("_p")  # sorted in the one task, so no order of files matters

    if not chains:
        return spark.createDataFrame([], kind)
    state, out = None, None
    for chain in chains[:-1]:
        done = materialise(of(chain).mapInArrow(inner(state), carried), "chain")
        state = bytes(done.filter("_state is not null").select("_state").first()[0])  # one state
        rows = done.filter("_state is null").drop("_state")
        out = rows if out is None else out.unionByName(rows)
    rows = of(chains[-1]).mapInArrow(last(state), kind)
    return rows if out is None else out.unionByName(rows)


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Column | Sequence[str | Column],
    initial: Callable[[], object],
    step: Step,
    schema: T.StructType | str,
    finish: Callable[[object], Iterable[dict]] = lambda state: (),
) -> DataFrame:
    """Outputs of the fold, as rows of schema. Column names of key columns in outputs are the step's affair. Null is a key of its own."""
    by, keys, kind = as_columns(order), list(keys), struct_type(schema)
    if not keys:
        return global_fold(range_parts(df, by, "sequence"), by, initial, step, kind, finish)
    arrow = arrow_schema(kind)

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, state, open_ = None, None, False
        for batch in batches:
            for row in batch.to_pylist():
                key = [row[k] for k in keys]
                if not open_ or key != now:
                    if open_:
                        yield from finish(state)
                    now, state, open_ = key, initial(), True
                state, out = step(state, row)
                yield from out
        if open_:
            yield from finish(state)

    return df.repartition(*keys).sortWithinPartitions(*keys, *by).mapInArrow(lambda batches: _sent(emitted(batches), arrow), kind)


def array_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], zero: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None, name: str = "state") -> DataFrame:
    """The same inside the engine, for groups known to be small: a higher-order fold over a key's sorted rows."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *(c for c in columns if c not in order))))
    grouped = df.groupBy(*keys).agg(rows.alias("_rows"))
    return grouped.select(*keys, F.aggregate("_rows", zero, step, finish).alias(name) if finish else F.aggregate("_rows", zero, step).alias(name))
