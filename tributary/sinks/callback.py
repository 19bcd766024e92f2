"""Sinks from functions, and delivery receipts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..operators.fold import arrow_rows, arrow_schema, struct_type

RECEIPT = "_seq long, status string, method string, bytes long, items long, error string"


class CallbackSink:
    """function(row) on the driver, row by row in order. idempotent() declares that repeating is safe."""

    def __init__(self, function: Callable[[Row], object], method: str = "callback"):
        self.function, self.method, self.redelivery = function, method, "undeclared"

    def idempotent(self) -> CallbackSink:
        self.redelivery = "safe"
        return self

    def non_idempotent(self) -> CallbackSink:
        self.redelivery = "duplicate_sensitive"
        return self

    def write(self, df: DataFrame, order: str | None = None) -> int:
        n = 0
        for row in (df.orderBy(order) if order else df).toLocalIterator():
            self.function(row)
            n += 1
        return n


def deliver(df: DataFrame, function: Callable[[dict], object], method: str = "callback", seq: str = "_seq") -> DataFrame:
    """Receipts of function(row) for each row, run on the executors: success, or failed with its error.

    The function runs again if a task is retried: it must be safe to repeat. Write the receipts once, then read those.
    """

    arrow = arrow_schema(struct_type(RECEIPT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                error = None
                try:
                    function(row)
                except Exception as e:
                    error = str(e)
                out.append({"_seq": row[seq], "status": "failed" if error else "success", "method": method, "bytes": len(str(row)), "items": 0 if error else 1, "error": error})
            yield arrow_rows(out, arrow)

    return df.mapInArrow(run, RECEIPT)


def receipt_totals(receipts: DataFrame) -> DataFrame:
    """status, n, and the run's overall state: success, partial or failed."""
    return receipts.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def redelivery_gate(sinks: dict[str, object], allow: set[str] = frozenset()) -> None:
    """Refuse to send archived rows again to sinks that are duplicate-sensitive or undeclared, unless allowed by name."""
    bad = [n for n, s in sinks.items() if getattr(s, "redelivery", "undeclared") != "safe" and n not in allow]
    if bad:
        raise ValueError(f"these sinks may not be written again: {sorted(bad)}")
