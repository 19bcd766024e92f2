"""Sink connectors: a writer per partition with open, write, flush and drain, and their receipts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.fold import arrow_rows, arrow_schema, struct_type

#: One row a partition: what its writer took, and its error if it failed.
WRITTEN = "partition int, rows long, flushes long, error string"


class SinkWriter:
    """Takes the rows of one partition on an executor. A partition that is retried gets a new writer and its rows again."""

    def write(self, row: dict) -> None:
        raise NotImplementedError

    def flush(self) -> None:
        """Called after each batch of rows."""

    def drain(self) -> None:
        """Called after the last row; then the writer is closed."""

    def close(self) -> None:
        """Called in any case."""


class SinkConnector:
    """open(partition) gives a writer; the connector itself travels to the executors."""

    redelivery = "undeclared"

    def open(self, partition: int) -> SinkWriter:
        raise NotImplementedError

    def write(self, df: DataFrame, order: str | None = None) -> list[dict]:
        """Write df and give a receipt a partition; in order within partitions where an order is given. A writer's error fails the job."""
        rows = df.repartitionByRange(order).sortWithinPartitions(order) if order else df
        arrow = arrow_schema(struct_type(WRITTEN))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            partition = TaskContext.get().partitionId()
            writer, n, flushes = self.open(partition), 0, 0
            try:
                for batch in batches:
                    for row in batch.to_pylist():
                        writer.write(row)
                        n += 1
                    writer.flush()
                    flushes += 1
                writer.drain()
            finally:
                writer.close()
            yield arrow_rows([{"partition": partition, "rows": n, "flushes": flushes}], arrow)

        return [r.asDict() for r in rows.mapInArrow(run, WRITTEN).collect()]  # a row a partition
