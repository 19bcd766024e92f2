"""PostgreSQL sink: one validated INSERT, bound per row, in batches, from the executors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_IDENTIFIER, MAX_BATCH = 63, 1000
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_INSERT = re.compile(r"\s*insert\s+into\s+([A-Za-z_\"][\w\"]*(?:\.[A-Za-z_\"][\w\"]*)?)\s*[(\s]", re.I)


def check_identifier(name: str) -> str:
    if not _NAME.fullmatch(name) or len(name) > MAX_IDENTIFIER:
        raise ValueError(f"not an identifier: {name!r}")
    return name


def check_insert(statement: str, table: str) -> str:
    """The statement, if it is a single INSERT into the declared table."""
    text = statement.strip().removesuffix(";").strip()
    if ";" in text:
        raise ValueError("one statement only")
    found = _INSERT.match(text + " ")
    if not found:
        raise ValueError("the statement must be an INSERT INTO")
    parts = [check_identifier(p) for p in table.split(".")]
    if found[1].replace('"', "").lower() != ".".join(parts).lower():
        raise ValueError(f"the statement writes {found[1]}, not {table}")
    return text


class PostgresSink:
    """connect() -> DB-API connection, made once per partition. Rows are inserted at least once: a retried task
    inserts again, so the sink is duplicate-sensitive unless the statement itself ignores conflicts."""

    def __init__(self, statement: str, table: str, columns: Sequence[str], connect: Callable[[], object], batch: int = 500, idempotent: bool = False):
        if not 0 < batch <= MAX_BATCH:
            raise ValueError(f"batches have 1 to {MAX_BATCH} rows")
        self.statement, self.columns, self.connect, self.batch = check_insert(statement, table), list(columns), connect, batch
        self.redelivery = "safe" if idempotent else "duplicate_sensitive"

    def write(self, df: DataFrame, order: str | None = None) -> int:
        statement, columns, connect, size = self.statement, self.columns, self.connect, self.batch

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            connection, n = connect(), 0
            try:
                cursor = connection.cursor()
                for batch in batches:
                    rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
                    for i in range(0, len(rows), size):
                        cursor.executemany(statement, rows[i : i + size])
                    n += len(rows)
                connection.commit()
            finally:
                connection.close()
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

        return sum(r["n"] for r in df.select(*columns).mapInArrow(run, "n long").collect())  # one row per partition
