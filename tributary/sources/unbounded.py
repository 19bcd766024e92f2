"""Unbounded sources as streams: async producers, receivers, polls, and custom readers.

Producers are Python data sources: Spark plans offsets, and asks for what lies beyond the last one. An offset is the number of batches that have been
produced, so a restarted query goes on with the next batch.
"""

from __future__ import annotations

import asyncio
import json
import queue
import threading
import uuid
from collections.abc import Awaitable, Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..operators.fold import struct_type
from ..storage import write_text

Schema = T.StructType | str


def batch_stream(spark: SparkSession, produce: Callable[[int], Iterable[tuple] | None], schema: Schema) -> DataFrame:
    """Rows of produce(0), produce(1), ... as a stream; None: nothing new yet. produce must give the same batch for the same number."""
    kind, name = struct_type(schema), f"tributary_{uuid.uuid4().hex[:8]}"

    class Reader(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"batch": 0}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            rows = produce(start["batch"])
            return (iter(()), start) if rows is None else (iter([tuple(r) for r in rows]), {"batch": start["batch"] + 1})

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            for number in range(start["batch"], end["batch"]):
                yield from (tuple(r) for r in produce(number) or ())

        def commit(self, end: dict) -> None:
            pass

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> T.StructType:
            return kind

        def simpleStreamReader(self, schema: T.StructType) -> Reader:
            return Reader()

    spark.dataSource.register(Source)
    return spark.readStream.format(name).load()


def async_infinite(spark: SparkSession, produce: Callable[[int], Awaitable[Iterable[tuple] | None]], schema: Schema) -> DataFrame:
    """batch_stream of an async producer."""
    return batch_stream(spark, lambda number: asyncio.run(produce(number)), schema)


def fallible_stream(spark: SparkSession, produce: Callable[[int], Iterable[tuple] | None], schema: Schema) -> DataFrame:
    """batch_stream whose producer may raise: such a batch is one row, null but for _error_kind and _error_message, and the stream goes on."""
    kind = struct_type(schema)
    full = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in kind.fields), T.StructField("_error_kind", T.StringType()), T.StructField("_error_message", T.StringType())])

    def marked(number: int) -> Iterable[tuple] | None:
        try:
            rows = produce(number)
        except Exception as error:
            return [(*[None] * len(kind.fields), getattr(error, "kind", "Unknown"), str(error))]
        return None if rows is None else [(*r, None, None) for r in rows]

    return batch_stream(spark, marked, full)


class Receiver:
    """Rows that a driver's thread receives, spooled below `path` and read as a stream: what has been spooled survives a restart.

    send(row) or put rows into `channel`; flush() writes what is held; close() stops the thread. The spool's files are the stream's back-pressure.
    """

    def __init__(self, spark: SparkSession, path: str, schema: Schema, batch: int = 1000, channel: queue.Queue | None = None):
        self.spark, self.path, self.kind, self.batch = spark, path.rstrip("/"), struct_type(schema), batch
        self.channel: queue.Queue = channel or queue.Queue()
        self._files = 0
        self._lock = threading.Lock()
        self._thread: threading.Thread | None = None
        self._stop = threading.Event()

    def send(self, row: dict) -> None:
        self.channel.put(row)

    def flush(self) -> int:
        """Spool what the channel holds, at most `batch` rows a file; returns the number of rows."""
        with self._lock:
            total = 0
            while True:
                rows = []
                while len(rows) < self.batch:
                    try:
                        rows.append(self.channel.get_nowait())
                    except queue.Empty:
                        break
                if not rows:
                    return total
                text = "".join(json.dumps(r, default=str) + "\n" for r in rows)
                write_text(self.spark, f"{self.path}/{self._files:012d}-{uuid.uuid4().hex[:8]}.json", text)
                self._files += 1
                total += len(rows)

    def start(self, interval: float = 1.0) -> Receiver:
        """Flush every interval in a thread of the driver."""

        def run() -> None:
            while not self._stop.wait(interval):
                self.flush()

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()
        return self

    def close(self) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join()
        self.flush()

    def stream(self, max_files: int = 100) -> DataFrame:
        return self.spark.readStream.schema(self.kind).option("maxFilesPerTrigger", max_files).json(self.path)


def from_receiver(spark: SparkSession, channel: queue.Queue, path: str, schema: Schema, interval: float = 1.0) -> tuple[DataFrame, Receiver]:
    """The rows (dicts) that come through a channel, as a stream, and the receiver that drains it."""
    receiver = Receiver(spark, path, schema, channel=channel)
    receiver.flush()
    return receiver.stream(), receiver.start(interval)


def poll_stream(spark: SparkSession, fetch: Callable[[int], Iterable[tuple]], schema: Schema) -> DataFrame:
    """An unbounded poll: fetch(cycle) is one poll's rows; the query's trigger interval is the pause between polls."""
    return batch_stream(spark, fetch, schema)
