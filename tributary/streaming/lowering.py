"""Structured Streaming forms: keyed accumulators with state, stream-static joins, sinks and run control.

State lives in the state store, partitioned by key and checkpointed; late data and event-time windows are Spark's own
(watermark), as an addition to the processing-time periods of the accumulators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.emission import Emission, EmitAlways
from ..operators.join import Exprs, latest


def running_group_by(stream: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Keyed aggregates; write with outputMode update (changed keys) or complete (all keys)."""
    return stream.groupBy(*keys).agg(*(c.alias(n) for n, c in aggs.items()))


def conflate_stream(stream: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The latest row per key, as an update stream."""
    others = [c for c in stream.columns if c not in keys]
    last = F.max_by(F.struct(*others), order).alias("_last")
    return stream.groupBy(*keys).agg(last).select(*keys, *(F.col(f"_last.{c}").alias(c) for c in others))


def stateful(
    stream: DataFrame,
    keys: Sequence[str],
    order: str,
    initial: Callable[[], tuple],
    accumulate: Callable[[tuple, dict], tuple],
    outputs: Callable[[tuple, tuple], Sequence[tuple]],
    output_schema: str,
    state_schema: str,
    emission: Emission = EmitAlways(),
    idle_seconds: float | None = None,
) -> DataFrame:
    """A keyed accumulator with an emission policy over a stream.

    State is a tuple of state_schema. outputs(key, state) gives rows. Within a micro-batch a key's rows are read in order of
    `order`. A policy that resets drops the state when it emits; with idle_seconds a key that gets no
    rows for so long emits and ends.
    """
    columns = [c.split()[0] for c in output_schema.split(",")]
    # pandas has no exact integers beside nulls: whole numbers travel as text and are read back here.
    whole = [f.name for f in stream.schema.fields if isinstance(f.dataType, T.IntegralType) and f.name not in keys]
    stream = stream.withColumns({c: F.col(c).cast("string") for c in whole}) if whole else stream

    def exact(row: dict) -> dict:
        return row | {c: None if pd.isna(row[c]) else int(row[c]) for c in whole}

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows_since, opened, *kept = state.get if state.exists else (0, None, *initial())
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame(list(outputs(key, tuple(kept))), columns=columns)
            return
        out, now = [], state.getCurrentProcessingTimeMs() / 1000 if idle_seconds or emission.resets else 0.0
        rows = [exact(row) for frame in frames for row in frame.to_dict("records")]
        for row in sorted(rows, key=lambda row: (row[order] is not None, row[order])):
            kept = accumulate(tuple(kept), row)
            rows_since += 1
            opened = now if opened is None else opened
            if emission.should_emit(rows_since, now - opened):
                out += outputs(key, tuple(kept))
                rows_since, opened = 0, None
                if emission.resets:
                    kept = initial()
        state.update((rows_since, opened, *kept))
        if idle_seconds:
            state.setTimeoutDuration(int(idle_seconds * 1000))
        yield pd.DataFrame(out, columns=columns)

    full = f"_rows long, _opened double, {state_schema}"
    # With a timeout, a query that runs what is available never finds itself done: only where it is asked for.
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_seconds else GroupStateTimeout.NoTimeout
    return stream.groupBy(*keys).applyInPandasWithState(run, output_schema, full, "append", timeout)


def enrich_stream(stream: DataFrame, reference: DataFrame, ref_key: str, stream_key: str, ref_order: str, exprs: Exprs | None = None, how: str = "inner") -> DataFrame:
    """Stream-static join with the latest reference values; how: inner or left (the stream is preserved)."""
    catalogue = latest(reference, ref_key, ref_order).select(F.col(ref_key).alias("_ref_key"), F.struct(*reference.columns).alias("ref"))
    joined = stream.join(catalogue, stream[stream_key] == F.col("_ref_key"), how)
    if exprs is None:
        return joined.select(*(stream[c] for c in stream.columns), *(F.col(f"ref.{c}").alias(c) for c in reference.columns if c not in stream.columns))
    return joined.select(*((F.expr(e) if isinstance(e, str) else e).alias(n) for n, e in exprs.items()))


def windowed(stream: DataFrame, ts: str, window: str, watermark: str, keys: Sequence[str] = (), slide: str | None = None, session: bool = False, **aggs: Column) -> DataFrame:
    """Event-time windows: tumbling, sliding or session, with a watermark for late rows."""
    over = F.session_window(ts, window) if session else F.window(ts, window, slide) if slide else F.window(ts, window)
    return stream.withWatermark(ts, watermark).groupBy(*keys, over.alias("w")).agg(*(c.alias(n) for n, c in aggs.items())).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *aggs)


@dataclass
class Handle:
    """Control of a running query."""

    query: StreamingQuery

    def stop_graceful(self) -> None:
        """Drain what has arrived, then stop."""
        self.query.processAllAvailable()
        self.query.stop()

    def stop_cancel(self) -> None:
        self.query.stop()

    def abort(self, reason: str) -> None:
        self.query.stop()
        raise RuntimeError(f"aborted: {reason}")

    def wait(self, seconds: float | None = None) -> bool:
        return bool(self.query.awaitTermination(seconds)) if seconds else bool(self.query.awaitTermination())


def start(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None] | None = None, path: str | None = None, mode: str = "append", once: bool = True) -> Handle:
    """Start a sink: a function per micro-batch (for sinks and effects, with its batch id), or Parquet files at path."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer
    if batch:
        return Handle(writer.foreachBatch(batch).start())
    return Handle(writer.format("parquet").start(path))
