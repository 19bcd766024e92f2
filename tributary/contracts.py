"""Edge contracts: what was written against what was read, expected, delivered."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Verdict:
    contract: str
    edge: str
    passed: bool
    detail: str


def transport(edge: str, written: DataFrame, read: DataFrame) -> Verdict:
    """Data rows written equal rows read."""
    a, b = written.count(), read.count()
    return Verdict("transport", edge, a == b, f"{a} written, {b} read")


def source(edge: str, rows: DataFrame, expected: int | None, seq: str = "_seq") -> Verdict:
    """The source's expected count equals its final sequence number (counted from 1)."""
    last = rows.agg(F.max(seq)).first()[0] or 0
    return Verdict("source", edge, expected is None or last == expected, f"{last} of {expected}")


def undelivered(rows: DataFrame, receipts: DataFrame, key: str = "_seq") -> DataFrame:
    """Keys of rows that no receipt names."""
    return rows.select(key).join(receipts.select(key), key, "left_anti")


def delivery(edge: str, rows: DataFrame, receipts: DataFrame, key: str = "_seq") -> Verdict:
    """Every row consumed by a sink has a receipt."""
    missing = undelivered(rows, receipts, key).count()
    return Verdict("delivery", edge, missing == 0, f"{missing} rows without a receipt")


@dataclass(frozen=True)
class Thresholds:
    """Fixed defaults of the divergence contract: a tumbling window in seconds, signals per data row in it, signals in one without data, and cycle depth."""

    window: float = 60.0
    signal_to_data_ratio: float = 10.0
    max_signals_when_no_data: int = 1000
    max_cycle_depth: int = 30


def divergent_windows(rows: DataFrame, ts: str, is_signal: Column | str, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """start, data, signals of the tumbling windows (anchored at the epoch) in which signals outgrow data."""
    test = F.expr(is_signal) if isinstance(is_signal, str) else is_signal
    counted = rows.groupBy(F.window(ts, f"{int(thresholds.window * 1000)} milliseconds").alias("w")).agg(F.count_if(~test).alias("data"), F.count_if(test).alias("signals"))
    over = F.when(F.col("data") > 0, F.col("signals") > F.lit(thresholds.signal_to_data_ratio) * F.col("data")).otherwise(F.col("signals") > thresholds.max_signals_when_no_data)
    return counted.filter(over).select(F.col("w.start").alias("start"), "data", "signals")


def divergence(edge: str, rows: DataFrame, depth: str = "_cycle_depth", limit: int = 30, ts: str | None = None, is_signal: Column | str | None = None, thresholds: Thresholds | None = None) -> Verdict:
    """No row has gone round a cycle more often than the limit; with ts and is_signal, no window has too many signals for its data."""
    limit = thresholds.max_cycle_depth if thresholds else limit
    most = (rows.agg(F.max(depth)).first()[0] or 0) if depth in rows.columns else 0
    if most > limit or ts is None or is_signal is None:
        return Verdict("divergence", edge, most <= limit, f"depth {most} of {limit}")
    windows = divergent_windows(rows, ts, is_signal, thresholds or Thresholds()).count()
    return Verdict("divergence", edge, windows == 0, f"depth {most} of {limit}, {windows} windows of too many signals")


def as_rows(spark: SparkSession, verdicts: Iterable[Verdict]) -> DataFrame:
    """Verdicts as a table."""
    return spark.createDataFrame([(v.contract, v.edge, v.passed, v.detail) for v in verdicts], "contract string, edge string, passed boolean, detail string")
