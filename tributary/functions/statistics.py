"""Percentiles, histograms and mergeable sketches."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LATENCY_PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def percentiles(df: DataFrame, value: str, keys: list[str] | None = None, exact: bool = False, accuracy: int = 10_000) -> DataFrame:
    """One row per key with p50 to p999. Approximate percentiles are mergeable and bounded; exact ones are for small groups."""
    of = (lambda q: F.percentile(value, F.lit(q))) if exact else (lambda q: F.percentile_approx(value, q, accuracy))
    return df.groupBy(*(keys or [])).agg(*(of(q).alias(name) for name, q in LATENCY_PERCENTILES.items()))


def histogram(df: DataFrame, value: str, bounds: list[float], keys: list[str] | None = None) -> DataFrame:
    """Cumulative bucket counts (le), with count and sum, as one row per key and bound."""
    grouped = df.groupBy(*(keys or [])).agg(*(F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)), F.count(value).alias("count"), F.sum(value).alias("sum"))
    buckets = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)), F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("n")))
    return grouped.select(*(keys or []), "count", "sum", F.explode(buckets).alias("_x")).select(*(keys or []), F.col("_x.le").alias("le"), F.col("_x.n").alias("n"), "count", "sum")


def distinct_sketch(column: str) -> Column:
    """Mergeable distinct-count sketch; snapshots merge with merge_sketches and read with sketch_estimate."""
    return F.hll_sketch_agg(column)


def merge_sketches(column: str) -> Column:
    return F.hll_union_agg(column)


def sketch_estimate(column: str | Column) -> Column:
    return F.hll_sketch_estimate(column)


#: Version of the snapshots below; a snapshot of another version is refused.
SNAPSHOT_VERSION = 1


@dataclass(frozen=True)
class Snapshot:
    """A sketch's state with what must agree for a merge: its kind, the seed of its hashes and the version of its format."""

    kind: str
    data: bytes
    seed: int = 0
    version: int = SNAPSHOT_VERSION

    def check(self, other: Snapshot) -> None:
        if (self.kind, self.seed, self.version) != (other.kind, other.seed, other.version):
            raise ValueError(f"cannot merge {self.kind} (seed {self.seed}, version {self.version}) with {other.kind} (seed {other.seed}, version {other.version})")

    def to_bytes(self) -> bytes:
        head = json.dumps({"kind": self.kind, "seed": self.seed, "version": self.version}, sort_keys=True).encode()
        return len(head).to_bytes(4, "big") + head + self.data

    @classmethod
    def from_bytes(cls, raw: bytes) -> Snapshot:
        n = int.from_bytes(raw[:4], "big")
        head = json.loads(raw[4 : 4 + n])
        if head["version"] != SNAPSHOT_VERSION:
            raise ValueError(f"a snapshot of version {head['version']}, not {SNAPSHOT_VERSION}")
        return cls(data=raw[4 + n :], **head)


def distinct_snapshot(df: DataFrame, column: str, seed: int = 0) -> Snapshot:
    """Distinct-count sketch of a column under a seed (values are hashed with it first)."""
    row = df.agg(F.hll_sketch_agg(F.xxhash64(F.lit(seed), F.col(column))).alias("s")).first()
    return Snapshot("distinct", bytes(row["s"]), seed)


def merge_snapshots(spark: SparkSession, *snapshots: Snapshot) -> Snapshot:
    """One snapshot of all; kinds, seeds and versions must agree."""
    first, *rest = snapshots
    for other in rest:
        first.check(other)
    data = spark.createDataFrame([(bytearray(s.data),) for s in snapshots], "s binary").agg(F.hll_union_agg("s").alias("s")).first()["s"]
    return Snapshot(first.kind, bytes(data), first.seed, first.version)


def snapshot_estimate(spark: SparkSession, snapshot: Snapshot) -> int:
    return spark.createDataFrame([(bytearray(snapshot.data),)], "s binary").select(F.hll_sketch_estimate("s")).first()[0]
