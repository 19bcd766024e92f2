"""Run journals: a directory per run, with a Parquet table per stage, error tables, deliveries and a manifest.

A stage's rows are written by Spark's commit protocol, so a table is there whole or not at all; the manifest is written last, by
rename. What has no manifest, or one whose status is not completed, is an incomplete archive.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Lanes, marked
from ..order import as_columns, causal_order, number_rows
from ..storage import exists, read_text, write_text

FORMAT = 1
#: From best to worst; a fan-in ends as its worst input does.
EOF_KINDS = ("natural", "truncated", "poison")


def worst_eof(*kinds: str) -> str:
    return max(kinds, key=EOF_KINDS.index, default="natural")


@dataclass
class Manifest:
    flow: str
    run: str
    stages: dict[str, dict] = field(default_factory=dict)
    config: dict = field(default_factory=dict)
    sinks: dict[str, str] = field(default_factory=dict)
    status: str = "running"
    replay_of: str | None = None
    cyclic: bool = False
    format: int = FORMAT


class Journal:
    """A run's directory."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _stage(self, stage: str, errors: bool = False) -> str:
        return f"{self.path}/{'_errors/' if errors else ''}{stage}"

    def write(self, stage: str, lanes: Lanes | DataFrame, order=None) -> DataFrame:
        """Write a stage's rows with their place _pos (from 1), and its error rows; returns the rows as read back."""
        data, errors = (lanes.data, lanes.errors) if isinstance(lanes, Lanes) else (lanes, None)
        data = marked(data).drop("_pos")
        data = data.withColumn("_pos", F.monotonically_increasing_id()) if order is None else number_rows(data, order, "_pos")
        data.write.mode("errorifexists").parquet(self._stage(stage))
        if errors is not None:
            errors.write.mode("errorifexists").parquet(self._stage(stage, errors=True))
        return self.read(stage)

    def read(self, stage: str, errors: bool = False) -> DataFrame:
        return self.spark.read.parquet(self._stage(stage, errors))

    def has(self, stage: str, errors: bool = False) -> bool:
        return exists(self.spark, self._stage(stage, errors))

    def in_order(self, stage: str) -> DataFrame:
        return self.read(stage).orderBy("_pos")

    def after(self, stage: str, pos: int) -> DataFrame:
        return self.read(stage).filter(F.col("_pos") > pos).orderBy("_pos")

    def at(self, stage: str, pos: int) -> DataFrame:
        return self.read(stage).filter(F.col("_pos") == pos)

    def last(self, stage: str, n: int) -> DataFrame:
        """The last n rows, latest first."""
        return self.read(stage).orderBy(F.desc("_pos")).limit(n)

    def by_id(self, stage: str, column: str, *ids: object) -> DataFrame:
        """Rows whose column has one of these values."""
        return self.read(stage).filter(F.col(column).isin(*ids))

    def causal(self, stage: str, clock: str = "_clock", event_id: str = "_event_id") -> DataFrame:
        """Rows with their causal number _seq (a linear extension of happened-before)."""
        return causal_order(self.read(stage), clock, event_id)

    def append_generation(self, stage: str, rows: DataFrame, generation: int, order) -> None:
        """Rows of a later generation, placed after all earlier ones (resuming a run)."""
        base = self.read(stage).agg(F.max("_pos")).first()[0] or 0
        placed = number_rows(marked(rows), as_columns(order), "_pos", base + 1).withColumn("_generation", F.lit(generation))
        placed.write.mode("append").option("mergeSchema", True).parquet(self._stage(stage))

    def save(self, manifest: Manifest) -> None:
        write_text(self.spark, f"{self.path}/run_manifest.json", json.dumps(asdict(manifest), indent=1, sort_keys=True))

    def manifest(self) -> Manifest:
        return Manifest(**json.loads(read_text(self.spark, f"{self.path}/run_manifest.json")))


class MemoryJournal(Journal):
    """A journal in the executors' memory (spilling to their disks), for runs that need no archive: gone with the application."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, "memory"
        self._tables: dict[str, DataFrame] = {}
        self._manifest: Manifest | None = None

    def write(self, stage: str, lanes: Lanes | DataFrame, order=None) -> DataFrame:
        data, errors = (lanes.data, lanes.errors) if isinstance(lanes, Lanes) else (lanes, None)
        if self.has(stage):
            raise ValueError(f"{stage} is written already")
        data = marked(data).drop("_pos")
        data = data.withColumn("_pos", F.monotonically_increasing_id()) if order is None else number_rows(data, order, "_pos")
        self._tables[self._stage(stage)] = data.persist(StorageLevel.MEMORY_AND_DISK)
        if errors is not None:
            self._tables[self._stage(stage, errors=True)] = errors.persist(StorageLevel.MEMORY_AND_DISK)
        return self.read(stage)

    def read(self, stage: str, errors: bool = False) -> DataFrame:
        return self._tables[self._stage(stage, errors)]

    def has(self, stage: str, errors: bool = False) -> bool:
        return self._stage(stage, errors) in self._tables

    def append_generation(self, stage: str, rows: DataFrame, generation: int, order) -> None:
        base = self.read(stage).agg(F.max("_pos")).first()[0] or 0
        placed = number_rows(marked(rows), as_columns(order), "_pos", base + 1).withColumn("_generation", F.lit(generation))
        self._tables[self._stage(stage)] = self.read(stage).unionByName(placed, allowMissingColumns=True).persist(StorageLevel.MEMORY_AND_DISK)

    def save(self, manifest: Manifest) -> None:
        self._manifest = manifest

    def manifest(self) -> Manifest:
        if self._manifest is None:
            raise FileNotFoundError("no manifest yet")
        return self._manifest

    def release(self) -> None:
        """Give the memory back."""
        for table in self._tables.values():
            table.unpersist()
        self._tables = {}


def open_archive(spark: SparkSession, path: str, allow_incomplete: bool = False) -> tuple[Journal, Manifest, str]:
    """Journal, manifest and EOF kind of an archived run; truncated where it is incomplete and that is allowed."""
    journal = Journal(spark, path)
    try:
        manifest = journal.manifest()
    except FileNotFoundError as error:
        raise ValueError(f"{path} has no manifest") from error
    if manifest.format != FORMAT:
        raise ValueError(f"{path} has format {manifest.format}, not {FORMAT}")
    if manifest.status == "completed":
        return journal, manifest, "natural"
    if not allow_incomplete:
        raise ValueError(f"{path} is {manifest.status}: an incomplete archive")
    return journal, manifest, "truncated"
