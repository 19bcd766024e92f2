"""Resuming a run: catch up on the archive, then go on live from its high-water mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..journal.runs import open_archive


def resume_source(spark: SparkSession, archive: str, stage: str, live: DataFrame, seq: str = "_seq") -> DataFrame:
    """Archived rows (generation 0) and the live rows after them (generation 1), ordered by generation and seq."""
    journal, manifest, _ = open_archive(spark, archive, allow_incomplete=True)
    if manifest.cyclic:
        raise ValueError("a flow with cycles cannot be resumed")
    old = journal.read(stage).drop("_pos")
    mark = old.agg(F.max(seq).alias("_mark"))
    fresh = live.crossJoin(F.broadcast(mark)).filter(F.col("_mark").isNull() | (F.col(seq) > F.col("_mark"))).drop("_mark")
    parts = [old.withColumn("_generation", F.lit(0)), fresh.withColumn("_generation", F.lit(1))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)
