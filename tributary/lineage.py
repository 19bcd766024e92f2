"""Lineage, correlation and flow latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Parents that a row keeps at most, and correlation ids of a merged row.
MAX_DEPTH, MAX_CORRELATIONS = 100, 100


def child_of(parent: Column | str, ancestors: Column | str | None = None, depth: int = MAX_DEPTH) -> Column:
    """Parents of a row derived from one row: that row, then its own parents, at most `depth`."""
    own = F.array(F.col(parent) if isinstance(parent, str) else parent)
    if ancestors is None:
        return own
    more = F.col(ancestors) if isinstance(ancestors, str) else ancestors
    return F.slice(F.concat(own, F.coalesce(more, F.array().cast("array<bigint>"))), 1, depth)


def latest_contributors(df: DataFrame, keys: list[str], seq: str, depth: int = MAX_DEPTH, name: str = "parents") -> DataFrame:
    """keys, name: the last `depth` contributors of each key in order of seq.

    Only those rows are gathered: a per-key rank drops the others first, so no task holds a hot key's rows as an array.
    """
    last = Window.partitionBy(*keys).orderBy(F.desc(seq))
    kept = df.withColumn("_rank", F.row_number().over(last)).filter(F.col("_rank") <= depth)
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_list(seq)).alias(name))


def merged_correlation(df: DataFrame, keys: list[str], correlation: str, seq: str, limit: int = MAX_CORRELATIONS) -> DataFrame:
    """keys, correlation (where all agree), correlations (sorted sample of the first `limit` seen), truncated."""
    first = df.filter(F.col(correlation).isNotNull()).groupBy(*keys, correlation).agg(F.min(seq).alias("_first"))
    by_age = Window.partitionBy(*keys).orderBy("_first", correlation)
    ranked = first.withColumn("_rank", F.row_number().over(by_age))
    sample = F.array_sort(F.collect_list(F.when(F.col("_rank") <= limit, F.col(correlation))))
    grouped = ranked.groupBy(*keys).agg(sample.alias("correlations"), F.count(F.lit(1)).alias("_n"), F.min(correlation).alias("_one"))
    return grouped.select(*keys, F.when(F.col("_n") == 1, F.col("_one")).alias("correlation"), "correlations", (F.col("_n") > limit).alias("truncated"))


def flow_latency(sink_time: str, source_time: str) -> Column:
    """Seconds from a row's source to its sink."""
    return (F.col(sink_time).cast("double") - F.col(source_time).cast("double")).alias("flow_latency_s")
