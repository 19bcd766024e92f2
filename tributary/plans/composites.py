"""Reusable subgraphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..operators.tokens import chunk_by_budget, collect_by_input, perform
from .flow import Flow


def map_reduce(flow: Flow, prefix: str, key: str, order: str, item: str, render: Callable, budget: int, map_provider: Callable[[str], str], reduce_provider: Callable[[str], str]) -> tuple[str, str]:
    """Chunk, map, collect, finalise: four stages; returns the entry and exit."""
    chunk = flow.transform(f"{prefix}-chunk", lambda df: chunk_by_budget(df, [key], order, item, render, budget))

    def mapped(df):
        return perform(df.select(key, "chunk_index", "chunk_count", F.array_join("rendered_items", "\n").alias("prompt")), "prompt", map_provider)

    def collected(df):
        status = F.when(F.col("_error_kind").isNull(), "ok").otherwise("failed")
        partials = df.select(key, "chunk_index", F.col("reply").alias("value"), status.alias("status"))
        return collect_by_input(df.select(key, "chunk_count"), partials, key, "chunk_index", "value")

    def final(df):
        return perform(df.withColumn("prompt", F.array_join("values", "\n")), "prompt", reduce_provider, "result")

    flow.transform(f"{prefix}-map", mapped)
    flow.stateful(f"{prefix}-collect", collected)
    end = flow.transform(f"{prefix}-finalise", final)
    flow.edges(f"{prefix}-chunk |> {prefix}-map |> {prefix}-collect |> {prefix}-finalise")
    return chunk, end
