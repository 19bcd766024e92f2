"""Token budgets: estimates, chunking, map-reduce over chunks, inference.

Estimates are expressions. Packing is greedy in order and hence sequential within a group: groups are dealt by key,
and a task streams a group's items with one open chunk in memory.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FatalError, Lanes, marked, route
from ..storage import materialise
from .fold import ordered_fold

#: Fixed values of the chat estimate: tokens a message, a request, and for JSON output.
PER_MESSAGE, PER_REQUEST, PER_JSON_OUTPUT = 4, 8, 16


@dataclass(frozen=True)
class HeuristicEstimator:
    """Tokens as UTF-8 bytes over bytes per token, rounded up."""

    bytes_per_token: float = 4.0

    def __post_init__(self):
        if not math.isfinite(self.bytes_per_token) or self.bytes_per_token <= 0:
            raise ValueError("bytes per token must be finite and positive")

    def text(self, column: Column | str) -> Column:
        return F.ceil(F.octet_length(column) / F.lit(self.bytes_per_token)).cast("long")

    def of(self, text: str) -> int:
        return math.ceil(len(text.encode()) / self.bytes_per_token)

    def chat(self, messages: DataFrame, keys: Sequence[str], text: str, tools: str | None = None, schema: str | None = None, json_output: bool = False) -> DataFrame:
        """keys, estimated_tokens: content bytes with tool and schema JSON, per-message and per-request overheads."""
        size = F.coalesce(F.octet_length(text), F.lit(0))
        extra = [F.coalesce(F.octet_length(F.max(c)), F.lit(0)) for c in (tools, schema) if c]
        grouped = messages.groupBy(*keys).agg(F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_messages"), sum(extra, F.lit(0)).alias("_extra"))
        total = F.ceil((F.col("_bytes") + F.col("_extra")) / F.lit(self.bytes_per_token)) + PER_MESSAGE * F.col("_messages") + PER_REQUEST + (PER_JSON_OUTPUT if json_output else 0)
        return grouped.select(*keys, total.cast("long").alias("estimated_tokens"))


def tokenizer_estimate(column: Column | str, path: str | None, fallback: HeuristicEstimator = HeuristicEstimator()) -> tuple[Column, str | None]:
    """Exact token counts from a tokenizer file, or the heuristic and why it is used instead."""
    try:
        from tokenizers import Tokenizer

        if not path:
            raise FileNotFoundError("no tokenizer file given")
        Tokenizer.from_file(path)
    except Exception as error:  # the library reports a bad file by a bare Exception
        return fallback.text(column), f"heuristic: {error}"

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = Tokenizer.from_file(path)
        for s in batches:
            yield s.map(lambda x: None if x is None else len(tokenizer.encode(x, add_special_tokens=False).ids)).astype("Int64")

    return counted(column), None


def remaining_budget(budget: Column | int, estimate: Column) -> Column:
    return F.greatest(F.lit(0), (F.lit(budget) if isinstance(budget, int) else budget) - estimate)


@dataclass(frozen=True)
class ChatBudget:
    """Tokens left for the one variable part of a prompt."""

    context: int
    reserved_output: int = 0
    safety: int = 0
    overhead: int = 0

    def plan(self, template: str, slot: str = "{items}", fixed_tokens: int = 0) -> int:
        if template.count(slot) != 1:
            raise ValueError("a template needs exactly one variable slot")
        return max(0, self.context - self.reserved_output - self.safety - self.overhead - fixed_tokens)


def split_to_budget(df: DataFrame, keys: Sequence[str], order: str, tokens: str, budget: int) -> DataFrame:
    """keys, ordinal (from 0 in order), tokens, grp, oversize: greedy in-order packing.

    An item above the budget closes the open group and is a group of its own, marked oversize.
    """
    if budget <= 0:
        raise ValueError("the budget must be positive")
    kinds = {f.name: f for f in df.schema.fields}
    schema = T.StructType([*(kinds[k] for k in keys), T.StructField(order, kinds[order].dataType), *(T.StructField(n, T.LongType()) for n in ("ordinal", "tokens", "grp")), T.StructField("oversize", T.BooleanType())])

    def step(state, row):
        n, group, used = state  # group -1: none yet; used 0: none open
        size = int(row[tokens])
        if size > budget:
            group, used, big = group + 1, 0, True
        elif used and used + size <= budget:
            used, big = used + size, False
        else:
            group, used, big = group + 1, max(size, 1) if not size else size, False
        out = {**{k: row[k] for k in keys}, order: row[order], "ordinal": n, "tokens": size, "grp": group, "oversize": big}
        return (n + 1, group, used), [out]

    return ordered_fold(df.select(*keys, order, tokens) if order != tokens else df, keys, order, lambda: (0, -1, 0), step, schema)


@dataclass(frozen=True)
class ChunkPolicy:
    """What becomes of an item above the budget: error, or rendered again at greater depths, then fail or exclude."""

    oversize: str = "error"
    max_depth: int = 3
    min_progress: int = 1
    exhausted: str = "fail"

    def __post_init__(self):
        if self.oversize not in ("error", "rerender") or self.exhausted not in ("fail", "exclude"):
            raise ValueError("oversize is error or rerender; exhausted is fail or exclude")


class ChunkPlanner:
    """Chunks of one seed's items, item by item: greedy and in order; a change of depth or max_items closes a chunk.

    Holds the open chunk and what was excluded since the last one closed.
    """

    def __init__(self, render: Callable[[object, int], str], budget: int, max_items: int | None = None, policy: ChunkPolicy = ChunkPolicy(), estimate: Callable[[str], int] | None = None):
        if budget <= 0 or (max_items is not None and max_items <= 0):
            raise ValueError("budget and max_items must be positive")
        self.render, self.budget, self.max_items, self.policy = render, budget, max_items, policy
        self.estimate = estimate or HeuristicEstimator().of
        self.items = self.closed = 0
        self.open: dict | None = None
        self.excluded: list[dict] = []

    def _sized(self, item: object, depth: int) -> tuple[str, int]:
        text = self.render(item, depth)
        return text, self.estimate(text)

    def _fitted(self, item: object) -> tuple[int, str, int] | str:
        """Depth, text and size of an item at the first depth that fits, or why there is none."""
        depth = 0
        text, size = self._sized(item, 0)
        while size > self.budget:
            if self.policy.oversize == "error":
                raise ValueError(f"item {self.items} takes {size} tokens of {self.budget}")
            if depth >= self.policy.max_depth:
                return "MaxDepthExceeded"
            new_text, new_size = self._sized(item, depth + 1)
            if size - new_size < self.policy.min_progress:
                return "NoProgress"
            depth, text, size = depth + 1, new_text, new_size
        return depth, text, size

    def _close(self) -> list[dict]:
        if self.open is None:
            return []
        done, self.open = {**self.open, "excluded": self.excluded}, None
        self.excluded = []
        self.closed += 1
        return [done]

    def add(self, item: object) -> list[dict]:
        """The chunk that this item closes, if any."""
        fitted = self._fitted(item)
        if isinstance(fitted, str):
            if self.policy.exhausted == "fail":
                raise ValueError(f"item {self.items}: {fitted}")
            self.excluded.append({"ordinal": self.items, "reason": fitted})
            self.items += 1
            return []
        depth, text, size = fitted
        now, done = self.open, []
        if now is None or now["depth"] != depth or now["estimated_tokens"] + size > self.budget or (self.max_items and len(now["item_ordinals"]) >= self.max_items):
            done = self._close()
            self.open = {"chunk_index": self.closed, "estimated_tokens": 0, "depth": depth, "item_ordinals": [], "rendered_items": []}
        self.open["estimated_tokens"] += size
        self.open["item_ordinals"].append(self.items)
        self.open["rendered_items"].append(text)
        self.items += 1
        return done

    def finish(self) -> list[dict]:
        return self._close()


def plan_chunks(items: Sequence[object], render: Callable[[object, int], str], budget: int, max_items: int | None = None, policy: ChunkPolicy = ChunkPolicy(), estimate: Callable[[str], int] | None = None) -> tuple[list[dict], list[dict]]:
    """Chunks of one seed's items, and what was excluded with its reason. ChunkPlanner is the same item by item."""
    planner = ChunkPlanner(render, budget, max_items, policy, estimate)
    chunks = [c for item in items for c in planner.add(item)] + planner.finish()
    excluded = sorted([e for c in chunks for e in c.pop("excluded")] + planner.excluded, key=lambda e: e["ordinal"])
    return [{**c, "chunk_count": len(chunks)} for c in chunks], excluded


def pieces(text: str | None, budget: int, bytes_per_token: float = 4.0) -> list[str]:
    """text cut into pieces of at most budget tokens by the heuristic, between characters; joined they are the text. Null has none."""
    limit = math.floor(budget * bytes_per_token)
    if limit < 4:
        raise ValueError("a piece must hold any one character")
    data, at, out = (text or "").encode(), 0, []
    while len(data) - at > limit:
        end = at + limit
        while data[end] & 0xC0 == 0x80:  # inside a character
            end -= 1
        out.append(data[at:end].decode())
        at = end
    return [] if text is None else [*out, data[at:].decode()]


def split_items(df: DataFrame, order: str, item: str, budget: int, bytes_per_token: float = 4.0) -> DataFrame:
    """df with a row for each piece of item; order becomes a struct of itself and the piece's number."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda text: pieces(text, budget, bytes_per_token))

    rest = [c for c in df.columns if c not in (order, item)]
    parts = df.select(*rest, F.col(order).alias("_order"), F.posexplode(cut(item)).alias("_piece", item))
    return parts.select(*rest, F.struct(F.col("_order").alias(order), F.col("_piece").alias("piece")).alias(order), item)


CHUNK = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("chunk_index", "chunk_count", "estimated_tokens", "depth")] + [T.StructField("item_ordinals", T.ArrayType(T.LongType())), T.StructField("rendered_items", T.ArrayType(T.StringType())), T.StructField("excluded", T.StringType())]
)


def chunk_by_budget(df: DataFrame, keys: Sequence[str], order: str, item: str, render: Callable[[object, int], str], budget: int, max_items: int | None = None, policy: ChunkPolicy = ChunkPolicy(), bytes_per_token: float = 4.0) -> DataFrame:
    """keys and chunk columns: the chunks of each seed (group); excluded holds the items left out since the chunk before, as JSON.

    A seed's items stream through one task in order, which holds the open chunk only. The written chunks are counted per seed for chunk_count. Items excluded
    after a seed's last chunk come in a row of their own, with a null chunk_index, so that none goes unseen.
    """
    kind = T.StructType([*(df.schema[k] for k in keys), *(f for f in CHUNK.fields if f.name != "chunk_count")])
    estimate = HeuristicEstimator(bytes_per_token).of

    def shown(state, chunks):
        return [{**state[0], **c, "excluded": json.dumps(c["excluded"])} for c in chunks]

    def step(state, row):
        state = state or ({k: row[k] for k in keys}, ChunkPlanner(render, budget, max_items, policy, estimate))
        return state, shown(state, state[1].add(row[item]))

    def finish(state):
        if state is None:
            return []
        rest = shown(state, state[1].finish())
        return rest + ([{**state[0], "excluded": json.dumps(state[1].excluded)}] if state[1].excluded else [])

    chunks = materialise(ordered_fold(df.select(*keys, *({order, item} - set(keys))), keys, order, lambda: None, step, kind, finish), "chunks")
    counted = chunks.groupBy(*keys).agg(F.count("chunk_index").alias("chunk_count")).select(*(F.col(k).alias(f"_{k}") for k in keys), "chunk_count")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return chunks.join(counted, same).select(*keys, *CHUNK.names)


def collect_by_input(manifests: DataFrame, partials: DataFrame, job: str, index: str, value: str, status: str = "status") -> DataFrame:
    """Map-reduce collector: manifests(job, chunk_count), partials(job, index, value, status ok or failed).

    One row per job: values in the order of their chunks whatever order they came in, or failed with the failed indices. A job's values are one
    array, so together they must fit in a row (2 GB) and, with a few copies, in a task's memory.
    Exact duplicates count once; two different results for one chunk are a conflict, too few a job
    left unfinished: both raise when read, as neither has a right result.
    """
    once = partials.select(job, index, value, status).distinct()
    failed = F.array_sort(F.collect_list(F.when(F.col(status) != "ok", F.col(index))))
    gathered = once.groupBy(job).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(index, value))), lambda x: x[value]).alias("values"), failed.alias("failed_indices"), F.count(F.lit(1)).alias("_rows"), F.countDistinct(index).alias("_chunks")
    )
    joined = manifests.select(job, "chunk_count").distinct().join(gathered, job, "left")
    fault = F.when(F.coalesce("_rows", F.lit(0)) > F.coalesce("_chunks", F.lit(0)), "conflicting results for a chunk").when(F.coalesce("_chunks", F.lit(0)) < F.col("chunk_count"), "an unfinished job")
    checked = F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.lit(" of job "), F.col(job).cast("string")))).otherwise(F.when(F.size("failed_indices") > 0, "failed").otherwise("ok"))
    out = joined.withColumn("status", checked.cast("string"))
    return out.select(job, "chunk_count", "status", F.when(F.col("status") == "ok", F.col("values")).alias("values"), "failed_indices")


Provider = Callable[[str], str]


def perform(df: DataFrame, prompt: str, provider: Provider, reply: str = "reply") -> DataFrame:
    """df with a reply per row. Exceptions become marked rows of kind Remote, or of their own kind; a FatalError fails the stage."""
    base = marked(df)
    schema = T.StructType([*base.schema.fields, T.StructField(reply, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))  # the others pass as they are
            replies, kinds, messages = [], columns["_error_kind"].to_pylist(), columns["_error_message"].to_pylist()
            for i, (text, kind) in enumerate(zip(columns[prompt].to_pylist(), kinds, strict=True)):
                out = None
                if kind is None:
                    try:
                        out = provider(text)
                    except FatalError:  # the stage fails
                        raise
                    except Exception as error:
                        kinds[i], messages[i] = getattr(error, "kind", "Remote"), str(error)
                replies.append(out)
            columns |= {name: pa.array(values, pa.string()) for name, values in (("_error_kind", kinds), ("_error_message", messages), (reply, replies))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return base.mapInArrow(run, schema)


def inference(df: DataFrame, prompt: str, provider: Provider, reply: str = "reply") -> Lanes:
    """One chat effect per row, with its errors routed."""
    return route(perform(df, prompt, provider, reply))


def embed(df: DataFrame, text: str, provider: Callable[[Iterable[str]], Iterable[Sequence[float]]], name: str = "embedding") -> DataFrame:
    """df with an array<float> per row; the provider takes batches."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(s: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in provider(s.tolist())], index=s.index)

    return df.withColumn(name, vectors(text))


def map_reduce(df: DataFrame, keys: str, order: str, item: str, render: Callable[[object, int], str], budget: int, map_provider: Provider, reduce_provider: Provider, **chunking) -> DataFrame:
    """Chunk, map each chunk, collect in chunk order, finalise: keys, status, values, failed_indices, result."""
    chunks = chunk_by_budget(df, [keys], order, item, render, budget, **chunking).filter("chunk_index is not null")
    prompts = chunks.select(keys, "chunk_index", "chunk_count", F.array_join("rendered_items", "\n").alias("prompt"))
    mapped = perform(prompts, "prompt", map_provider)
    partials = mapped.select(keys, "chunk_index", F.col("reply").alias("value"), F.when(F.col("_error_kind").isNull(), "ok").otherwise("failed").alias("status"))
    collected = collect_by_input(chunks.select(keys, "chunk_count"), partials, keys, "chunk_index", "value")
    final = perform(collected.withColumn("prompt", F.array_join("values", "\n")).filter("status = 'ok'"), "prompt", reduce_provider, "result")
    rest = collected.filter("status <> 'ok'")
    return final.drop("prompt").unionByName(rest, allowMissingColumns=True)


def decode_structured(df: DataFrame, column: str, schema: T.StructType) -> Lanes:
    """A model's JSON reply as a struct column `decoded`; replies that do not parse or lack a field are errors."""
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    parsed = marked(df).withColumn("decoded", F.from_json(column, loose))
    sound = F.col("decoded").isNotNull()
    for f in schema.fields:
        sound = sound & (F.col(f"decoded.{f.name}").isNotNull() if not f.nullable else F.lit(True))
    bad = F.col("_error_kind").isNull() & ~F.coalesce(sound & F.try_parse_json(F.col(column)).isNotNull(), F.lit(False))
    out = parsed.withColumn("_error_kind", F.when(bad, "Deserialization").otherwise(F.col("_error_kind"))).withColumn("_error_message", F.when(bad, "not of the declared structure").otherwise(F.col("_error_message")))
    return route(out)


def estimates_by(df: DataFrame, keys: Sequence[str], text: str, estimator: HeuristicEstimator = HeuristicEstimator()) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(estimator.text(text)).alias("estimated_tokens"))


Params = Mapping[str, object]
