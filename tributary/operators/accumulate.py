"""Stateful accumulators and their emission.

Aggregates are Column expressions over the rows of a group (count, sum, max_by, ...), so they are partial before
the shuffle. Snapshots of a running global aggregate do not run in one task: rows are numbered in parallel
(order.number_rows), aggregated by emission chunk, and only the chunk totals are accumulated in order.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import ok_rows
from ..order import as_columns, numbered_rows
from ..order import seconds as time_seconds
from ..storage import materialise
from .emission import EmitAlways, Emission, EveryN, OnEof, TimeWindow
from .fold import global_fold, ordered_fold, range_parts

Order = str | Sequence[str]


@dataclass(frozen=True)
class Agg:
    """A mergeable aggregate: its partial value, how partials merge in order, and what is shown of the merged value."""

    partial: Callable[[], Column]
    merge: Callable[[str], Column]

    @staticmethod
    def count() -> Agg:
        return Agg(lambda: F.count(F.lit(1)), F.sum)

    @staticmethod
    def sum(value: str | Column) -> Agg:
        return Agg(lambda: F.sum(value), F.sum)

    @staticmethod
    def min(value: str | Column) -> Agg:
        return Agg(lambda: F.min(value), F.min)

    @staticmethod
    def max(value: str | Column) -> Agg:
        return Agg(lambda: F.max(value), F.max)

    @staticmethod
    def last(value: str | Column, order: str) -> Agg:
        """Value of the last row in order."""
        return Agg(lambda: F.max(F.struct(F.col(order).alias("o"), (F.col(value) if isinstance(value, str) else value).alias("v"))), F.max)

    @staticmethod
    def first(value: str | Column, order: str) -> Agg:
        return Agg(lambda: F.min(F.struct(F.col(order).alias("o"), (F.col(value) if isinstance(value, str) else value).alias("v"))), F.min)


def _shown(df: DataFrame, names: Sequence[str]) -> list[Column]:
    ordered = lambda t: isinstance(t, T.StructType) and t.names == ["o", "v"]
    return [F.col(f"{n}.v").alias(n) if ordered(df.schema[n].dataType) else F.col(n) for n in names]


@dataclass(frozen=True)
class _WithEmission:
    emission: Emission = OnEof()

    def with_emission(self, emission: Emission):
        return replace(self, emission=emission)

    def emit_on_eof(self):
        return self.with_emission(OnEof())

    def emit_every_n(self, n: int):
        return self.with_emission(EveryN(n))

    def emit_within(self, seconds: float):
        return self.with_emission(TimeWindow(seconds))

    def emit_always(self):
        return self.with_emission(EmitAlways())


def _period_step(seconds: float) -> Callable:
    """Periods of a batch of (o, t) in order, found by numpy: state is (order value, time) of the open period's first row, or None."""

    def step(state, batch):
        t, o, out, at = batch.column("t").to_numpy(zero_copy_only=False), batch.column("o"), [], 0
        reach = 64
        while at < len(t):
            if state is None:
                state = (o[at].as_py(), float(t[at]))
            # The closing row is looked for in growing steps: a period costs its own length.
            end = min(len(t), at + reach)
            hit = np.flatnonzero(t[at:end] - state[1] >= seconds)
            if len(hit):
                at += int(hit[0])
                out.append({"_first": state[0], "_last": o[at].as_py(), "_open": state[1], "_closed": True})
                state, reach = None, 64
                at += 1
            else:
                at, reach = end, reach * 2
        return state, out

    return step


def _periods(parts: DataFrame, seconds: float) -> DataFrame:
    """Periods of parts (o, t and _p of range_parts)."""
    kind = parts.schema["o"].dataType
    schema = T.StructType([T.StructField("_first", kind), T.StructField("_last", kind), T.StructField("_open", T.DoubleType()), T.StructField("_closed", T.BooleanType())])

    def finish(state):
        return [] if state is None else [{"_first": state[0], "_last": None, "_open": state[1], "_closed": False}]

    return global_fold(parts.select("o", "t", "_p"), "o", lambda: None, None, schema, finish, _period_step(seconds))


def periods(df: DataFrame, order: Order, ts: str, seconds: float) -> DataFrame:
    """_first, _last (order values), _open (seconds of the first row), _closed of each anchored period.

    Where a period ends decides where the next begins, so the two columns that decide it are read range by range, in numpy batches.
    Only that decision is sequential: rows are aggregated in parallel.
    """
    return _periods(range_parts(df.select(F.col(_one_order(order)).alias("o"), time_seconds(df, ts).alias("t")), "o", "times"), seconds)


def _one_order(order: Order) -> str:
    by = [order] if isinstance(order, str) else list(order)
    if len(by) != 1:
        raise ValueError("time windows take one unique order column")
    return by[0]


def in_periods(df: DataFrame, order: str, ts: str, seconds: float) -> DataFrame:
    """df with _period: the order value of its period's first row.

    A row belongs to the last period that began at or before it in the order, whatever its timestamp. Rows lie in ranges of the order, so within a range
    that is a window over its rows and the period starts in it, and what is open where a range begins is known from the starts of the ranges before.
    """
    order = _one_order(order)
    parts = range_parts(df.withColumn("_t", time_seconds(df, ts)), order, "rows")
    starts = materialise(_periods(parts.select(F.col(order).alias("o"), F.col("_t").alias("t"), "_p"), seconds).select(F.col("_first").alias("_s")), "periods")
    edges = parts.groupBy("_p").agg(F.min(order).alias("_low"), F.max(order).alias("_high"))  # a row a range
    placed = starts.join(F.broadcast(edges), F.col("_s").between(F.col("_low"), F.col("_high"))).select("_p", "_s")
    latest = edges.join(placed.groupBy("_p").agg(F.max("_s").alias("_m")), "_p", "left")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select("_p", F.max("_m").over(before).alias("_open"))
    rows = parts.select("_p", F.col(order).alias("_o"), F.lit(1).alias("_side"), F.lit(None).cast(starts.schema["_s"].dataType).alias("_s"), F.struct(*df.columns).alias("_row"))
    marks = placed.select("_p", F.col("_s").alias("_o"), F.lit(0).alias("_side"), "_s", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    seen = Window.partitionBy("_p").orderBy("_o", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.unionByName(marks).withColumn("_s", F.last("_s", ignorenulls=True).over(seen)).filter("_side = 1")
    out = found.join(F.broadcast(carried), "_p")
    return out.select(*(F.col("_row")[c].alias(c) for c in df.columns), F.coalesce("_s", "_open").alias("_period"))


@dataclass(frozen=True)
class Reduce(_WithEmission):
    """One global fold. No row where there was no input; with a policy, one row per emission and the final one."""

    aggs: Mapping[str, Agg] | None = None

    def apply(self, df: DataFrame, order: Order = "_seq", ts: str | None = None) -> DataFrame:
        df, names = ok_rows(df), list(self.aggs)
        partials = [a.partial().alias(n) for n, a in self.aggs.items()]
        if isinstance(self.emission, OnEof):
            out = df.agg(*partials, F.count(F.lit(1)).alias("_n")).filter("_n > 0")
            return out.select(*_shown(out, names))
        if isinstance(self.emission, TimeWindow):
            out = in_periods(df, order, ts, self.emission.seconds).groupBy("_period").agg(*partials)
            return out.select(*_shown(out, names), "_period")
        if not isinstance(self.emission, EveryN | EmitAlways):
            raise TypeError("custom policies run in custom(): an ordered fold")
        n = self.emission.n if isinstance(self.emission, EveryN) else 1
        numbered, total = numbered_rows(df, order, "_nth")
        chunks = numbered.groupBy(F.floor((F.col("_nth") - 1) / n).alias("_chunk")).agg(*partials, F.max("_nth").alias("_at"))
        out = running(chunks, "_chunk", {m: a.merge for m, a in self.aggs.items()}, carried=["_at"])
        # The last row is shown once more as the final state.
        shows = F.filter(F.array(F.when(F.col("_at") % n == 0, F.lit(False)), F.when(F.col("_at") == total, F.lit(True))), lambda x: x.isNotNull())
        out = out.withColumn("_terminal", F.explode(shows))
        return out.select(*_shown(out, names), F.col("_at").alias("_emitted_at"), "_terminal")


def running(df: DataFrame, order: str, merges: Mapping[str, Callable[[str], Column]], carried: Sequence[str] = (), block: int = 65_536) -> DataFrame:
    """Running merge of df's partial values in order of a dense long column, without one task for all.

    Blocks of `block` values are merged in parallel; block totals (one row each) are accumulated in order and
    joined back to their block.
    """
    local = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    totals = blocked.groupBy("_block").agg(*(m(n).alias(n) for n, m in merges.items()))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_block").alias("_b"), *(m(n).over(before).alias(f"_off_{n}") for n, m in merges.items()))
    joined = blocked.select(order, *carried, "_block", *(m(n).over(local).alias(n) for n, m in merges.items())).join(offsets, F.col("_block") == F.col("_b"))
    both = lambda n: F.array_compact(F.array(F.col(f"_off_{n}"), F.col(n)))
    return joined.select(order, *carried, *(_merge_two(merges[n], both(n), joined, n).alias(n) for n in merges))


def _merge_two(merge: Callable[[str], Column], pair: Column, df: DataFrame, name: str) -> Column:
    """merge of a pair of values, told by the aggregate's own name."""
    what = merge.__name__
    if what == "sum":
        kind = df.schema[name].dataType
        return F.when(F.size(pair) > 0, F.aggregate(pair, F.lit(0).cast(kind), lambda s, v: (s + v).cast(kind)))
    return F.array_max(pair) if what == "max" else F.array_min(pair)


@dataclass(frozen=True)
class GroupBy(_WithEmission):
    """A fold per key. Every emission shows every key seen so far; order of keys is by their first row."""

    keys: Sequence[str] = ()
    aggs: Mapping[str, Agg] | None = None
    changes_only: bool = False

    def apply(self, df: DataFrame, order: Order = "_seq", ts: str | None = None) -> DataFrame:
        df, names, keys = ok_rows(df), list(self.aggs), list(self.keys)
        partials = [a.partial().alias(n) for n, a in self.aggs.items()]
        if isinstance(self.emission, OnEof):
            out = df.groupBy(*keys).agg(*partials)
            return out.select(*keys, *_shown(out, names))
        if isinstance(self.emission, TimeWindow):
            out = in_periods(df, order, ts, self.emission.seconds).groupBy("_period", *keys).agg(*partials)
            return out.select(*keys, *_shown(out, names), "_period")
        if not isinstance(self.emission, EveryN | EmitAlways):
            raise TypeError("custom policies run in custom(): an ordered fold")
        n = self.emission.n if isinstance(self.emission, EveryN) else 1
        numbered, total = numbered_rows(df, order, "_nth")
        chunks = numbered.groupBy(*keys, F.floor((F.col("_nth") - 1) / n).alias("_chunk")).agg(*partials)
        upto = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        following = F.lead("_chunk").over(Window.partitionBy(*keys).orderBy("_chunk"))
        cumulative = chunks.select(*keys, "_chunk", *(a.merge(m).over(upto).alias(m) for m, a in self.aggs.items()), following.alias("_next"))
        whole = total // n  # emissions before the end; the state after chunk c is emission c + 1
        # A key's state stands until its next change: each such span of emissions is written out, no join is needed.
        until = F.least(F.coalesce(F.col("_next") - 1, F.lit(whole - 1)), F.lit(whole - 1))
        until = F.least(F.col("_chunk"), until) if self.changes_only else until
        spans = cumulative.filter(F.col("_chunk") < whole).withColumn("_c", F.explode(F.sequence("_chunk", until)))
        shown = spans.select(*keys, *_shown(spans, names), ((F.col("_c") + 1) * n).cast("long").alias("_emitted_at"), F.lit(False).alias("_terminal"))
        final = cumulative.filter("_next is null")
        return shown.unionByName(final.select(*keys, *_shown(final, names), F.lit(total).cast("long").alias("_emitted_at"), F.lit(True).alias("_terminal")))


@dataclass(frozen=True)
class Conflate(_WithEmission):
    """The latest row per key."""

    keys: Sequence[str] = ()

    def apply(self, df: DataFrame, order: Order = "_seq", ts: str | None = None) -> DataFrame:
        df, keys = ok_rows(df), list(self.keys)
        whole = F.struct(*df.columns)
        if isinstance(self.emission, OnEof):
            out = df.groupBy(*keys).agg(F.max_by(whole, F.struct(*as_columns(order))).alias("_last"))
            return out.select(*(F.col(f"_last.{c}").alias(c) for c in df.columns))
        if not isinstance(order, str):
            raise ValueError("emission policies take one unique order column")
        folded = GroupBy(self.emission, keys, {"_value": Agg.last(whole, order)}).apply(df, order, ts)
        extra = [c for c in folded.columns if c.startswith("_") and c != "_value"]
        return folded.select(*(F.col(f"_value.{c}").alias(c) for c in df.columns), *extra)


@dataclass(frozen=True)
class TopNBy(_WithEmission):
    """Sum, count, average and last value per key; the keys with the largest sums, ties to the key seen first.

    One row: top_n (rank from 1), total_items (distinct keys), capacity. Only `capacity` keys are gathered:
    partitions keep their best before they meet.
    """

    capacity: int = 10
    key: str = ""
    score: str = ""
    last: str | None = None

    def __post_init__(self):
        if self.capacity <= 0:
            raise ValueError("capacity must be positive")

    def ranked(self, df: DataFrame, order: str = "_seq") -> DataFrame:
        """key, total, n, avg, (last), first_seen of the top keys, with rank."""
        extra = [F.max_by(self.last, order).alias("last")] if self.last else []
        grouped = ok_rows(df).groupBy(F.col(self.key).alias("key")).agg(F.sum(self.score).alias("total"), F.count(F.lit(1)).alias("n"), F.avg(self.score).alias("avg"), F.min(order).alias("first_seen"), *extra)
        best = grouped.orderBy(F.desc("total"), "first_seen").limit(self.capacity)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "first_seen")))  # at most capacity rows

    def apply(self, df: DataFrame, order: str = "_seq", ts: str | None = None) -> DataFrame:
        if not isinstance(self.emission, OnEof):
            return TopNFold(self, summing=True).apply(df, order, ts)
        best = self.ranked(df, order)
        rows = best.agg(F.array_sort(F.collect_list(F.struct("rank", "key", "total", "n", "avg", *(["last"] if self.last else [])))).alias("top_n"))
        keys = ok_rows(df).select(F.col(self.key)).distinct().agg(F.count(F.lit(1)).alias("total_items"))
        return rows.crossJoin(keys).filter("total_items > 0").withColumn("capacity", F.lit(self.capacity))


@dataclass(frozen=True)
class TopN(_WithEmission):
    """Bounded map of scores: a row replaces its key's score, then the worst key beyond capacity is forgotten for good.

    Worst: lowest score, then the later row. The result depends on the order of all rows, so it is a streaming
    ordered fold whose state is `capacity` entries. NaN scores are refused. within: independent maps
    per value of these columns, which run in parallel.
    """

    capacity: int = 10
    key: str = ""
    score: str = ""
    within: Sequence[str] = ()

    def __post_init__(self):
        if self.capacity <= 0:
            raise ValueError("capacity must be positive")

    def apply(self, df: DataFrame, order: str = "_seq", ts: str | None = None) -> DataFrame:
        return TopNFold(self, summing=False).apply(df, order, ts)


@dataclass(frozen=True)
class TopNFold:
    """The row-at-a-time form of TopN and of TopNBy with an emission policy: a snapshot per emission."""

    spec: TopN | TopNBy
    summing: bool

    def apply(self, df: DataFrame, order: str = "_seq", ts: str | None = None) -> DataFrame:
        spec, summing, policy = self.spec, self.summing, self.spec.emission
        cap, within = spec.capacity, list(getattr(spec, "within", ()))
        rows = ok_rows(df).select(*within, F.col(order).alias("_o"), F.col(spec.key).alias("_key"), F.col(spec.score).cast("double").alias("_score"), (time_seconds(df, ts) if ts else F.lit(0.0)).alias("_ts"))
        key_type = rows.schema["_key"].dataType
        entry = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("key", key_type), T.StructField("score", T.DoubleType())])
        schema = T.StructType(
            [*(rows.schema[c] for c in within), T.StructField("top_n", T.ArrayType(entry)), T.StructField("capacity", T.IntegerType()), T.StructField("count", T.IntegerType()), T.StructField("_emitted_at", T.LongType()), T.StructField("_terminal", T.BooleanType())]
        )
        if isinstance(policy, TimeWindow) and not ts:
            raise ValueError("a time window needs a timestamp column")

        # Entries are (score, earliness): the worst is the smallest of them, and ranks go down from the largest.
        def snapshot(state, terminal):
            best = sorted(state["map"].items(), key=lambda kv: kv[1], reverse=True)
            top = [{"rank": i + 1, "key": k, "score": v[0]} for i, (k, v) in enumerate(best[:cap])]
            return {**state["within"], "top_n": top, "capacity": cap, "count": len(state["map"]), "_emitted_at": state["n"], "_terminal": terminal}

        def initial():
            return {"map": {}, "n": 0, "since": 0, "opened": None, "within": {}}

        def step(state, row):
            if row["_score"] != row["_score"]:
                raise ValueError("a score is NaN")
            state["within"] = {c: row[c] for c in within}
            scores, key = state["map"], row["_key"]
            if summing:
                old = scores.get(key)
                scores[key] = (row["_score"] + (old[0] if old else 0.0), old[1] if old else _earliness(row["_o"]))
            else:
                scores[key] = (row["_score"], _earliness(row["_o"]))
                if len(scores) > cap:
                    del scores[min(scores, key=scores.get)]
            state["n"] += 1
            state["since"] += 1
            state["opened"] = row["_ts"] if state["opened"] is None else state["opened"]
            if policy.should_emit(state["since"], row["_ts"] - state["opened"]):
                out = [snapshot(state, False)]
                state["since"], state["opened"] = 0, None
                if policy.resets:
                    state["map"] = {}
                return state, out
            return state, []

        def finish(state):
            return [snapshot(state, True)] if state["map"] else []

        return ordered_fold(rows, within, "_o", initial, step, schema, finish)


class _Reversed:
    """Reverses the order of any comparable value."""

    def __init__(self, value):
        self.value = value

    def __lt__(self, other):
        return other.value < self.value

    def __eq__(self, other):
        return self.value == other.value


def _earliness(order: object) -> object:
    """Larger for what comes earlier."""
    return -order if isinstance(order, int | float) else _Reversed(order)


def custom(
    df: DataFrame,
    initial: Callable[[], object],
    accumulate: Callable[[object, dict], object],
    outputs: Callable[[object], Sequence[dict]],
    schema: T.StructType | str,
    emission: Emission = OnEof(),
    keys: Sequence[str] = (),
    order: str = "_seq",
    ts: str | None = None,
) -> DataFrame:
    """A user's accumulator with any emission policy, as an ordered fold; independent per key where keys are given.

    outputs(state) is emitted when the policy says so, and at the end unless the state was just reset.
    """

    def start():
        return {"s": initial(), "since": 0, "opened": None, "fresh": True}

    def step(state, row):
        now = row[ts].timestamp() if ts and hasattr(row[ts], "timestamp") else float(row[ts]) if ts else 0.0
        state["s"] = accumulate(state["s"], row)
        state["since"] += 1
        state["opened"] = now if state["opened"] is None else state["opened"]
        state["fresh"] = False
        if not emission.should_emit(state["since"], now - state["opened"]):
            return state, []
        out = list(outputs(state["s"]))
        state["since"], state["opened"] = 0, None
        if emission.resets:
            state["s"], state["fresh"] = initial(), True
        return state, out

    return ordered_fold(ok_rows(df), keys, order, start, step, schema, lambda state: [] if state["fresh"] else outputs(state["s"]))


def running_balance(df: DataFrame, keys: Sequence[str], order: Order, amount: Column | str, name: str = "balance") -> DataFrame:
    """df with a running sum per key."""
    upto = Window.partitionBy(*keys).orderBy(*as_columns(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(amount).over(upto))


def counters(df: DataFrame, keys: Sequence[str], kind: str, name: str = "counters") -> DataFrame:
    """keys, name: map of kind to number of rows."""
    counted = df.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(kind), F.col("_n"))))).alias(name))


def funnel(df: DataFrame, keys: Sequence[str], steps: Mapping[str, str]) -> DataFrame:
    """One row: by step, how many keys have rows of it and of all steps before it (in any order). One aggregate row a key."""
    rows = ok_rows(df).groupBy(*keys).agg(*(F.bool_or(F.expr(test)).alias(name) for name, test in steps.items()))
    passed, out = F.lit(True), []
    for name in steps:
        passed = passed & F.coalesce(F.col(name), F.lit(False))
        out.append(F.count_if(passed).alias(name))
    return rows.agg(*out)


def session_fold(df: DataFrame, keys: Sequence[str], order: str, kind: str, ts: str) -> DataFrame:
    """keys, n, first and last order values, kinds (sorted, distinct) and seconds from the first to the last time, per key."""
    rows = ok_rows(df).withColumn("_t", time_seconds(df, ts))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.max(order).alias("last"), F.sort_array(F.collect_set(kind)).alias("kinds"), (F.max("_t") - F.min("_t")).alias("seconds"))


def reduce(**aggs: Agg) -> Reduce:
    return Reduce(aggs=aggs)


def group_by(*keys: str, **aggs: Agg) -> GroupBy:
    return GroupBy(keys=keys, aggs=aggs)


def conflate(*keys: str) -> Conflate:
    return Conflate(keys=keys)


def top_n(capacity: int, key: str, score: str, within: Sequence[str] = ()) -> TopN:
    return TopN(capacity=capacity, key=key, score=score, within=within)


def top_n_by(capacity: int, key: str, score: str, last: str | None = None) -> TopNBy:
    return TopNBy(capacity=capacity, key=key, score=score, last=last)


#: Names for annotations.
ReduceTyped, GroupByTyped, ConflateTyped, TopNTyped, TopNByTyped = Reduce, GroupBy, Conflate, TopN, TopNBy
