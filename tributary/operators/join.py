"""Reference joins: a stream enriched from a catalogue.

The catalogue holds the latest value per key (last write wins), so no join of this module adds stream rows.
Finite joins use the whole catalogue; live joins use it as of each stream row, in arrival order.
left preserves the stream. strict ends the stream at its first row without a match: rows from there on are
cut, and the status is poison.

Scale. The catalogue is reduced per key before the join (map-side partial max_by). Whether it is broadcast is decided
by Spark from its measured size, against spark.sql.autoBroadcastJoinThreshold; beyond it the join shuffles both sides by
key and adaptive execution splits skewed stream keys. A live join is one window per key over both inputs, or with hot_keys one per key and range of
the order, for keys that hold a large share of all rows (the inputs are then written once).
Its order is total only if order columns are unique over both inputs; at ties a catalogue row comes first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import KIND, error_rows, ok_rows
from ..order import as_columns
from ..storage import materialise
from .fold import range_parts

Keys = str | Sequence[str]
Exprs = Mapping[str, Column | str]


def _names(keys: Keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def latest(reference: DataFrame, keys: Keys, order: str | Sequence[str | Column], unique_key: bool = False) -> DataFrame:
    """The last row of each key in the given order; null keys have none.

    unique_key: the caller vouches that a key has one row at most (a table's primary key), so nothing has to be aggregated or sorted.
    """
    names = _names(keys)
    rows = ok_rows(reference).filter(" AND ".join(f"`{k}` IS NOT NULL" for k in names))
    if unique_key:
        return rows
    last = F.max_by(F.struct(*(F.col(c) for c in reference.columns)), F.struct(*as_columns(order))).alias("_last")
    return rows.groupBy(*names).agg(last).select(*(F.col(f"_last.{c}").alias(c) for c in reference.columns))


@dataclass(frozen=True)
class Joined:
    """A join's rows, and how it ended: natural or poison (a strict join that missed)."""

    rows: DataFrame
    misses: DataFrame | None = None

    @property
    def status(self) -> str:
        return "poison" if self.misses is not None and not self.misses.isEmpty() else "natural"


def _side(df: DataFrame, keys: list[str], other: Sequence[str], prefix: str) -> DataFrame:
    """df with its columns as one struct, and its keys by position."""
    return df.select(F.struct(*(F.col(c) for c in df.columns)).alias(prefix), *(F.col(k).alias(f"_{prefix}_k{i}") for i, k in enumerate(keys)))


def _match(left: str, right: str, n: int) -> Column:
    test = F.lit(True)
    for i in range(n):
        test = test & (F.col(f"_{left}_k{i}") == F.col(f"_{right}_k{i}"))
    return test


def _project(joined: DataFrame, stream: DataFrame, exprs: Exprs | None) -> DataFrame:
    """exprs see the sides as structs ref and stream; by default the stream's columns and ref's others."""
    envelope = [F.col(f"stream.{c}").alias(c) for c in stream.columns if c.startswith("_") and c != KIND]
    if exprs is None:
        ref = joined.schema["ref"].dataType.names
        return joined.select(*(F.col(f"stream.{c}").alias(c) for c in stream.columns), *(F.col(f"ref.{c}").alias(c) for c in ref if c not in stream.columns))
    return joined.select(*((F.expr(e) if isinstance(e, str) else e).alias(n) for n, e in exprs.items()), *envelope)


def _finite(reference: DataFrame, stream: DataFrame, ref_key: Keys, stream_key: Keys, ref_order, how: str, unique_key: bool = False) -> DataFrame:
    rk, sk = _names(ref_key), _names(stream_key)
    if len(rk) != len(sk):
        raise ValueError("both sides need the same number of key columns")
    catalogue = _side(latest(reference, rk, ref_order, unique_key), rk, stream.columns, "ref")
    return _side(ok_rows(stream), sk, reference.columns, "stream").join(catalogue, _match("stream", "ref", len(rk)), how)


def inner(reference: DataFrame, stream: DataFrame, ref_key: Keys, stream_key: Keys, ref_order, exprs: Exprs | None = None, unique_key: bool = False) -> DataFrame:
    """One row per stream row with a match. unique_key: see latest."""
    return _project(_finite(reference, stream, ref_key, stream_key, ref_order, "inner", unique_key), stream, exprs)


def left(reference: DataFrame, stream: DataFrame, ref_key: Keys, stream_key: Keys, ref_order, exprs: Exprs | None = None, unique_key: bool = False) -> DataFrame:
    """One row per stream row; ref is null without a match. unique_key: see latest."""
    return _project(_finite(reference, stream, ref_key, stream_key, ref_order, "left", unique_key), stream, exprs)


def _cut(joined: DataFrame, stream: DataFrame, stream_order, exprs: Exprs | None, raising: bool) -> Joined:
    """Rows before the first miss. The miss is one row (a partial minimum), broadcast to the rows."""
    at = F.struct(*(F.col(f"stream.{c}") for c in _names(stream_order)))
    joined = joined.withColumn("_at", at)
    misses = joined.filter(F.col("ref").isNull())
    first = misses.agg(F.min("_at").alias("_cut"))
    kept = joined.filter(F.col("ref").isNotNull()).crossJoin(F.broadcast(first))  # one row
    if raising:
        kept = kept.filter(F.when(F.col("_cut").isNotNull(), F.raise_error(F.lit("a strict join missed"))).otherwise(F.lit(True)).cast("boolean"))
    return Joined(_project(kept.filter(F.col("_cut").isNull() | (F.col("_at") < F.col("_cut"))), stream, exprs), misses)


def strict(reference: DataFrame, stream: DataFrame, ref_key: Keys, stream_key: Keys, ref_order, stream_order: Keys, exprs: Exprs | None = None, mode: str = "cut", unique_key: bool = False) -> Joined:
    """inner up to the first stream row without a match (mode cut), or an error at it (mode raise). unique_key: see latest."""
    return _cut(_finite(reference, stream, ref_key, stream_key, ref_order, "left", unique_key), stream, stream_order, exprs, mode == "raise")


def _as_of(reference: DataFrame, stream: DataFrame, ref_key: Keys, stream_key: Keys, ref_order: Keys, stream_order: Keys, hot_keys: bool = False) -> DataFrame:
    rk, sk, ro, so = _names(ref_key), _names(stream_key), _names(ref_order), _names(stream_order)
    if len(rk) != len(sk) or len(ro) != len(so):
        raise ValueError("both sides need as many key and order columns")
    ref_type, stream_type = T.StructType(reference.schema.fields), T.StructType(stream.schema.fields)
    a = ok_rows(reference).select(
        *(F.col(c).alias(f"_k{i}") for i, c in enumerate(rk)), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(ro)), F.lit(0).alias("_side"), F.struct(*reference.columns).alias("ref"), F.lit(None).cast(stream_type).alias("stream")
    )
    b = ok_rows(stream).select(
        *(F.col(c).alias(f"_k{i}") for i, c in enumerate(sk)), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(so)), F.lit(1).alias("_side"), F.lit(None).cast(ref_type).alias("ref"), F.struct(*stream.columns).alias("stream")
    )
    keys, order = [f"_k{i}" for i in range(len(rk))], [f"_o{i}" for i in range(len(ro))]
    seen = Window.partitionBy(*keys).orderBy(*order, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    if hot_keys:
        return _as_of_in_ranges(a.unionByName(b), keys, order, known)
    merged = a.unionByName(b).withColumn("_now", F.last("ref", ignorenulls=True).over(seen))
    return merged.filter("_side = 1").select("stream", F.when(known, F.col("_now")).alias("ref"))


def _as_of_in_ranges(merged: DataFrame, keys: list[str], order: list[str], known: Column) -> DataFrame:
    """The same with every key cut by ranges of the order, so that no key is one task: the last catalogue row of a range is carried on to
    the key's later ranges, of which there are at most as many as partitions."""
    parts = range_parts(merged, [*order, "_side"], "arrivals")
    at = F.when(F.col("_side") == 0, F.struct(*order))  # stream rows have none, and max_by leaves them out
    cells = parts.groupBy(*keys, "_p").agg(F.max_by("ref", at).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select(*(F.col(k).alias(f"_c{k}") for k in keys), F.col("_p").alias("_cp"), F.last("_last", ignorenulls=True).over(before).alias("_open"))
    seen = Window.partitionBy(*keys, "_p").orderBy(*order, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = parts.withColumn("_now", F.last("ref", ignorenulls=True).over(seen)).filter("_side = 1")
    same = F.col("_p") == F.col("_cp")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_c{k}"))
    return found.join(carried, same, "left").select("stream", F.when(known, F.coalesce("_now", "_open")).alias("ref"))


def inner_live(reference, stream, ref_key: Keys, stream_key: Keys, ref_order: Keys, stream_order: Keys, exprs: Exprs | None = None, hot_keys: bool = False) -> DataFrame:
    """inner against the catalogue as of each stream row."""
    return _project(_as_of(reference, stream, ref_key, stream_key, ref_order, stream_order, hot_keys).filter(F.col("ref").isNotNull()), stream, exprs)


def left_live(reference, stream, ref_key: Keys, stream_key: Keys, ref_order: Keys, stream_order: Keys, exprs: Exprs | None = None, hot_keys: bool = False) -> DataFrame:
    """left against the catalogue as of each stream row: null before its key's first catalogue row."""
    return _project(_as_of(reference, stream, ref_key, stream_key, ref_order, stream_order, hot_keys), stream, exprs)


def strict_live(reference, stream, ref_key: Keys, stream_key: Keys, ref_order: Keys, stream_order: Keys, exprs: Exprs | None = None, mode: str = "cut", hot_keys: bool = False) -> Joined:
    return _cut(_as_of(reference, stream, ref_key, stream_key, ref_order, stream_order, hot_keys), stream, stream_order, exprs, mode == "raise")


def multi_key(reference: DataFrame, stream: DataFrame, ref_key: str, stream_keys: str, ref_order, stream_id: Keys | None = None, name: str = "refs", admit: Column | str | None = None) -> DataFrame:
    """Custom join: a stream row selects several catalogue keys (an array column) and gets an array of matches.

    admit filters what enters the catalogue. Keys are exploded, joined and gathered again per stream row, in
    the order of the array; keys without a match are left out. stream_id: columns that are unique in the stream and not null; without any the
    stream is written once with a number for each row.
    """
    admitted = reference if admit is None else reference.filter(admit)
    catalogue = _side(latest(admitted, ref_key, ref_order), [ref_key], stream.columns, "ref")
    ids, rows = (_names(stream_id), stream) if stream_id else (["_row"], materialise(stream.withColumn("_row", F.monotonically_increasing_id()), "stream"))
    asked = rows.select(*ids, F.posexplode(stream_keys).alias("_pos", "_stream_k0"))
    found = asked.join(catalogue, _match("stream", "ref", 1)).groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("_pos", "ref"))).alias("_found"))
    empty = F.array().cast(T.ArrayType(T.StructType(reference.schema.fields)))
    refs = F.coalesce(F.transform("_found", lambda x: x["ref"]), empty).alias(name)
    return rows.join(found, ids, "left").select(*(rows[c] for c in stream.columns), refs)


def passing_errors(joined: DataFrame, *inputs: DataFrame) -> DataFrame:
    """A join's rows and the marked rows of its inputs, which joins never read; missing columns are null."""
    for df in inputs:
        joined = joined.unionByName(error_rows(df), allowMissingColumns=True)
    return joined


class JoinBuilder:
    """Fluent form: JoinBuilder("inner").with_reference(ref).catalog_key("k").stream_key("k").live().join(stream)."""

    def __init__(self, kind: str = "inner"):
        if kind not in ("inner", "left", "strict"):
            raise ValueError("a join is inner, left or strict")
        self.kind, self._live, self._args = kind, False, {}

    def _set(self, **kwargs) -> JoinBuilder:
        self._args |= kwargs
        return self

    def with_reference(self, reference: DataFrame) -> JoinBuilder:
        return self._set(reference=reference)

    def catalog_key(self, *keys: str) -> JoinBuilder:
        return self._set(ref_key=list(keys))

    def stream_key(self, *keys: str) -> JoinBuilder:
        return self._set(stream_key=list(keys))

    def ordered_by(self, ref_order: Keys, stream_order: Keys | None = None) -> JoinBuilder:
        return self._set(ref_order=_names(ref_order), stream_order=_names(stream_order or ref_order))

    def project(self, exprs: Exprs) -> JoinBuilder:
        return self._set(exprs=exprs)

    def live(self) -> JoinBuilder:
        self._live = True
        return self

    def join(self, stream: DataFrame) -> DataFrame | Joined:
        missing = {"reference", "ref_key", "stream_key", "ref_order"} - set(self._args)
        if missing:
            raise ValueError(f"the join lacks {sorted(missing)}")
        args = dict(self._args, stream=stream)
        if not self._live and self.kind != "strict":
            args.pop("stream_order")
        return globals()[f"{self.kind}_live" if self._live else self.kind](**args)


def chain(stream: DataFrame, *steps: tuple[DataFrame, str, str, str], unique_keys: bool = False) -> DataFrame:
    """Left-deep enrichment: each step is (reference, reference key, stream key, reference order). unique_keys: see latest."""
    for reference, ref_key, stream_key, ref_order in steps:
        stream = inner(reference, stream, ref_key, stream_key, ref_order, unique_key=unique_keys)
    return stream
