"""Total order: numbering rows, fan-in, and causal order.

Order-sensitive operators take the columns that order their input; a unique column of the table (an id) is
the cheapest. number_rows() makes a dense number where one is needed, without sorting in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialise


def as_columns(order: str | Column | Sequence[str | Column]) -> list[Column]:
    items = [order] if isinstance(order, str | Column) else list(order)
    if not items:
        raise ValueError("an order needs at least one column")
    return [F.col(c) if isinstance(c, str) else c for c in items]


def seconds(df: DataFrame, ts: str) -> Column:
    """A time column as seconds: timestamps (with or without zone) since the epoch, numbers as they are."""
    kind = df.schema[ts].dataType
    return (F.col(ts).cast("timestamp") if isinstance(kind, T.TimestampNTZType | T.DateType) else F.col(ts)).cast("double")


def numbered_rows(df: DataFrame, order: str | Column | Sequence[str | Column], name: str = "_seq", start: int = 1) -> tuple[DataFrame, int]:
    """df with a dense number in the given (total) order, and how many rows it has.

    Rows are range-partitioned and sorted within partitions, in parallel, and written once; a partition's offset
    is the number of rows in the partitions before it: one number per partition, which the driver adds up.
    """
    by = as_columns(order)
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialise(dealt.withColumn("_part", F.shiftright("_at", 33).cast("int")), "numbered")
    counts = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}  # a row a partition
    before, total = [], start
    for part in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(part, 0)
    number = F.get(F.lit(before or [start]), F.col("_part")) + F.col("_at").bitwiseAND((1 << 33) - 1)
    return dealt.select(*df.columns, number.cast("long").alias(name)), total - start


def number_rows(df: DataFrame, order: str | Column | Sequence[str | Column], name: str = "_seq", start: int = 1) -> DataFrame:
    """df with a dense number in the given (total) order: see numbered_rows."""
    return numbered_rows(df, order, name, start)[0]


def canonical_fan_in(inputs: dict[str, DataFrame], order: Sequence[str] | str, name: str = "_seq") -> DataFrame:
    """Deterministic merge of inputs of one schema: by each row's number within its input, then by input name.

    That is what waiting for a head of every live input and taking the smallest (ordinal, input) gives;
    inputs that have ended simply run out. Adds _input and name. One numbering over (input, order) gives the ordinals, and the lengths of
    the inputs the rest: before row k of an input come min(length, k - 1) rows of each, and the k-th rows of those earlier by name.
    """
    names = sorted(inputs)
    order = [order] if isinstance(order, str | Column) else list(order)
    tagged = reduce(DataFrame.unionByName, [inputs[key].withColumn("_input", F.lit(key)) for key in names])
    numbered = number_rows(tagged, ["_input", *order], "_ordinal")
    length = {r["_input"]: r["count"] for r in numbered.groupBy("_input").count().collect()}  # a row an input
    number, before = F.lit(None).cast("long"), 0
    for i, key in enumerate(names):
        nth = F.col("_ordinal") - before
        place = nth - nth + 1
        for j, other in enumerate(names):
            place = place + F.least(F.lit(length.get(other, 0)), nth - 1)
            if j < i:
                place = place + (nth <= length.get(other, 0)).cast("long")
        number = F.when(F.col("_input") == key, place).otherwise(number)
        before += length.get(key, 0)
    return numbered.withColumn(name, number.cast("long")).drop("_ordinal")


def unordered_fan_in(*inputs: DataFrame) -> DataFrame:
    """Union of inputs of one schema where order has no meaning."""
    return reduce(DataFrame.unionByName, inputs)


def admission_fan_in(inputs: dict[str, DataFrame], admission: str, name: str = "_seq", generation: str | None = None) -> DataFrame:
    """Merge by recorded admission numbers: (generation, admission, input)."""
    parts = [df.withColumn("_input", F.lit(key)) for key, df in sorted(inputs.items())]
    by = [*([generation] if generation else []), admission, "_input"]
    return number_rows(reduce(DataFrame.unionByName, parts), by, name)


def causal_rank(clock: Column | str) -> Column:
    """Sum of a vector clock's entries (map<string, long>): grows along every causal edge."""
    return F.aggregate(F.map_values(clock), F.lit(0).cast("long"), lambda s, v: s + v)


def happened_before(a: Column, b: Column) -> Column:
    """Whether clock a precedes clock b: nowhere larger, somewhere smaller (missing entries are 0)."""
    zero = F.lit(0).cast("long")
    of = lambda m, k: F.coalesce(F.element_at(m, k), zero)
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    return F.forall(keys, lambda k: of(a, k) <= of(b, k)) & F.exists(keys, lambda k: of(a, k) < of(b, k))


def concurrent(a: Column, b: Column) -> Column:
    zero = F.lit(0).cast("long")
    of = lambda m, k: F.coalesce(F.element_at(m, k), zero)
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    return F.exists(keys, lambda k: of(a, k) > of(b, k)) & F.exists(keys, lambda k: of(a, k) < of(b, k))


def causal_order(df: DataFrame, clock: str = "_clock", event_id: str = "_event_id", name: str = "_seq") -> DataFrame:
    """Number rows by (rank, event id), a linear extension of happened-before."""
    return number_rows(df.withColumn("_rank", causal_rank(clock)), ["_rank", event_id], name).drop("_rank")
