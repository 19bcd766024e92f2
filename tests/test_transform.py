import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.errors import HandlerError, error_totals, route
from tributary.functions.scalars import bucketise, guarded_divide, saturating_add, saturating_subtract_to_zero
from tributary.operators import transform as tr
from tributary.operators.cycle import iterate
from tributary.order import admission_fan_in, canonical_fan_in, causal_order, concurrent, happened_before, number_rows
from tributary.sources.functional import fallible, finite, finite_from_fn, generated, once, produced


def test_filter_drops_null_and_keeps_marked_rows(spark):
    df = finite(spark, [(1, None), (None, None), (5, "Domain")], "v int, _error_kind string")
    assert sorted(r["_seq"] for r in tr.filter_rows(df, "v > 2").collect()) == [3]
    assert sorted(r["_seq"] for r in tr.filter_rows(df.drop("_error_kind"), "v >= 1").collect()) == [1, 3]


def test_map_and_filter_map_keep_the_envelope(spark):
    df = finite(spark, [(1,), (2,)], "v int")
    assert [(r["w"], r["_seq"]) for r in tr.filter_map(df, "v = 2", {"w": "v * 10"}).collect()] == [(20, 2)]


def test_try_map_routes_unknown_to_the_error_lane(spark):
    df = finite(spark, [(i,) for i in range(10)], "v int")
    lanes = tr.try_map(df, {"v": "v"}, F.when(F.col("v") % 3 == 0, "bad"))
    assert lanes.data.count() == 6 and lanes.errors.count() == 4
    assert {r["error_kind"]: r["n"] for r in error_totals(lanes.errors).collect()} == {"Unknown": 4}
    domain = tr.try_map(df, {"v": "v"}, F.when(F.col("v") % 3 == 0, "bad"), kind="Domain")
    assert domain.data.count() == 10 and domain.errors.count() == 0


def test_error_routing_by_kind(spark):
    kinds = ["Timeout", "Remote", "RateLimited", "PermanentFailure", "Deserialization", "Validation", "Domain", "Unknown", None]
    lanes = route(finite(spark, [(k,) for k in kinds], "_error_kind string"))
    assert {r["_error_kind"] for r in lanes.data.collect()} == {"Validation", "Domain", None} and lanes.errors.count() == 6
    with pytest.raises(ValueError):
        HandlerError("x", "Nonsense")


def test_custom_emits_zero_to_many(spark):
    schema = T.StructType([T.StructField("w", T.LongType())])
    out = tr.custom(finite(spark, [(0,), (1,), (2,)], "v long"), lambda r: [{"w": r["v"]}] * r["v"], schema)
    assert sorted(r["w"] for r in out.collect()) == [1, 2, 2]


def test_tagged_union_and_ports(spark):
    df = tr.tagged(finite(spark, [(1,), (20,), (None,)], "v int"), {"small": "v < 10", "large": "v >= 10"})
    assert tr.port(df, "small").count() == 1 and tr.port(df, "small", "large").count() == 2


def test_scalars(spark):
    df = spark.createDataFrame([(5.0, 0.0)], "a double, b double")
    row = df.select(
        bucketise("a", [(4, "x"), (6, "y")], "z").alias("b"), guarded_divide(F.col("a"), F.col("b")).alias("d"), saturating_add(F.lit(2**63 - 1), F.lit(5)).alias("s"), saturating_add(F.lit(-(2**63)), F.lit(-5)).alias("t"), saturating_subtract_to_zero(F.lit(1), F.lit(3)).alias("z")
    ).first()
    assert tuple(row) == ("y", 0.0, 2**63 - 1, -(2**63), 0)


def test_functional_sources(spark):
    assert once(spark, (1,), "v int").count() == 1
    assert [r["v"] for r in finite_from_fn(spark, lambda i: (i,) if i < 3 else None, "v int").orderBy("_seq").collect()] == [0, 1, 2]
    assert generated(spark, 5, v="i * i").agg(F.sum("v")).first()[0] == 30
    assert produced(spark, 3, lambda p: [{"v": p}] * p, "v long").count() == 3

    def make(i):
        if i == 1:
            raise HandlerError("boom", "Timeout")
        return (i,) if i < 3 else None

    lanes = fallible(spark, lambda i: {"v": make(i)[0]} if make(i) else None, "v int")
    assert lanes.data.count() == 2 and lanes.errors.first()["_error_kind"] == "Timeout"


def test_number_rows_is_dense_and_ordered(spark):
    df = spark.range(1000).select((1000 - F.col("id")).alias("k")).repartition(7)
    out = number_rows(df, "k").collect()
    assert sorted((r["k"], r["_seq"]) for r in out) == [(i, i) for i in range(1, 1001)]


def test_canonical_fan_in(spark):
    a, b = finite(spark, [("a1",), ("a2",), ("a3",)], "x string"), finite(spark, [("b1",)], "x string")
    parts = {"A": a.withColumnRenamed("_seq", "n"), "B": b.withColumnRenamed("_seq", "n")}
    assert [r["x"] for r in canonical_fan_in(parts, "n").orderBy("_seq").collect()] == ["a1", "b1", "a2", "a3"]
    assert [r["x"] for r in admission_fan_in(parts, "n").orderBy("_seq").collect()] == ["a1", "b1", "a2", "a3"]


def test_vector_clocks(spark):
    df = spark.createDataFrame([({"a": 1}, {"a": 1, "b": 1}), ({"a": 1}, {"b": 1})], "x map<string,long>, y map<string,long>")
    out = df.select(happened_before(F.col("x"), F.col("y")).alias("h"), concurrent(F.col("x"), F.col("y")).alias("c")).collect()
    assert [tuple(r) for r in out] == [(True, False), (False, True)]
    log = spark.createDataFrame([("e2", {"a": 2}), ("e1", {"a": 1}), ("e0", {"b": 1})], "_event_id string, _clock map<string,long>")
    assert [r["_event_id"] for r in causal_order(log).orderBy("_seq").collect()] == ["e0", "e1", "e2"]


def test_cycle_converges_or_is_capped(spark):
    df = finite(spark, [(v,) for v in (1, 4, 1000)], "v long").drop("_seq")
    lanes = iterate(df, lambda x: x.select(F.expr("v div 2").alias("v")), "v <= 1", 5)
    assert sorted(r["_cycle_depth"] for r in lanes.data.collect()) == [0, 2] and lanes.errors.count() == 1
