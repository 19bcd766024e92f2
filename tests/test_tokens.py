import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.hashing import canonical_json, canonical_json_column, fingerprint, stable_hash64, stable_hash64_column
from tributary.operators import tokens
from tributary.queries import QUERIES
from tributary.sources.functional import finite

DATA = "/root/testdata/sf0.001"


def test_estimates(spark):
    df = spark.createDataFrame([("",), ("abcd",), ("abcde",), ("éé",)], "t string")
    assert [r[0] for r in df.select(tokens.HeuristicEstimator().text("t")).collect()] == [0, 1, 2, 1]
    for bad in (0, -1, float("inf"), float("nan")):
        with pytest.raises(ValueError):
            tokens.HeuristicEstimator(bad)


def test_chat_estimate(spark):
    df = spark.createDataFrame([(1, "abcd"), (1, "ab"), (2, None)], "c int, t string")
    out = {r["c"]: r["estimated_tokens"] for r in tokens.HeuristicEstimator().chat(df, ["c"], "t").collect()}
    assert out == {1: 2 + 8 + 8, 2: 0 + 4 + 8}
    assert tokens.ChatBudget(100, 20, 5, 5).plan("a {items} b", fixed_tokens=10) == 60
    with pytest.raises(ValueError):
        tokens.ChatBudget(100).plan("none")


def test_oversize_flushes(spark):
    df = finite(spark, [(s,) for s in (3, 9, 2, 4)], "size long").withColumn("g", F.lit("x"))
    out = tokens.split_to_budget(df, ["g"], "_seq", "size", 6).orderBy("ordinal").collect()
    assert [(r["grp"], r["oversize"]) for r in out] == [(0, False), (1, True), (2, False), (2, False)]
    with pytest.raises(ValueError):
        tokens.split_to_budget(df, ["g"], "_seq", "size", 0)


def test_chunks():
    one = lambda text: len(text.encode())
    chunks, _ = tokens.plan_chunks(["a", "bb", "ccc"], lambda x, d: x, 3, estimate=one)
    assert [c["item_ordinals"] for c in chunks] == [[0, 1], [2]] and all(c["chunk_count"] == 2 for c in chunks)
    assert [c["item_ordinals"] for c in tokens.plan_chunks(["a", "b", "c"], lambda x, d: x, 9, 2, estimate=one)[0]] == [[0, 1], [2]]
    with pytest.raises(ValueError):
        tokens.plan_chunks(["aaaa"], lambda x, d: x, 3, estimate=one)
    policy = tokens.ChunkPolicy("rerender", 2, 1, "exclude")
    chunks, out = tokens.plan_chunks(["a", "x" * 8, "y" * 99, "b"], lambda x, d: x[: len(x) >> d], 4, policy=policy, estimate=one)
    assert [(c["item_ordinals"], c["depth"]) for c in chunks] == [([0], 0), ([1], 1), ([3], 0)] and out == [{"ordinal": 2, "reason": "MaxDepthExceeded"}]
    _, out = tokens.plan_chunks(["zzzz"], lambda x, d: x, 3, policy=policy, estimate=one)
    assert out[0]["reason"] == "NoProgress"


def test_collector_orders_fails_and_refuses(spark):
    jobs = spark.createDataFrame([("j", 2)], "job string, chunk_count long")
    part = lambda rows: spark.createDataFrame(rows, "job string, i long, v string, status string")
    ok = tokens.collect_by_input(jobs, part([("j", 1, "b", "ok"), ("j", 0, "a", "ok"), ("j", 0, "a", "ok")]), "job", "i", "v").first()
    assert ok["status"] == "ok" and ok["values"] == ["a", "b"]
    failed = tokens.collect_by_input(jobs, part([("j", 1, None, "failed"), ("j", 0, "a", "ok")]), "job", "i", "v").first()
    assert failed["status"] == "failed" and failed["failed_indices"] == [1] and failed["values"] is None
    for rows, word in (([("j", 0, "a", "ok")], "unfinished"), ([("j", 0, "a", "ok"), ("j", 0, "z", "ok"), ("j", 1, "b", "ok")], "conflicting")):
        with pytest.raises(Exception, match=word):
            tokens.collect_by_input(jobs, part(rows), "job", "i", "v").collect()


def test_inference_errors_are_routed(spark):
    def provider(text):
        if text == "bad":
            raise OSError("down")
        return text.upper()

    lanes = tokens.inference(finite(spark, [("ok",), ("bad",)], "p string"), "p", provider)
    assert lanes.data.first()["reply"] == "OK" and lanes.errors.first()["_error_kind"] == "Remote"


def test_map_reduce(spark):
    df = finite(spark, [("s", "aa"), ("s", "bb"), ("s", "cc"), ("t", "d")], "k string, t string")
    out = tokens.map_reduce(df, "k", "_seq", "t", lambda x, d: x, 1, lambda p: p.upper(), lambda p: p.replace("\n", "+"))
    assert {r["k"]: r["result"] for r in out.collect()} == {"s": "AA+BB+CC", "t": "D"}


def test_structured_output(spark):
    schema = T.StructType([T.StructField("k", T.LongType(), False)])
    lanes = tokens.decode_structured(finite(spark, [('{"k": 1}',), ("nope",), ("{}",)], "j string"), "j", schema)
    assert lanes.data.first()["decoded"]["k"] == 1 and lanes.errors.count() == 2


def test_hashes(spark):
    assert f"{stable_hash64(0, b''):016x}" == "efd01f60ba992926"
    texts = ["", "a", "hello world", "é" * 30, None]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select(stable_hash64_column("t", 3)).collect()
    assert [r[0] for r in out] == [None if t is None else f"{stable_hash64(3, t.encode()):016x}" for t in texts]
    assert canonical_json({"b": 1, "a": [1, {"d": 2, "c": 3}]}) == '{"a":[1,{"c":3,"d":2}],"b":1}'
    assert spark.createDataFrame([('{"b":1, "a":2}',), ("x",)], "j string").select(canonical_json_column("j")).collect()[0][0] == '{"a":2,"b":1}'
    row = spark.createDataFrame([(1, "x")], "b int, a string").select(fingerprint("b", "a").alias("f"), fingerprint("a", "b").alias("g")).first()
    assert row["f"] == row["g"]


def test_pieces_lose_nothing(spark):
    for text in ("", "abc", "é" * 9, "a€" * 50, "\U0001f600" * 7, "x" * 16):
        cut = tokens.pieces(text, 2)
        assert "".join(cut) == text and all(tokens.HeuristicEstimator().of(p) <= 2 for p in cut)
    df = spark.createDataFrame([("s", 2, "b" * 20), ("s", 1, "a€" * 9), ("s", 3, None)], "k string, n int, t string")
    out = tokens.chunk_by_budget(tokens.split_items(df, "n", "t", 2), ["k"], "n", "t", lambda x, d: x, 2)
    assert "".join("".join(r["rendered_items"]) for r in out.orderBy("chunk_index").collect()) == "a€" * 9 + "b" * 20


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_queries_chunk_whole_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").groupBy("source").agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.char_length("text")).alias("chars")).collect()
    chunks = {r["source"]: r for r in QUERIES["ai05_chunk_by_budget"](spark, DATA).groupBy("source").agg(F.sum("estimated_tokens").alias("tokens"), F.sum("items").alias("items"), F.count("*").alias("n")).collect()}
    results = {r["source"]: r["result"] for r in QUERIES["ai07_map_reduce"](spark, DATA).collect()}
    for r in docs:
        c = chunks[r["source"]]
        assert 4 * c["tokens"] >= r["bytes"]
        # Prompts join a chunk's items by line ends.
        assert r["chars"] <= int(results[r["source"]]) < r["chars"] + c["items"]
