from pyspark.sql import functions as F

from tributary.operators.emission import EveryN
from tributary.streaming import lowering as st


def feed(spark, tmp_path, rows, name="in"):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, "seq long, k string, v long").write.mode("append").json(path)
    return spark.readStream.schema("seq long, k string, v long").json(path)


def test_stateful_every_n(spark, tmp_path):
    stream = feed(spark, tmp_path, [(i, "a" if i % 2 else "b", i) for i in range(10)])
    out = st.stateful(stream, ["k"], "seq", lambda: (0,), lambda s, r: (s[0] + r["v"],), lambda k, s: [(k[0], s[0])], "k string, total long", "total long", EveryN(2))
    st.start(out, str(tmp_path / "cp"), path=str(tmp_path / "out")).wait(90)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [("a", 4), ("a", 16), ("b", 2), ("b", 12)]


def test_stream_static_join_and_foreach_batch(spark, tmp_path):
    stream = feed(spark, tmp_path, [(1, "a", 1), (2, "z", 2)])
    ref = spark.createDataFrame([(1, "a", "old"), (2, "a", "new")], "n long, k string, name string")
    seen = []
    out = st.enrich_stream(stream, ref, "k", "k", "n", {"seq": "seq", "name": "ref.name"}, "left")
    st.start(out, str(tmp_path / "cp"), batch=lambda df, i: seen.extend(map(tuple, df.collect()))).wait(90)
    assert sorted(seen) == [(1, "new"), (2, None)]


def test_running_group_by_and_conflate(spark, tmp_path):
    rows = [(1, "a", 1), (2, "a", 5), (3, "b", 2)]
    for name, out in (("g", st.running_group_by(feed(spark, tmp_path, rows, "i1"), ["k"], n=F.count(F.lit(1)))), ("c", st.conflate_stream(feed(spark, tmp_path, rows, "i2"), ["k"], "seq"))):
        seen = []
        st.start(out, str(tmp_path / name), batch=lambda df, i, s=seen: s.extend(df.collect()), mode="complete" if name == "g" else "update").wait(90)
        assert {r["k"]: r["n"] if name == "g" else r["v"] for r in seen} == ({"a": 2, "b": 1} if name == "g" else {"a": 5, "b": 2})
