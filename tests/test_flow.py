import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.errors import Lanes
from tributary.journal.effects import EffectCache
from tributary.journal.runs import Journal, Manifest, open_archive, worst_eof
from tributary.journal.verify import CERTIFIED, DIVERGED, REFUSED, UNCERTIFIED, verify
from tributary.operators import accumulate as acc
from tributary.operators import join as joins
from tributary.operators import transform as tr
from tributary.plans.composites import map_reduce
from tributary.plans.config import resolve
from tributary.plans.flow import Flow, FlowError
from tributary.schema import EventType, Registry
from tributary.sinks.callback import CallbackSink
from tributary.sources.functional import finite
from tributary.streaming.resume import resume_source

TICKET = EventType("ticket", T.StructType([T.StructField("id", T.LongType()), T.StructField("cust", T.StringType())]))
OTHER = EventType("other", T.StructType([T.StructField("x", T.LongType())]))


def make(rows, seen=None, factor=1):
    flow = Flow("sla")
    flow.source("customers", lambda s: finite(s, [("a", "gold"), ("b", "free")], "cust string, plan string"), order="_seq")
    flow.source("tickets", lambda s: finite(s, rows, TICKET.schema), gives=TICKET, order="_seq")
    flow.transform("kept", lambda df: tr.filter_rows(df, f"id * {factor} > 0"), takes=TICKET, order="_seq")
    flow.join("enriched", lambda r, t: joins.strict(r, t, "cust", "cust", "_seq", "_seq", {"id": "stream.id", "plan": "ref.plan"}), order="_seq")
    flow.stateful("counted", lambda df: acc.group_by("plan", n=acc.Agg.count()).apply(df), order="plan")
    flow.sink("out", CallbackSink((seen if seen is not None else []).append).idempotent(), order="plan")
    return flow.edges("tickets |> kept", "(customers, kept) |> enriched", "enriched |> counted |> out")


ROWS = [(1, "a"), (2, "b"), (3, "a")]


def test_run_counts_and_contracts(spark, tmp_path):
    seen = []
    run = make(ROWS, seen).run(spark, str(tmp_path / "r1"))
    assert [(r["plan"], r["n"]) for r in seen] == [("free", 1), ("gold", 2)]
    assert run.manifest.status == "completed" and run.eof["out"] == "natural" and all(v.passed for v in run.contracts())
    assert json.loads(make(ROWS).topology())["flow"] == "sla"


def test_poison_travels_and_folds_still_end(spark, tmp_path):
    seen = []
    run = make([(1, "a"), (2, "zz"), (3, "a")], seen).run(spark, str(tmp_path / "r1"))
    assert run.eof["out"] == "poison" and [(r["plan"], r["n"]) for r in seen] == [("gold", 1)]
    assert worst_eof("natural", "poison", "truncated") == "poison"


def test_replay_and_verify(spark, tmp_path):
    a, b, c = (str(tmp_path / x) for x in "abc")
    make(ROWS).run(spark, a)
    make([]).run(spark, b, replay_from=a)  # sources come from the archive
    assert verify(spark, a, b).exit_code == CERTIFIED
    make([(1, "a"), (2, "a"), (3, "a")]).run(spark, c)
    report = verify(spark, a, c)
    assert report.exit_code == DIVERGED and report.stages["tickets"]["data"] == 1 and report.stages["customers"]["status"] == "same"
    assert verify(spark, a, str(tmp_path / "none")).exit_code == REFUSED


def test_prefix_verification(spark, tmp_path):
    a, b = (Journal(spark, str(tmp_path / x)) for x in "ab")
    for j, n in ((a, 2), (b, 3)):
        j.write("s", finite(spark, [(i,) for i in range(n)], "v long"), "_seq")
        j.save(Manifest("f", "r", {"s": {"eof": "natural"}}, status="completed"))
    assert verify(spark, a.path, b.path).exit_code == DIVERGED
    assert verify(spark, a.path, b.path, prefix=True).exit_code == CERTIFIED
    b.save(Manifest("f", "r", {"s": {"eof": "natural"}, "t": {}}, status="completed"))
    assert verify(spark, a.path, b.path, prefix=True).exit_code == UNCERTIFIED


def test_archive_gate(spark, tmp_path):
    j = Journal(spark, str(tmp_path / "x"))
    j.save(Manifest("f", "r"))
    with pytest.raises(ValueError, match="incomplete"):
        open_archive(spark, j.path)
    assert open_archive(spark, j.path, allow_incomplete=True)[2] == "truncated"


def test_journal_reads(spark, tmp_path):
    j = Journal(spark, str(tmp_path / "x"))
    j.write("s", Lanes(finite(spark, [(i,) for i in range(5)], "v long"), finite(spark, [(9, "Unknown")], "v long, _error_kind string")), "_seq")
    assert [r["v"] for r in j.in_order("s").collect()] == [0, 1, 2, 3, 4]
    assert [r["v"] for r in j.after("s", 3).collect()] == [3, 4] and j.at("s", 2).first()["v"] == 1
    assert [r["v"] for r in j.last("s", 2).collect()] == [4, 3] and j.read("s", errors=True).count() == 1


def test_duplicate_sensitive_sinks_are_guarded(spark, tmp_path):
    flow = make(ROWS)
    flow.stages["out"].sink.non_idempotent()
    flow.run(spark, str(tmp_path / "a"))
    with pytest.raises(ValueError, match="may not be written again"):
        flow.run(spark, str(tmp_path / "b"), replay_from=str(tmp_path / "a"))
    flow.run(spark, str(tmp_path / "c"), replay_from=str(tmp_path / "a"), repeat_sinks={"out"})


def test_validation():
    flow = Flow("f")
    flow.source("a", None, gives=OTHER)
    flow.transform("b", None, takes=TICKET)
    with pytest.raises(FlowError, match="not taken"):
        flow.edges("a |> b").validate()
    with pytest.raises(FlowError, match="two stages"):
        flow.source("a", None)
    loop = Flow("g")
    loop.transform("x", None)
    loop.transform("y", None)
    with pytest.raises(FlowError, match="cycle"):
        loop.edges("x |> y |> x").validate()
    bad = Flow("h")
    bad.source("s", None)
    bad.join("j", None)
    with pytest.raises(FlowError, match="needs"):
        bad.edges("s |> j").validate()
    with pytest.raises(FlowError, match="no stage"):
        Flow("i").edges("q |> r").validate()


def test_placeholder_and_schema_check(spark):
    flow = Flow("f")
    flow.source("s", lambda s: finite(s, [(1,)], "x int"), gives=OTHER)
    flow.placeholder("p", takes=OTHER)
    flow.edges("s |> p").validate()
    with pytest.raises(TypeError):
        flow.run(spark)


def test_loop_stage_and_composite(spark):
    flow = Flow("f")
    flow.source("s", lambda s: finite(s, [("k", "aa"), ("k", "bb")], "k string, t string"))
    entry, end = flow.composite("mr", lambda f, p: map_reduce(f, p, "k", "_seq", "t", lambda x, d: x, 1, str.upper, lambda p: p.replace("\n", "")))
    flow.edges(f"s |> {entry}")
    flow.source("n", lambda s: finite(s, [(8,)], "v long").drop("_seq"))
    flow.loop("halve", lambda df: df.select(F.expr("v div 2").alias("v")), "v <= 1")
    flow.edges("n |> halve")
    run = flow.run(spark)
    assert run.outputs[end].first()["result"] == "AABB" and run.outputs["halve"].first()["_cycle_depth"] == 3


def test_effects_are_recorded_and_replayed(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "_pos long, p string")
    path = str(tmp_path / "effects")
    first = EffectCache(spark, path).perform(df, "s", "p", lambda x: x.upper())
    assert sorted(r["reply"] for r in first.collect()) == ["A", "B"]

    def refuse(x):
        raise AssertionError("called again")

    again = EffectCache(spark, path, read_only=True).perform(df, "s", "p", refuse)
    assert sorted(r["reply"] for r in again.collect()) == ["A", "B"]
    changed = df.withColumn("p", F.lit("z"))
    with pytest.raises(ValueError, match="another input"):
        EffectCache(spark, path).perform(changed, "s", "p", refuse)
    with pytest.raises(ValueError, match="no recorded outcome"):
        EffectCache(spark, path, read_only=True).perform(df, "t", "p", refuse)


def test_resume(spark, tmp_path):
    j = Journal(spark, str(tmp_path / "x"))
    j.write("s", finite(spark, [(1,), (2,)], "v long"), "_seq")
    j.save(Manifest("f", "r", status="running"))
    out = resume_source(spark, j.path, "s", finite(spark, [(1,), (2,), (3,)], "v long"))
    assert sorted((r["_generation"], r["v"]) for r in out.collect()) == [(0, 1), (0, 2), (1, 3)]


def test_registry_and_config():
    reg = Registry()
    reg.add(TICKET)
    wider = EventType("ticket", T.StructType([*TICKET.schema.fields, T.StructField("n", T.LongType())]), 2)
    reg.add(wider)
    assert reg.get("ticket") is wider and reg.get("ticket.v2") is wider and reg.get("ticket.v1") is None
    with pytest.raises(ValueError, match="new name"):
        reg.add(EventType("ticket", OTHER.schema, 3))
    got = resolve(cli={"max_iterations": "5"}, env={"TRIBUTARY_MAX_LINEAGE_DEPTH": "7"})
    assert got["max_iterations"] == (5, "cli") and got["max_lineage_depth"] == (7, "env") and got["csv_chunk_size"][1] == "default"
    with pytest.raises(ValueError):
        resolve(cli={"nope": 1})
