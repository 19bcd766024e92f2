"""Handlers, effects, middleware, contracts, journals, unbounded sources and sinks beyond what the queries compare with SQL."""

import io
import json
import queue
import types

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary import contracts, middleware, storage
from tributary.errors import FatalError, HandlerError
from tributary.functions.statistics import Snapshot
from tributary.journal.effects import EffectCache, effect_key, recorded
from tributary.journal.runs import MemoryJournal
from tributary.operators import fold, handlers, tokens
from tributary.operators.emission import EmitInterval, EveryN, TimeWindow
from tributary.plans.flow import Flow, FlowError
from tributary.schema import EventType
from tributary.sinks.connector import SinkConnector, SinkWriter
from tributary.sinks.console import ConsoleSink
from tributary.sources.functional import finite
from tributary.sources.unbounded import async_infinite, fallible_stream, from_receiver
from tributary.streaming import lowering


class Sums(handlers.StatefulHandler):
    emit_interval = 10.0

    def initial(self):
        return 0

    def accumulate(self, state, row):
        return state + row["v"]

    def should_emit(self, state):
        return state >= 100

    def emit(self, state):
        return [{"total": state}], handlers.RESET if state >= 100 else handlers.RETAIN

    def drain(self, state):
        return [{"total": -state}]


def test_a_handler_emits_by_state_by_interval_and_at_the_end(spark):
    df = finite(spark, [(60, 0.0), (50, 1.0), (5, 2.0), (6, 13.0), (7, 14.0)], "v long, t double")
    out = handlers.stateful(df, Sums(), "total long", ts="t")
    assert sorted(r["total"] for r in out.collect()) == [-18, 11, 110]
    with pytest.raises(ValueError, match="time column"):
        handlers.stateful(df, Sums(), "total long")


class Once(handlers.JoinHandler):
    def initial(self):
        return None

    def admit(self, row):
        return row["ok"]

    def on_reference(self, state, row):
        return row["v"], ()

    def on_stream(self, state, row):
        return state, [{"s": row["s"], "v": state}]

    def drain(self, state):
        return [{"s": None, "v": state}]


def test_a_join_handler_admits_and_orders(spark):
    ref = finite(spark, [("k", 1, True), ("k", 2, False), ("k", 3, True)], "k string, v long, ok boolean")
    stream = finite(spark, [("k", 10), ("k", 20), ("z", 30)], "k string, s long")
    live = handlers.join(ref, stream, Once(), "s long, v long", ["k"], ["k"], "_seq", "_seq")
    assert sorted(map(tuple, live.collect()), key=repr) == sorted([(10, 1), (20, 1), (None, 3), (30, None), (None, None)], key=repr)
    whole = handlers.join(ref, stream, Once(), "s long, v long", ["k"], ["k"], "_seq", "_seq", finite=True)
    assert {(r["s"], r["v"]) for r in whole.collect()} == {(10, 3), (20, 3), (None, 3), (30, None), (None, None)}


def test_emit_intervals():
    policy = EmitInterval(10, EveryN(3))
    assert policy.should_emit(3, 0.0) and policy.should_emit(1, 10.0) and not policy.should_emit(1, 9.0) and not policy.resets
    assert policy.emit_interval_hint() == 10 and EmitInterval(10, TimeWindow(4)).emit_interval_hint() == 4 and EmitInterval(5, TimeWindow(9)).resets
    with pytest.raises(ValueError):
        EmitInterval(0)


def test_safety_classes(spark, tmp_path):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "_pos long, p string")
    calls = []

    def careful(prompt):
        calls.append(prompt)
        if prompt == "p3":
            raise FatalError("stop")
        return prompt.upper()

    cache = EffectCache(spark, str(tmp_path / "t"))
    with pytest.raises(FatalError):
        cache.perform(df, "s", "p", careful, safety="transactional", batch=2)
    assert [r["reply"] for r in recorded(cache, "s")] == ["P0", "P1", "P2"]  # on record though the stage failed
    out = cache.perform(df, "s", "p", lambda p: p.upper(), safety="transactional")
    assert sorted(r["reply"] for r in out.collect()) == [f"P{i}" for i in range(5)] and calls == ["p0", "p1", "p2", "p3"]
    keyed = EffectCache(spark, str(tmp_path / "k")).perform(df, "s", "p", lambda p, key: key, safety="requires_key")
    assert {r["_pos"]: r["reply"] for r in keyed.collect()} == {i: effect_key("s", i, 0) for i in range(5)}
    with pytest.raises(ValueError, match="safety"):
        cache.perform(df, "s", "p", careful, safety="maybe")


def test_fatal_errors_fail_the_stage(spark):
    def fatal(text):
        raise FatalError("no")

    with pytest.raises(Exception, match="no"):
        tokens.perform(finite(spark, [("a",)], "p string"), "p", fatal).collect()


def test_one_breaker_guards_a_stage(spark):
    def provider(text):
        if text == "bad":
            raise OSError("down")
        return text

    calls = finite(spark, [("bad", 0.0), ("bad", 1.0), ("a", 2.0), ("b", 40.0), ("c", 41.0)], "p string, t double").repartition(4)
    lanes = middleware.guarded_stage(calls, "p", provider, "_seq", "t", breaker=lambda: middleware.CircuitBreaker(failures=2, open_for=30))
    assert [r["reply"] for r in lanes.data.orderBy("_seq").collect()] == ["b", "c"]
    assert [r["_error_message"] for r in lanes.errors.orderBy("_seq").collect()] == ["down", "down", "circuit open"]


@pytest.mark.parametrize("guard", ["bucket", "breaker"])
def test_a_guard_is_handed_on_between_the_tasks_of_a_stage(spark, monkeypatch, guard):
    """Its class travels with the functions, so a worker that hands it on can import it by name only as another class, or not at all."""

    def provider(text):
        if text == "bad":
            raise OSError("down")
        return text

    monkeypatch.setattr(fold, "CHAIN_ROWS", 30)
    chains, found = fold._chains, []
    monkeypatch.setattr(fold, "_chains", lambda parts: found.append(chains(parts)) or found[-1])
    data = [("bad" if i % 11 < 4 else "good", 7.0 * (i % 13) + 40.0 * (i // 13)) for i in range(200)]
    limiter, switch = middleware.TokenBucket(0.1, 3), middleware.CircuitBreaker(failures=2, open_for=30)
    want = []
    for p, t in data:
        if not (limiter.admit(t) if guard == "bucket" else switch.allows(t)):
            want.append("rate limited" if guard == "bucket" else "circuit open")
        else:
            switch.record(p != "bad", t)
            want.append("down" if p == "bad" else None)
    make = {"bucket": lambda: middleware.TokenBucket(0.1, 3)} if guard == "bucket" else {"breaker": lambda: middleware.CircuitBreaker(failures=2, open_for=30)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    try:
        lanes = middleware.guarded_stage(finite(spark, data, "p string, t double"), "p", provider, "_seq", "t", **make)
        got = lanes.data.unionByName(lanes.errors).orderBy("_seq").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found[0]) > 2
    assert [r["_error_message"] for r in got] == want and len(set(want)) == 3


def test_signal_gates():
    slept = []
    assert middleware.SignalGate().resolve("eof")
    assert middleware.backoff_gate([1.0, 2.0]).resolve("eof", slept.append) and slept == [1.0, 2.0]
    assert middleware.backoff_gate([1.0]).resolve("drain", slept.append) and len(slept) == 2
    shut = middleware.SignalGate(lambda signal, attempt: middleware.SUPPRESS)
    assert not middleware.composite_gate(middleware.backoff_gate([1.0]), shut).resolve("eof", slept.append)
    both = middleware.composite_gate(middleware.backoff_gate([1.0]), middleware.backoff_gate([3.0, 4.0]))
    assert both.resolve("eof", slept.append) and slept[2:] == [3.0, 4.0]
    with pytest.raises(ValueError):
        middleware.SignalGate(lambda s, a: "perhaps").resolve("eof")


def test_observers_are_told_and_cannot_fail_a_run(spark):
    seen = []

    def broken(event, facts):
        raise RuntimeError("observer")

    flow = Flow("f")
    flow.source("a", lambda s: finite(s, [(1,), (2,)], "v long"), order="_seq", completion=lambda lanes: "poison" if lanes.data.count() < 3 else "natural")
    flow.transform("b", lambda df: df, order="_seq")
    run = flow.edges("a |> b").run(spark, MemoryJournal(spark), observers=[broken, lambda event, facts: seen.append((event, facts.get("stage")))])
    assert seen == [("stage_started", "a"), ("stage_completed", "a"), ("stage_started", "b"), ("stage_completed", "b"), ("run_completed", None)]
    assert run.eof == {"a": "poison", "b": "poison"} and [r["v"] for r in run.journal.in_order("b").collect()] == [1, 2]
    with pytest.raises(ValueError, match="already"):
        run.journal.write("b", run.outputs["b"], "_seq")


def test_effects_are_contained():
    kind = lambda name: EventType(name, T.StructType([T.StructField("x", T.LongType())]))
    Flow("f").effect("e", None, gives=[kind("a"), kind("b")], facts=[kind("a")])
    with pytest.raises(FlowError, match="does not give"):
        Flow("f").effect("e", None, gives=[kind("a")], facts=[kind("b")])
    with pytest.raises(FlowError, match="twice"):
        Flow("f").effect("e", None, gives=[kind("a")], facts=[kind("a"), kind("a")])


def test_resume_needs_an_order_and_no_cycle(spark, tmp_path):
    flow = Flow("f")
    flow.source("a", lambda s: finite(s, [(1,)], "v long"))
    flow.transform("b", lambda df: df)
    flow.edges("a |> b").run(spark, str(tmp_path / "r"))
    with pytest.raises(FlowError, match="order"):
        flow.run(spark, resume_from=str(tmp_path / "r"))
    flow.loop("c", lambda df: df, "true")
    with pytest.raises(FlowError, match="cycles"):
        flow.edges("b |> c").run(spark, resume_from=str(tmp_path / "r"))


def test_divergence_by_ratio_and_by_signals_alone(spark):
    rows = [(float(t), "data") for t in (0, 1)] + [(float(t), "signal") for t in range(2, 25)] + [(60.0 + t / 20, "signal") for t in range(1001)]
    df = spark.createDataFrame(rows, "t double, kind string").withColumn("ts", F.timestamp_seconds("t"))
    found = contracts.divergent_windows(df, "ts", "kind = 'signal'").orderBy("start").collect()
    assert [(r["data"], r["signals"]) for r in found] == [(2, 23), (0, 1001)]
    assert not contracts.divergence("a |> a", df, ts="ts", is_signal="kind = 'signal'").passed
    assert contracts.divergence("a |> a", df.filter("t < 20"), ts="ts", is_signal="kind = 'signal'").passed
    deep = df.withColumn("_cycle_depth", F.lit(31))
    assert not contracts.divergence("a |> a", deep).passed and contracts.divergence("a |> a", deep, limit=31).passed


def drained(spark, tmp_path, stream):
    handle = lowering.start(stream, str(tmp_path / "checkpoint"), path=str(tmp_path / "out"), once=False)
    handle.stop_graceful()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()


def test_async_and_fallible_streams(spark, tmp_path):
    async def produce(number):
        return [(number,)] * 2 if number < 3 else None

    assert sorted(r["v"] for r in drained(spark, tmp_path / "a", async_infinite(spark, produce, "v long"))) == [0, 0, 1, 1, 2, 2]

    def fails(number):
        if number == 1:
            raise HandlerError("late", "Timeout")
        return [(number,)] if number < 3 else None

    rows = drained(spark, tmp_path / "b", fallible_stream(spark, fails, "v long"))
    assert sorted(((r["v"], r["_error_kind"]) for r in rows), key=repr) == sorted([(0, None), (None, "Timeout"), (2, None)], key=repr)


def test_a_receiver_spools_what_it_gets(spark, tmp_path):
    channel = queue.Queue()
    for i in range(5):
        channel.put({"v": i})
    stream, receiver = from_receiver(spark, channel, str(tmp_path / "spool"), "v long", interval=0.05)
    receiver.send({"v": 5})
    receiver.close()
    assert sorted(r["v"] for r in drained(spark, tmp_path, stream)) == list(range(6))


def test_streams_stop_and_abort(spark, tmp_path):
    stream = async_infinite(spark, never, "v long")
    handle = lowering.start(stream, str(tmp_path / "c"), path=str(tmp_path / "o"), once=False)
    handle.stop_cancel()
    assert not handle.query.isActive
    with pytest.raises(RuntimeError, match="enough"):
        lowering.start(stream, str(tmp_path / "d"), path=str(tmp_path / "p"), once=False).abort("enough")


async def never(number):
    return None


class Failing(SinkConnector):
    def open(self, partition):
        return FailingWriter()


class FailingWriter(SinkWriter):
    def write(self, row):
        if row["v"] == 3:
            raise OSError("full")


def test_a_connector_reports_and_fails(spark):
    df = finite(spark, [(i,) for i in range(3)], "v long")
    written = Failing().write(df)
    assert sum(w["rows"] for w in written) == 3 and all(w["error"] is None for w in written)
    with pytest.raises(Exception, match="full"):
        Failing().write(finite(spark, [(3,)], "v long"))


def test_snapshot_tables(spark):
    df = spark.createDataFrame([([(1, "a"), (2, "b")],), ([],)], "top array<struct<rank: int, key: string>>")
    out = io.StringIO()
    assert ConsoleSink("snapshot_table", out=out, header="==", snapshot="top").write(df.repartition(1)) == 2
    assert out.getvalue().count("==") == 2 and "1    | a" in out.getvalue()
    with pytest.raises(ValueError):
        ConsoleSink("snapshot_table")


def test_snapshots_of_other_seeds_and_versions_are_refused():
    a = Snapshot("distinct", b"x", 1)
    assert Snapshot.from_bytes(a.to_bytes()) == a
    with pytest.raises(ValueError, match="cannot merge"):
        a.check(Snapshot("distinct", b"x", 2))
    with pytest.raises(ValueError, match="version"):
        Snapshot.from_bytes(Snapshot("distinct", b"x", 1, 99).to_bytes())


def test_scratch_folders_must_be_shared_on_a_cluster():
    for master, fine in (("local[4]", True), ("local-cluster[2,1,1024]", False), ("spark://host:7077", False)):
        context = types.SimpleNamespace(applicationId=f"app-{master}", master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None)
        session = types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda key, default: default))
        if fine:
            assert storage.shared_dir(session)
        else:
            with pytest.raises(RuntimeError, match="checkpoint"):
                storage.shared_dir(session)


def test_scopes_delete_what_was_written_in_them(spark):
    kept = storage.materialise(finite(spark, [(1,)], "v long"), "kept")
    with storage.scope(spark):
        gone = storage.materialise(finite(spark, [(2,)], "v long"), "gone")
        assert gone.count() == 1
        saved = storage.keep(storage.materialise(finite(spark, [(3,)], "v long"), "saved"))
    assert not storage.exists(spark, gone._scratch_path) and kept.count() == 1 and saved.count() == 1
    storage.discard(kept)
    assert not storage.exists(spark, kept._scratch_path)


def test_tokenizer_estimates(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("ünïcode",)], "t string")
    one = Tokenizer.from_file(path)
    column, why = tokens.tokenizer_estimate("t", path)
    want = [None if t is None else len(one.encode(t, add_special_tokens=False).ids) for t in ("hello world", "", None, "ünïcode")]
    assert why is None and [r[0] for r in df.select(column).collect()] == want
    column, why = tokens.tokenizer_estimate("t", "/nowhere.json")
    assert why.startswith("heuristic") and [r[0] for r in df.select(column).collect()] == [3, 0, None, 3]


def test_excluded_items_are_all_seen(spark):
    policy = tokens.ChunkPolicy("rerender", 1, 1, "exclude")
    df = finite(spark, [("s", "aa"), ("s", "x" * 50), ("s", "bb"), ("s", "y" * 60), ("t", "z" * 70)], "k string, v string")
    out = tokens.chunk_by_budget(df, ["k"], "_seq", "v", lambda x, d: x, 1, policy=policy).collect()
    assert sorted(e["ordinal"] for r in out if r["k"] == "s" for e in json.loads(r["excluded"])) == [1, 3]
    assert [(r["chunk_index"], r["chunk_count"]) for r in out if r["k"] == "t"] == [(None, 0)]


def test_a_permanent_failure_poisons_a_pull(spark):
    from tributary.sources.http_pull import Page, PullDecoder, Request, Response, http_source

    def client(request):
        at = int(request.params["at"])
        return Response(404) if at == 2 else Response(200, json.dumps({"items": [{"v": at}], "next": str(at + 1)}))

    decoder = PullDecoder(lambda cursor: Request("u", params={"at": cursor or "0"}), lambda r: Page(json.loads(r.body)["items"], json.loads(r.body)["next"]))
    pulled = http_source(spark, client, decoder, "v long")
    assert (pulled.eof, pulled.error.kind) == ("poison", "PermanentFailure") and sorted(r["v"] for r in pulled.rows.collect()) == [0, 1]


def test_large_numbers_and_nulls_pass_effects_sinks_and_streams(spark, tmp_path):
    import sqlite3

    from tributary.sinks.database import PostgresSink

    big = 2**53 + 1
    df = spark.createDataFrame([(big, "a"), (None, "b")], "v long, p string").repartition(1)
    assert {r["v"] for r in tokens.perform(df, "p", str.upper).collect()} == {big, None}
    path = str(tmp_path / "db")
    sqlite3.connect(path).execute("create table t (v integer, p text)").connection.commit()
    assert PostgresSink("insert into t (v, p) values (?, ?)", "t", ["v", "p"], lambda: sqlite3.connect(path)).write(df) == 2
    assert sorted(sqlite3.connect(path).execute("select v, p from t").fetchall(), key=repr) == sorted([(big, "a"), (None, "b")], key=repr)

    async def produce(number):
        return [("k", 1, big), ("k", 2, None)] if number == 0 else None

    stream = async_infinite(spark, produce, "k string, o long, v long")
    out = lowering.stateful(stream, ["k"], "o", lambda: ("",), lambda s, r: (f"{s[0]},{r['v']}",), lambda k, s: [(*k, *s)], "k string, seen string", "seen string")
    assert max(r["seen"] for r in drained(spark, tmp_path, out)) == f",{big},None"


def test_an_ingress_is_served_over_http(spark, tmp_path):
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    from tributary.sources.ingest import Ingress, bearer, serve

    served = serve(Ingress(spark, str(tmp_path / "spool"), auth=bearer({"t"}), max_body=200), interval=0.1)

    def post(path, item, token="t"):
        request = Request(served.address + path, json.dumps(item).encode(), {"Authorization": f"Bearer {token}"})
        try:
            with urlopen(request, timeout=10) as response:
                return response.status, json.loads(response.read())["accepted"]
        except HTTPError as error:
            return error.code, 0

    try:
        assert urlopen(served.address + "/health", timeout=10).status == 200
        assert post("/events", {"event_type": "a.v1", "data": {"x": 1}}) == (200, 1)
        assert post("/batch", [{"event_type": "a.v1", "data": {"x": 2}}, {"data": 3}]) == (200, 1)
        assert post("/events", {"event_type": "a.v1", "data": {"x": 4}}, "wrong") == (401, 0)
        assert post("/events", {"event_type": "a.v1", "data": "y" * 500}) == (413, 0)
    finally:
        served.close()
    assert served.ingress.read().count() == 2
