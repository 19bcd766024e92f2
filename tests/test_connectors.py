import io
import json
import sqlite3

import pytest
from pyspark.sql import types as T

from tributary.errors import HandlerError
from tributary.middleware import CircuitBreaker, Retry, TokenBucket, breaker_states, guarded, rate_limited
from tributary.metrics import exposition, rate, stage_metrics
from tributary.lineage import latest_contributors, merged_correlation
from tributary.schema import EventType, Registry
from tributary.sinks.callback import deliver, receipt_totals
from tributary.sinks.console import ConsoleSink
from tributary.sinks.csv import CsvSink, TsvSink
from tributary.sinks.database import PostgresSink, check_insert
from tributary.sources import http_pull as http
from tributary.sources.csv import csv_rows, read_csv, read_tsv
from tributary.sources.functional import finite
from tributary.sources.ingest import Ingress, api_key, bearer, hmac_signature, validate

SCHEMA = T.StructType([T.StructField("carrier", T.StringType()), T.StructField("delay", T.LongType())])


def test_csv_typed_errors_and_skip(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("delay,carrier,extra\n1,AA,x\nbad,BB,y\n3,CC,z\n")
    lanes = read_csv(spark, str(path), SCHEMA)
    assert [(r["carrier"], r["delay"]) for r in lanes.data.orderBy("_seq").collect()] == [("AA", 1), ("CC", 3)]
    assert lanes.errors.count() == 1
    assert [r["carrier"] for r in read_csv(spark, str(path), SCHEMA, skip_rows=2).data.collect()] == ["CC"]
    with pytest.raises(ValueError):
        read_csv(spark, str(path), select_columns=["nope"])


def test_csv_untyped_headers_and_structural_stop(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("1,a\n2\n3,b,c\n4,d\n")
    lanes = read_csv(spark, str(path), headers=["n", "s"])
    assert [(r["n"], r["s"]) for r in lanes.data.orderBy("_seq").collect()] == [("1", "a"), ("2", "")] and lanes.errors.count() == 1
    on = read_csv(spark, str(path), headers=["n", "s"], stop_at_structural_error=False)
    assert on.data.count() == 3
    (tmp_path / "y.csv").write_text("n,s\n1,a\n")
    assert csv_rows(spark, str(tmp_path / "y.csv")).first()["row"] == {"n": "1", "s": "a"}


def test_csv_and_tsv_round_trip(spark, tmp_path):
    df = finite(spark, [("AA", 5), ("B,B", None)], SCHEMA)
    CsvSink(str(tmp_path / "out"), columns=["carrier", "delay"], single_file=True).write(df, "_seq")
    back = read_csv(spark, str(tmp_path / "out"), SCHEMA).data.orderBy("_seq")
    assert [(r["carrier"], r["delay"]) for r in back.collect()] == [("AA", 5), ("B,B", None)]
    TsvSink(str(tmp_path / "tsv"), single_file=True).write(df, "_seq")
    assert read_tsv(spark, str(tmp_path / "tsv"), schema=SCHEMA).data.count() == 2
    with pytest.raises(ValueError):
        CsvSink("x", headers=["a"])


def test_console(spark):
    out = io.StringIO()
    assert ConsoleSink("json", out=out).write(finite(spark, [(1, "x")], "a int, b string").drop("_seq")) == 1
    assert json.loads(out.getvalue()) == {"a": 1, "b": "x"}
    out = io.StringIO()
    ConsoleSink("table", max_width=4, out=out, header="H").write(finite(spark, [("abcdefgh",)], "a string").drop("_seq"))
    assert out.getvalue().splitlines()[0] == "H" and "abc…" in out.getvalue()


def test_insert_validation():
    assert check_insert("INSERT INTO app.pay (a) VALUES (?);", "app.pay").endswith("(?)")
    for bad in ("DELETE FROM pay", "INSERT INTO pay VALUES (1); DROP TABLE x", "INSERT INTO other VALUES (1)"):
        with pytest.raises(ValueError):
            check_insert(bad, "pay")
    with pytest.raises(ValueError):
        check_insert("INSERT INTO pay VALUES (1)", "x" * 64)


def test_database_sink(spark, tmp_path):
    path = str(tmp_path / "db.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE pay (id INTEGER, cents INTEGER)")
    sink = PostgresSink("INSERT INTO pay (id, cents) VALUES (?, ?)", "pay", ["id", "cents"], lambda: sqlite3.connect(path, timeout=30))
    assert sink.write(finite(spark, [(1, 5), (2, None)], "id long, cents long").coalesce(1)) == 2
    assert sorted(sqlite3.connect(path).execute("SELECT id, cents FROM pay")) == [(1, 5), (2, None)]


def test_receipts(spark):
    def send(row):
        if row["v"] == 2:
            raise OSError("no")

    totals = {r["status"]: r["n"] for r in receipt_totals(deliver(finite(spark, [(1,), (2,), (3,)], "v long"), send)).collect()}
    assert totals == {"success": 2, "failed": 1}


def test_http_pull_pages_and_errors(spark):
    decoder = http.PullDecoder(lambda c: http.Request("u", params={"c": c or "0"}), lambda r: http.Page(**json.loads(r.body)))
    calls = []

    def client(request):
        calls.append(request.params["c"])
        if len(calls) == 2:
            return http.Response(503)
        if len(calls) == 3:
            return http.Response(429, headers={"Retry-After": "1"})
        c = int(request.params["c"])
        return http.Response(200, json.dumps({"items": [{"v": c}], "next_cursor": str(c + 1) if c < 2 else None}))

    waits = []
    df = http.http_pull(spark, client, decoder, "v long", sleep=waits.append)
    assert [r["v"] for r in df.orderBy("_seq").collect()] == [0, 1, 2] and waits == [0.1, 1.0]
    for status, kind in ((404, "PermanentFailure"), (500, "Remote")):
        with pytest.raises(HandlerError) as error:
            http.fetch(lambda r, s=status: http.Response(s), http.Request("u"), sleep=lambda s: None)
        assert error.value.kind == kind
    with pytest.raises(HandlerError) as error:
        list(http.pages(lambda r: http.Response(200, "nonsense"), http.simple_poll("u")))
    assert error.value.kind == "Deserialization"
    assert len(list(http.poll(lambda r: http.Response(200, "[1,2,3]"), http.simple_poll("u"), 1, 2, http.PullPolicy(max_batch=2), sleep=lambda s: None))) == 4


def test_list_detail(spark):
    detail, parse = (lambda i: http.Request(i)), (lambda r: None if r.body == "b" else {"v": r.body})
    out = http.list_detail(spark, lambda r: http.Response(200, r.url), ["a", "b", "c", "d"], detail, parse, "v string", max_list_items=3)
    assert sorted(r["v"] for r in out.collect()) == ["a", "c"]


def test_ingestion(spark, tmp_path):
    kind = EventType("pay", T.StructType([T.StructField("id", T.LongType(), False)]))
    registry = Registry()
    registry.add(kind)
    door = Ingress(spark, str(tmp_path / "spool"), registry, auth=api_key("X-Key", {"k"}))
    assert door.post("/api/ingest/events", b"{}", {}).code == 401
    assert door.post("/api/ingest/events", b"nope", {"X-Key": "k"}).code == 400
    body = json.dumps([{"event_type": "pay", "data": {"id": 1}}, {"event_type": "zzz", "data": {}}, {"event_type": "pay", "data": {"x": 1}}]).encode()
    got = door.post("/api/ingest/batch", body, {"X-Key": "k"})
    assert (got.code, got.accepted, len(got.errors)) == (200, 2, 1)
    assert door.flush() == 2 and door.post("/health", b"").code == 200
    lanes = validate(door.read(), kind)
    assert [r["id"] for r in lanes.data.collect()] == [1] and lanes.errors.count() == 1
    small = Ingress(spark, "x", max_body=1, buffer=0)
    assert small.post("/events", b"{}").code == 413 and small.submit({"event_type": "a", "data": 1}).status == "shed"
    assert bearer({"t"})({"Authorization": "Bearer t"}, b"") and not hmac_signature("S", b"s")({"S": "sha256=00"}, b"x")


def test_token_bucket_and_breaker(spark):
    bucket = TokenBucket(1.0, 2.0)
    assert [bucket.admit(t) for t in (0, 0, 0, 1, 1.5, 3)] == [True, True, False, True, False, True]
    breaker = CircuitBreaker(failures=2, open_for=10)
    states = []
    for t, ok in ((0, False), (1, False), (2, True), (12, False), (13, True), (23, True), (24, True)):
        allowed = breaker.allows(t)
        if allowed:
            breaker.record(ok, t)
        states.append((allowed, breaker.state))
    assert states == [(True, "closed"), (True, "open"), (False, "open"), (True, "open"), (False, "open"), (True, "closed"), (True, "closed")]
    windowed = CircuitBreaker(window=4, minimum=4, failure_rate=0.5)
    for t, ok in enumerate((True, False, True, False)):
        windowed.record(ok, t)
    assert windowed.state == "open"
    df = finite(spark, [(0.0, True), (0.0, True), (0.0, False)], "t double, ok boolean")
    assert [r["admitted"] for r in rate_limited(df, "_seq", "t", 1.0, 2.0).orderBy("_seq").collect()] == [True, True, False]
    assert breaker_states(df, "_seq", "t", "ok", lambda: CircuitBreaker(failures=1)).orderBy("_seq").collect()[2]["state"] == "open"


def test_retry():
    calls, waits = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise HandlerError("later", "Timeout")
        return x

    assert Retry(jitter=0).call(flaky, 7, sleep=waits.append) == 7 and waits == [0.25, 0.5]
    with pytest.raises(HandlerError):
        Retry().call(lambda: (_ for _ in ()).throw(HandlerError("no", "Validation")), sleep=waits.append)
    with pytest.raises(HandlerError, match="rate limited"):
        call = guarded(str, bucket=TokenBucket(1, 1), clock=lambda: 0.0)
        call("a"), call("b")


def test_metrics(spark):
    df = finite(spark, [(0.1, None), (0.3, "Domain")], "s double, _error_kind string")
    text = exposition(stage_metrics("st", df, "s"))
    assert 'flow_events_total{stage="st"} 2' in text and 'flow_errors_total{kind="Domain",stage="st"} 1' in text
    times = spark.sql("SELECT timestamp'2024-01-01 00:00:01' AS ts UNION ALL SELECT timestamp'2024-01-01 00:00:02'")
    assert rate(times, "ts", 10).first()["rate"] == 0.2


def test_lineage(spark):
    df = finite(spark, [("k", "c1"), ("k", "c2"), ("m", "c3")], "key string, corr string")
    assert {r["key"]: r["parents"] for r in latest_contributors(df, ["key"], "_seq", 1).collect()} == {"k": [2], "m": [3]}
    out = {r["key"]: (r["correlation"], r["correlations"], r["truncated"]) for r in merged_correlation(df, ["key"], "corr", "_seq", 1).collect()}
    assert out == {"k": (None, ["c1"], True), "m": ("c3", ["c3"], False)}
