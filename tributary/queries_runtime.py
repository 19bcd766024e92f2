"""Queries of sources, sinks, journals, effects, contracts, middleware, handlers and streams, and the same results as SQL.

Imported by queries, whose decorator registers them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import contracts, metrics, middleware
from .errors import HandlerError, error_totals
from .functions.scalars import guarded_divide
from .functions.statistics import Snapshot, distinct_snapshot, merge_snapshots, snapshot_estimate
from .journal.effects import Decider, EffectCache, effectful_stateful
from .journal.runs import Journal, MemoryJournal
from .journal.verify import compare
from .lineage import flow_latency
from .operators import accumulate as acc
from .operators import handlers
from .operators import join as joins
from .operators import tokens
from .operators import transform as tr
from .operators.emission import EmitInterval, Emission
from .order import admission_fan_in, number_rows, unordered_fan_in
from .plans.flow import Flow
from .queries import _LIVE_EXPRS, _live, _table, query
from .schema import EventType
from .sinks.callback import CallbackSink, deliver, receipt_totals, redelivery_gate
from .sinks.connector import SinkConnector, SinkWriter
from .sinks.csv import CsvSink, TsvSink
from .sources.csv import csv_rows, read_csv, read_tsv
from .sources.functional import async_finite, fallible, finite, finite_from_fn, generated, once, produced
from .sources.http_pull import Page, PullDecoder, Request, Response, http_pull
from .sources.ingest import Ingress, validate
from .sources.unbounded import batch_stream
from .storage import materialise, shared_dir
from .streaming import lowering


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"


# --- sources -------------------------------------------------------------------------------------------


@query("sr01_once", "SELECT r_regionkey, r_name FROM region WHERE r_name = 'ASIA'")
def once_row(spark, d):
    return once(spark, {"r_name": "ASIA"}, "r_name string").drop("_seq").join(_table(spark, d, "region"), "r_name").select("r_regionkey", "r_name")


@query("sr02_finite", "SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) AS _seq FROM nation")
def finite_rows(spark, d):
    rows = _table(spark, d, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name").collect()  # a small catalogue
    return finite(spark, [tuple(r) for r in rows], "n_nationkey int, n_name string")


@query("sr03_finite_from_fn", "SELECT n_name, CAST(n_nationkey * n_nationkey AS BIGINT) AS square FROM nation")
def finite_from_function(spark, d):
    squares = finite_from_fn(spark, lambda i: (i, i * i) if i < 25 else None, "n_nationkey int, square long")
    return _table(spark, d, "nation").join(squares, "n_nationkey").select("n_name", "square")


@query("sr04_async_finite", "SELECT CAST(i AS BIGINT) AS v, CAST(i + 1 AS BIGINT) AS _seq FROM range(30) t(i)")
def async_rows(spark, d):
    async def batch(number):
        return [(number * 10 + i,) for i in range(10)] if number < 3 else None

    return async_finite(spark, batch, "v long")


@query("sr05_generated", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def generated_rows(spark, d):
    """Orders by a generated list of all their keys."""
    last = _table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0]
    keys = generated(spark, last + 1, o_orderkey="i").drop("_seq")
    return _table(spark, d, "orders").join(keys, "o_orderkey").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("sr06_stream_of_batches", "SELECT CAST(b * 1000 + i AS BIGINT) AS v, CAST(b AS INTEGER) AS batch FROM range(4) x(b), range(25) y(i)")
def stream_of_batches(spark, d):
    """An unbounded producer's batches, as far as there are any."""
    stream = batch_stream(spark, lambda b: [(b * 1000 + i, b) for i in range(25)] if b < 4 else None, "v long, batch int")
    return _drained(spark, stream, "batches")


def _drained(spark, stream, name: str, mode: str = "append"):
    """What a stream has now, through a sink of files and a checkpoint."""
    out = _folder(spark, name)
    handle = lowering.start(stream, _folder(spark, f"{name}-checkpoint"), path=out, mode=mode, once=False)
    handle.stop_graceful()
    return spark.read.schema(stream.schema).parquet(out)


@query("sr07_produced", "SELECT CAST(p AS INTEGER) AS part, CAST(i AS BIGINT) AS v, CAST(p * 1099511627776 + i AS BIGINT) AS _seq FROM range(6) x(p), range(40) y(i)")
def produced_rows(spark, d):
    return produced(spark, 6, lambda part: ({"part": part, "v": i} for i in range(40)), "part int, v long")


@query("sr08_fallible", "SELECT CASE WHEN i % 5 = 0 THEN 'Timeout' ELSE 'ok' END AS kind, count(*) AS n FROM range(50) t(i) GROUP BY 1")
def fallible_rows(spark, d):
    def make(i):
        if i >= 50:
            return None
        if i % 5 == 0:
            raise HandlerError("late", "Timeout")
        return {"v": i}

    lanes = fallible(spark, make, "v long")
    ok = lanes.data.agg(F.count("v").alias("n")).select(F.lit("ok").alias("kind"), "n")
    return ok.unionByName(error_totals(lanes.errors).withColumnRenamed("error_kind", "kind"))


_BROKEN = "CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END"


@query("sr12_csv_error_lanes", "SELECT CASE WHEN event_type = 'error' THEN 'Deserialization' ELSE 'ok' END AS lane, count(*) AS n, CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE user_id END) AS BIGINT) AS users FROM events GROUP BY 1")
def csv_error_lanes(spark, d):
    """Typed rows, and rows whose number does not decode."""
    events = _table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("user_id").cast("string")).alias("user_id"))
    path = _folder(spark, "events-csv")
    CsvSink(path, columns=["event_id", "user_id"]).write(events, "event_id")
    lanes = read_csv(spark, path, T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType())]))
    both = lanes.data.unionByName(lanes.errors)
    return both.groupBy(F.coalesce("_error_kind", F.lit("ok")).alias("lane")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("user_id"), F.lit(0)).alias("users"))


@query("sr13_tsv_round_trip", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def tsv_round_trip(spark, d):
    customers = _table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    path = _folder(spark, "customers-tsv")
    TsvSink(path, columns=customers.columns).write(customers, "c_custkey")
    return read_tsv(spark, path, schema=customers.schema).data.select("c_custkey", "c_name", "c_mktsegment")


@query("sr11_csv_rows", "SELECT 'csv.row' AS event_type, r_name AS name, CAST(r_regionkey AS VARCHAR) AS key FROM region")
def csv_row_maps(spark, d):
    region = _table(spark, d, "region")
    path = _folder(spark, "region-csv")
    CsvSink(path, columns=["r_regionkey", "r_name"], headers=["key", "name"], single_file=True).write(region, "r_regionkey")
    return csv_rows(spark, path).select("event_type", F.col("row")["name"].alias("name"), F.col("row")["key"].alias("key"))


@query("sr14_http_pull", "SELECT n_nationkey, n_name FROM nation")
def http_pages(spark, d):
    """Pages of seven nations through an injected client."""
    rows = [r.asDict() for r in _table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()]

    def client(request):
        at = int(request.params["cursor"])
        return Response(200, json.dumps({"items": rows[at : at + 7], "next": str(at + 7) if at + 7 < len(rows) else None}))

    decoder = PullDecoder(lambda cursor: Request("nations", params={"cursor": cursor or "0"}), lambda r: Page(json.loads(r.body)["items"], json.loads(r.body)["next"]))
    return http_pull(spark, client, decoder, "n_nationkey int, n_name string").drop("_seq")


@query("sr18_ingress", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def ingress(spark, d):
    """Submissions of one type are taken in and decoded; what is of another type is not."""
    kind = EventType("nation", T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())]))
    endpoint = Ingress(spark, _folder(spark, "spool"))
    batch = [{"event_type": "nation.v1", "data": {"id": r[0], "name": r[1]}} for r in _table(spark, d, "nation").select("n_nationkey", "n_name").collect()]
    endpoint.post("/batch", json.dumps(batch).encode())
    endpoint.submit({"event_type": "other", "data": {}})
    endpoint.flush()
    return validate(endpoint.read(), kind).data.select("id", "name")


# --- flows, journals, replay ---------------------------------------------------------------------------


def _event_flow(spark, d, sink=None):
    flow = Flow("purchases")
    flow.source("events", lambda s: _table(s, d, "events").select("event_id", "user_id", "event_type"), order="event_id")
    flow.transform("bought", lambda df: tr.filter_rows(df, "event_type = 'purchase'"), order="event_id")
    flow.stateful("counted", lambda df: acc.group_by("user_id", n=acc.Agg.count()).apply(df), order="user_id")
    flow.sink("out", sink, order="user_id")
    return flow.edges("events |> bought |> counted |> out")


_COUNTED = "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id"


@query("sr21_strict_replay", _COUNTED)
def strict_replay(spark, d):
    """A run that is replayed from the archive of another, with no source read."""
    archive = _folder(spark, "run")
    _event_flow(spark, d).run(spark, archive, repeat_sinks={"out"})
    flow = _event_flow(spark, d)
    flow.stages["events"].run = None  # a replay does not call it
    return flow.run(spark, replay_from=archive, repeat_sinks={"out"}).outputs["counted"].select("user_id", "n")


@query("rp02_resume", _COUNTED)
def resumed(spark, d):
    """A run over the first half of the month, resumed over the whole: archived rows, then the live ones beyond them."""
    archive = _folder(spark, "run")
    half = _event_flow(spark, d)
    read = half.stages["events"].run
    middle = _table(spark, d, "events").agg(F.percentile_approx("event_id", 0.5).alias("m"))  # one row
    half.stages["events"].run = lambda s: read(s).crossJoin(F.broadcast(middle)).filter("event_id <= m").drop("m")
    half.run(spark, archive, repeat_sinks={"out"})
    return _event_flow(spark, d).run(spark, resume_from=archive).outputs["counted"].select("user_id", "n")


@query("jr02_memory_journal", _COUNTED)
def memory_journal(spark, d):
    run = _event_flow(spark, d).run(spark, MemoryJournal(spark))
    return run.journal.read("counted").select("user_id", "n")


@query(
    "jr03_journal_reads",
    "WITH j AS (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) AS pos FROM events) SELECT 'after' AS read, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM j WHERE pos > 300 UNION ALL SELECT 'at', count(*), CAST(sum(event_id) AS BIGINT) FROM j WHERE pos = 17 UNION ALL SELECT 'last', count(*), CAST(sum(event_id) AS BIGINT) FROM (SELECT * FROM j ORDER BY pos DESC LIMIT 10) UNION ALL SELECT 'by_id', count(*), CAST(sum(event_id) AS BIGINT) FROM j WHERE user_id IN (3, 5) UNION ALL SELECT 'causal', count(*), CAST(sum(event_id * s) AS BIGINT) FROM (SELECT event_id, row_number() OVER (ORDER BY event_id % 7 + event_id % 5, event_id) AS s FROM events)",
)
def journal_reads(spark, d):
    """Sums are longs, as in the SQL; where one does not fit (the SQL fails there) they are decimals and exact."""
    journal = Journal(spark, _folder(spark, "journal"))
    clock = F.create_map(F.lit("a"), F.col("event_id") % 7, F.lit("b"), F.col("event_id") % 5)
    journal.write("events", _table(spark, d, "events").select("event_id", "user_id", clock.alias("_clock")), "event_id")
    summed = lambda name, df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event_id").cast("decimal(38,0)")).alias("ids")).select(F.lit(name).alias("read"), "n", "ids")
    parts = [summed("after", journal.after("events", 300)), summed("at", journal.at("events", 17)), summed("last", journal.last("events", 10)), summed("by_id", journal.by_id("events", "user_id", 3, 5))]
    causal = journal.causal("events", "_clock", "event_id").withColumn("event_id", F.col("event_id").cast("decimal(19,0)") * F.col("_seq").cast("decimal(19,0)"))
    reads = materialise(unordered_fan_in(*parts, summed("causal", causal)), "reads")
    wide = reads.filter("ids IS NOT NULL AND try_cast(ids AS BIGINT) IS NULL")
    return reads.withColumn("ids", F.col("ids").cast("long")) if wide.isEmpty() else reads


@query("st01_eof_kinds", "SELECT stage, CASE WHEN missed AND stage NOT IN ('events', 'customers') THEN 'poison' ELSE 'natural' END AS eof FROM (SELECT unnest(['orders', 'customers', 'joined', 'counted', 'out']) AS stage, (SELECT count(*) FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 WHERE c_custkey IS NULL) > 0 AS missed) WHERE stage <> 'orders' UNION ALL SELECT 'orders', 'natural'")
def eof_kinds(spark, d):
    """A strict join that misses ends as poison, and so does all that follows."""
    flow = Flow("strict")
    flow.source("customers", lambda s: _table(s, d, "customer").filter("c_acctbal > 0").select("c_custkey", "c_mktsegment"), order="c_custkey")
    flow.source("orders", lambda s: _table(s, d, "orders").select("o_orderkey", "o_custkey"), order="o_orderkey")
    flow.join("joined", lambda r, s: joins.strict(r, s, "c_custkey", "o_custkey", "c_custkey", "o_orderkey"))
    flow.stateful("counted", lambda df: acc.group_by("c_mktsegment", n=acc.Agg.count()).apply(df))
    flow.sink("out", CallbackSink(lambda row: None).idempotent())
    run = flow.edges("(customers, orders) |> joined", "joined |> counted |> out").run(spark)
    return spark.createDataFrame(sorted(run.eof.items()), "stage string, eof string")


@query("vf02_prefix_verify", "SELECT row_number() OVER (ORDER BY event_id) AS _pos FROM events QUALIFY event_type = 'error' AND row_number() OVER (ORDER BY event_id) <= (SELECT count(*) // 2 FROM events)")
def prefix_verify(spark, d):
    """A longer run against a shorter baseline, of which error rows differ."""
    rows = number_rows(_table(spark, d, "events").select("event_id", "event_type", "value"), "event_id", "_pos")
    half = rows.count() // 2
    baseline = rows.filter(F.col("_pos") <= half).withColumn("value", F.when(F.col("event_type") == "error", -1.0).otherwise(F.col("value")))
    return compare(baseline, rows, prefix=True).select("_pos")


@query("or03_unordered_fan_in", "SELECT kind, count(*) AS n FROM (SELECT 'click' AS kind FROM events WHERE event_type = 'click' UNION ALL SELECT 'order' FROM orders) GROUP BY kind")
def fan_in_unordered(spark, d):
    clicks = _table(spark, d, "events").filter("event_type = 'click'").select(F.lit("click").alias("kind"))
    both = unordered_fan_in(clicks, _table(spark, d, "orders").select(F.lit("order").alias("kind")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("or04_admission_fan_in", "SELECT key, _input, row_number() OVER (ORDER BY admitted, _input) AS _seq FROM (SELECT event_id AS key, 'events' AS _input, event_id * 3 AS admitted FROM events UNION ALL SELECT o_orderkey, 'orders', o_orderkey * 2 FROM orders)")
def fan_in_by_admission(spark, d):
    events = _table(spark, d, "events").select(F.col("event_id").alias("key"), (F.col("event_id") * 3).alias("admitted"))
    orders = _table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") * 2).alias("admitted"))
    return admission_fan_in({"events": events, "orders": orders}, "admitted").select("key", "_input", "_seq")


# --- handlers, emission, joins -------------------------------------------------------------------------


@query("tr05_custom_handler", "SELECT user_id, event_type, count(*) AS n FROM (SELECT user_id, event_type FROM events WHERE event_type <> 'view' UNION ALL SELECT user_id, 'sale' FROM events WHERE event_type = 'purchase') GROUP BY ALL")
def custom_handler(spark, d):
    """A row handler in Python: views give nothing, purchases two facts."""

    def process(row):
        kind = row["event_type"]
        return [] if kind == "view" else [row, {**row, "event_type": "sale"}] if kind == "purchase" else [row]

    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType())])
    return tr.custom(_table(spark, d, "events").select("user_id", "event_type"), process, schema).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


class _Batches(handlers.StatefulHandler):
    """Emits once five hundred of value have come together, and starts anew."""

    def initial(self):
        return (None, 0, 0)

    def accumulate(self, state, row):
        return row["user_id"], state[1] + 1, state[2] + int(row["value"])

    def should_emit(self, state):
        return state[2] >= 500

    def emit(self, state):
        return [{"user_id": state[0], "n": state[1], "total": state[2], "closed": True}], handlers.RESET

    def drain(self, state):
        return [{"user_id": state[0], "n": state[1], "total": state[2], "closed": False}] if state[1] else []


@query(
    "ag07_custom_stateful",
    """WITH RECURSIVE e AS (SELECT user_id, CAST(trunc(value) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS m FROM events),
s AS (SELECT user_id, i, m, 1 AS n, v AS total FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, e.m, CASE WHEN s.total >= 500 THEN 1 ELSE s.n + 1 END, CASE WHEN s.total >= 500 THEN e.v ELSE s.total + e.v END FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT user_id, CAST(n AS BIGINT) AS n, total, total >= 500 AS closed FROM s WHERE total >= 500 OR i = m""",
)
def custom_stateful(spark, d):
    events = _table(spark, d, "events").select("event_id", "user_id", "value")
    return handlers.stateful(events, _Batches(), "user_id long, n long, total long, closed boolean", ["user_id"], "event_id")


class _Followers(handlers.JoinHandler):
    """Purchases with the number of sign-ups and of purchases before, and the totals at the end."""

    def initial(self):
        return (None, 0, 0)

    def on_reference(self, state, row):
        return (row["user_id"], state[1] + 1, state[2]), ()

    def on_stream(self, state, row):
        out = {"user_id": row["user_id"], "event_id": row["event_id"], "signups": state[1], "purchases": state[2]}
        return (row["user_id"], state[1], state[2] + 1), [out]

    def on_stream_eof(self, state):
        return [{"user_id": state[0], "event_id": None, "signups": state[1], "purchases": state[2]}]


@query(
    "jn10_stateful_join",
    "WITH e AS (SELECT user_id, event_id, event_type, count(*) FILTER (event_type = 'signup') OVER w AS signups, count(*) FILTER (event_type = 'purchase') OVER w AS purchases FROM events WHERE event_type IN ('signup', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT user_id, event_id, signups, purchases FROM e WHERE event_type = 'purchase' UNION ALL SELECT user_id, NULL, count(*) FILTER (event_type = 'signup'), count(*) FILTER (event_type = 'purchase') FROM e GROUP BY user_id HAVING count(*) FILTER (event_type = 'purchase') > 0",
)
def stateful_join(spark, d):
    ref, stream = _live(spark, d)
    return handlers.join(ref, stream, _Followers(), "user_id long, event_id long, signups long, purchases long", ["user_id"], ["user_id"], "signup_id", "event_id")


class _Tenth(Emission):
    """Every tenth row, and at once when an hour has passed."""

    def should_emit(self, rows, elapsed):
        return rows >= 10


@query("em06_custom_emission", "WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS m FROM events) SELECT user_id, i AS n FROM e WHERE i % 10 = 0 UNION ALL SELECT user_id, m FROM e WHERE i = 1")
def custom_emission(spark, d):
    events = _table(spark, d, "events").select("event_id", "user_id")
    return acc.custom(events, lambda: (None, 0), lambda s, r: (r["user_id"], s[1] + 1), lambda s: [{"user_id": s[0], "n": s[1]}], "user_id long, n long", _Tenth(), ["user_id"], "event_id")


@query(
    "em08_emit_interval",
    """WITH RECURSIVE e AS (SELECT epoch_us(ts) AS t FROM events),
p AS (SELECT min(t) AS opened, (SELECT min(t) FROM e WHERE t >= (SELECT min(t) FROM e) + 43200000000) AS closed FROM e
  UNION ALL SELECT n.opened, (SELECT min(t) FROM e WHERE t >= n.opened + 43200000000)
  FROM (SELECT (SELECT min(t) FROM e WHERE t > p.closed) AS opened FROM p WHERE p.closed IS NOT NULL) n WHERE n.opened IS NOT NULL)
SELECT (SELECT count(*) FROM e WHERE t <= p.closed) AS n FROM p WHERE closed IS NOT NULL UNION ALL SELECT count(*) FROM e""",
)
def emit_interval(spark, d):
    """A running count, shown twice a day."""
    events = _table(spark, d, "events").select("ts")
    return acc.custom(events, lambda: 0, lambda s, r: s + 1, lambda s: [{"n": s}], "n long", EmitInterval(43200), order="ts", ts="ts")


@query("jn11_builder", "SELECT event_id, user_id, signup_id FROM (SELECT event_id, event_type, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS signup_id FROM events WHERE event_type IN ('signup', 'purchase')) WHERE event_type = 'purchase'")
def join_builder(spark, d):
    ref, stream = _live(spark, d)
    built = joins.JoinBuilder("left").with_reference(ref).catalog_key("user_id").stream_key("user_id").ordered_by("signup_id", "event_id").project(_LIVE_EXPRS).live()
    return built.join(stream)


@query("tr08_error_pass_through", "SELECT coalesce(kind, 'ok') AS kind, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'Domain' END AS kind, user_id FROM events) e WHERE kind IS NOT NULL OR EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'signup' AND s.user_id = e.user_id) GROUP BY 1")
def errors_pass_joins(spark, d):
    """Marked rows are not joined but passed on."""
    events = _table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") == "error", "Domain").alias("_error_kind"), F.lit(None).cast("string").alias("_error_message"))
    users = _table(spark, d, "events").filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup_id"))
    joined = joins.passing_errors(joins.inner(users, events, "user_id", "user_id", "signup_id"), events)
    return joined.groupBy(F.coalesce("_error_kind", F.lit("ok")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# --- effects, inference, budgets -----------------------------------------------------------------------


@query("ef02_effect_replay", "SELECT conv_id, turn, CAST(length(text) AS VARCHAR) AS reply FROM conversations WHERE role = 'user'")
def effect_replay(spark, d):
    """Effects that are recorded, and a replay that reads the record and never calls."""
    asked = number_rows(_table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", "text"), ["conv_id", "turn"], "_pos")
    asked, path = materialise(asked, "asked"), _folder(spark, "effects")
    EffectCache(spark, path).perform(asked, "answer", "text", lambda text, key: str(len(text)), safety="requires_key")

    def refused(text):
        raise AssertionError("a replay calls nothing")

    return EffectCache(spark, path, read_only=True).perform(asked, "answer", "text", refused).select("conv_id", "turn", "reply")


class _Allocation(Decider):
    """A user's first three purchases are allocated by an effect, the others refused."""

    def initial(self):
        return 0

    def decide(self, state, row):
        return f"allocate {row['event_id']}" if state < 3 else None

    def apply(self, state, row, reply, error):
        out = {"event_id": row["event_id"], "user_id": row["user_id"], "outcome": reply or "refused"}
        return state + (reply is not None), [out]


@query("ef01_effectful_stateful", "SELECT event_id, user_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3 THEN 'ALLOCATE ' || event_id ELSE 'refused' END AS outcome FROM events WHERE event_type = 'purchase'")
def allocation(spark, d):
    """decide, effect, apply; the second run is a replay from the record."""
    orders = _table(spark, d, "events").filter("event_type = 'purchase'").select("event_id", "user_id", F.col("event_id").alias("_pos"))
    path, schema = _folder(spark, "effects"), "event_id long, user_id long, outcome string"
    effectful_stateful(EffectCache(spark, path), orders, "allocate", _Allocation(), str.upper, schema, ["user_id"])

    def refused(prompt):
        raise AssertionError("a replay calls nothing")

    return effectful_stateful(EffectCache(spark, path, read_only=True), orders, "allocate", _Allocation(), refused, schema, ["user_id"])


@query("ai06_chat_budget", "SELECT conv_id, CAST(greatest(0, 4096 - 512 - 64 - 32 - CAST(ceil(sum(octet_length(encode(text))) / 4.0) + 4 * count(*) + 8 AS BIGINT)) AS BIGINT) AS room FROM conversations GROUP BY conv_id")
def chat_budget(spark, d):
    """What is left of a context for one more variable part."""
    used = tokens.HeuristicEstimator().chat(_table(spark, d, "conversations"), ["conv_id"], "text")
    room = tokens.ChatBudget(4096, reserved_output=512, safety=64, overhead=32).plan("history {items} question")
    return used.select("conv_id", tokens.remaining_budget(room, F.col("estimated_tokens")).cast("long").alias("room"))


@query("ai09_embeddings", "SELECT doc_id, CAST(length(text) AS DOUBLE) AS size, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS spaces FROM documents")
def embedded(spark, d):
    """A batch provider of vectors: here lengths and spaces."""
    docs = tokens.embed(_table(spark, d, "documents").select("doc_id", "text"), "text", lambda texts: [(len(t), t.count(" ")) for t in texts])
    return docs.select("doc_id", F.col("embedding")[0].cast("double").alias("size"), F.col("embedding")[1].cast("double").alias("spaces"))


# --- sinks, contracts ----------------------------------------------------------------------------------


@query("sk06_receipts", "SELECT CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, count(*) AS n FROM events GROUP BY 1")
def receipts(spark, d):
    def send(row):
        if row["event_type"] == "error":
            raise OSError("refused")

    return receipt_totals(deliver(_table(spark, d, "events").select(F.col("event_id").alias("_seq"), "event_type"), send))


@query("sk04_callback", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def callback(spark, d):
    """Rows in order to a function on the driver."""
    seen = []
    CallbackSink(seen.append).idempotent().write(_table(spark, d, "nation"), "n_nationkey")
    groups = {}
    for r in seen:
        groups.setdefault(r["n_regionkey"], []).append(r["n_name"])
    return spark.createDataFrame([(k, ",".join(v)) for k, v in groups.items()], "n_regionkey int, names string")


class _Counting(SinkConnector):
    """Counts what its writers take."""

    redelivery = "safe"

    def open(self, partition):
        return _CountingWriter()


class _CountingWriter(SinkWriter):
    def __init__(self):
        self.ids = set()

    def write(self, row):
        self.ids.add(row["o_orderkey"])

    def close(self):
        self.ids = None


@query("sk05_connector", "SELECT count(*) AS rows FROM orders")
def connector(spark, d):
    written = _Counting().write(_table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    return spark.createDataFrame([(sum(w["rows"] for w in written),)], "rows long")


@query("sk07_redelivery_gate", "SELECT * FROM (VALUES ('callback', false), ('csv', false), ('safe', true)) t(sink, allowed)")
def gate(spark, d):
    """Which sinks may be written again by a replay."""
    sinks = {"callback": CallbackSink(print), "csv": CsvSink("unused"), "safe": _Counting()}
    out = []
    for name, sink in sinks.items():
        try:
            redelivery_gate({name: sink})
            out.append((name, True))
        except ValueError:
            out.append((name, False))
    return spark.createDataFrame(out, "sink string, allowed boolean")


_ORDERS_SEQ = "SELECT row_number() OVER (ORDER BY o_orderkey) AS s, o_orderkey FROM orders"


@query(
    "ct03_verdicts",
    f"""SELECT 'transport' AS contract, true AS passed, n || ' written, ' || n || ' read' AS detail FROM (SELECT count(*) AS n FROM orders)
UNION ALL SELECT 'source', false, n || ' of ' || (n + 1) FROM (SELECT count(*) AS n FROM orders)
UNION ALL SELECT 'delivery', n = 0, n || ' rows without a receipt' FROM (SELECT count(*) AS n FROM ({_ORDERS_SEQ}) WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
UNION ALL SELECT 'divergence', n = 0, 'depth 0 of 30, ' || n || ' windows of too many signals' FROM (SELECT count(*) AS n FROM (SELECT count(*) FILTER (event_type <> 'purchase') AS s, count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY epoch_us(ts) // 86400000000) WHERE CASE WHEN p > 0 THEN s > 4 * p ELSE s > 1000 END)""",
)
def verdicts(spark, d):
    """The four edge contracts: one holds, a source lacks a row, deliveries and signals as the data have them."""
    orders = number_rows(_table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    delivered = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(orders, "o_orderkey").select("_seq")
    strict = contracts.Thresholds(window=86400, signal_to_data_ratio=4.0)
    found = [
        contracts.transport("orders |> out", orders, orders),
        contracts.source("orders |> out", orders, orders.count() + 1),
        contracts.delivery("orders |> out", orders, delivered),
        contracts.divergence("events |> events", _table(spark, d, "events"), ts="ts", is_signal="event_type <> 'purchase'", thresholds=strict),
    ]
    return contracts.as_rows(spark, found).drop("edge")


# --- middleware, metrics, lineage ----------------------------------------------------------------------


@query("mw03_retry", "SELECT conv_id, turn, length(text) AS size FROM conversations WHERE role = 'user'")
def retried(spark, d):
    """A provider that fails at every first try of a text."""

    class Flaky:
        def __init__(self):
            self.tried = set()

        def __call__(self, text):
            if text not in self.tried:
                self.tried.add(text)
                raise OSError("try again")
            return str(len(text))

    prompts = _table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    guarded = middleware.guarded(Flaky(), retry=middleware.Retry(3, initial=0.0, cap=0.0))
    return tokens.inference(prompts, "text", guarded).data.select("conv_id", "turn", F.col("reply").cast("long").alias("size"))


@query(
    "mw04_observed",
    "SELECT count(*) AS rows, count(*) FILTER (event_type = 'error') AS errors FROM events",
)
def observed_counts(spark, d):
    """Counts that are taken as the rows pass."""
    events = _table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", "Domain").alias("_error_kind"))
    rows, observation = middleware.observed(events, f"events-{uuid.uuid4().hex[:6]}")
    materialise(rows, "observed")
    seen = observation.get
    return spark.createDataFrame([(seen["rows"], seen["errors"])], "rows long, errors long")


@query("mx02_rate", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) / 86400.0::DOUBLE AS rate FROM events GROUP BY 1")
def event_rate(spark, d):
    events = _table(spark, d, "events")
    out = metrics.rate(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", 86400.0)
    return out.select(F.col("start").cast(events.schema["ts"].dataType).alias("start"), "rate")


@query("mx02_anomalies", "WITH s AS (SELECT event_type, avg(value) AS m, stddev(value) AS d FROM events GROUP BY event_type) SELECT event_type, count(*) AS n FROM events JOIN s USING (event_type) WHERE abs(value - m) > 2 * d GROUP BY event_type")
def anomalous(spark, d):
    return metrics.anomalies(_table(spark, d, "events"), "value", ("event_type",), 2.0).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("mx02_amendments", "SELECT o_custkey, count(*) - 1 AS amendments FROM orders GROUP BY o_custkey")
def amended(spark, d):
    return metrics.amendments(_table(spark, d, "orders"), ["o_custkey"])


@query(
    "mx01_run_metrics",
    "WITH n AS (SELECT count(*) AS a, count(*) FILTER (event_type = 'purchase') AS b, count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS c FROM events) SELECT 'events' AS stage, 'events_total' AS metric, CAST(a AS DOUBLE) AS value FROM n UNION ALL SELECT 'bought', 'events_total', b FROM n UNION ALL SELECT 'counted', 'events_total', c FROM n UNION ALL SELECT 'bought', 'events_in_total', a FROM n UNION ALL SELECT 'counted', 'events_in_total', b FROM n UNION ALL SELECT 'out', 'delivered_total', c FROM n",
)
def flow_metrics(spark, d):
    run = _event_flow(spark, d, CallbackSink(lambda row: None).idempotent()).run(spark)
    wanted = ("events_total", "events_in_total", "delivered_total")
    return metrics.run_metrics(run).filter(F.col("metric").isin(*wanted)).select("stage", "metric", "value")


@query("ln03_flow_latency", "SELECT event_type, CAST(sum(length(props)) AS DOUBLE) AS seconds FROM events GROUP BY event_type")
def latency(spark, d):
    """Rows whose sink time is so many seconds later as their payload has characters."""
    events = _table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.withColumn("done", F.timestamp_add("SECOND", F.length("props"), F.col("ts")))
    return events.select("event_type", F.round(flow_latency("done", "ts")).alias("s")).groupBy("event_type").agg(F.sum("s").alias("seconds"))


@query("ap02_snapshots", "SELECT true AS merged_as_whole, true AS near")
def snapshots(spark, d):
    """A merged snapshot estimates what one of the whole does, near the true number of users."""
    events = _table(spark, d, "events")
    parts = [distinct_snapshot(events.filter(F.col("event_type") == kind), "user_id", 7) for kind in ("click", "view", "purchase", "signup", "error")]
    merged = merge_snapshots(spark, *(Snapshot.from_bytes(p.to_bytes()) for p in parts))
    whole, true = snapshot_estimate(spark, distinct_snapshot(events, "user_id", 7)), events.select("user_id").distinct().count()
    estimate = snapshot_estimate(spark, merged)
    return spark.createDataFrame([(estimate == whole, abs(estimate - true) <= 0.05 * true)], "merged_as_whole boolean, near boolean")


@query("sc02_guarded_division", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount = 0 THEN 0.0 ELSE l_tax / l_discount END AS ratio FROM lineitem")
def guarded_division(spark, d):
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", guarded_divide(F.col("l_tax"), F.col("l_discount")).alias("ratio"))


# --- streams -------------------------------------------------------------------------------------------


def _stream(spark, d):
    """Events as a stream of files: a copy in a folder, read in file order."""
    events = _table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    copy = materialise(events.repartitionByRange(3, "event_id"), "stream")
    return spark.readStream.schema(copy.schema).option("maxFilesPerTrigger", 1).parquet(copy._scratch_path)


@query("st05_stateful_stream", "SELECT user_id, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY user_id")
def stateful_stream(spark, d):
    """Keyed state over a stream: the last of every user's snapshots."""
    stream = _stream(spark, d).select("event_id", "user_id")
    out = lowering.stateful(stream, ["user_id"], "event_id", lambda: (0, 0), lambda s, r: (s[0] + 1, int(r["event_id"])), lambda k, s: [(*k, *s)], "user_id long, n long, last_id long", "n long, last_id long")
    return _drained(spark, out, "state").groupBy("user_id").agg(F.max("n").alias("n"), F.max("last_id").alias("last_id"))


@query("st04_sliding_windows", "SELECT epoch_us(s) AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY ALL")
def sliding_windows(spark, d):
    """Two-day windows that begin every day."""
    events = _table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = lowering.windowed(events, "ts", "2 days", "1 day", ["event_type"], slide="1 day", n=F.count(F.lit(1)))
    return out.select(F.unix_micros("start").alias("start"), "event_type", "n")


@query("st04_session_windows", "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, session")
def session_windows(spark, d):
    events = _table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = lowering.windowed(events, "ts", "6 hours", "1 day", ["user_id"], session=True, n=F.count(F.lit(1)))
    return out.select("user_id", F.unix_micros("start").alias("start"), "n")


@query("st02_stream_enrichment", "SELECT event_id, user_id, last_signup FROM events LEFT JOIN (SELECT user_id, max(event_id) AS last_signup FROM events WHERE event_type = 'signup' GROUP BY user_id) USING (user_id)")
def stream_enrichment(spark, d):
    """A stream with the latest reference row of each key."""
    signups = _table(spark, d, "events").filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("last_signup"))
    stream = _stream(spark, d).select("event_id", "user_id")
    return _drained(spark, lowering.enrich_stream(stream, signups, "user_id", "user_id", "last_signup", how="left"), "enriched")


@query(
    "mw01_guarded_stage",
    """WITH RECURSIVE e AS (SELECT epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (ORDER BY event_id) AS i FROM events),
b AS (SELECT i, t AS seen, 19.0::DOUBLE AS tokens, true AS ok FROM e WHERE i = 1
  UNION ALL SELECT i, greatest(seen, t), CASE WHEN full_ + 1e-9 < 1 THEN full_ ELSE full_ - 1 END, full_ + 1e-9 >= 1
  FROM (SELECT e.i, e.t, b.seen, least(20.0::DOUBLE, b.tokens + greatest(0.0::DOUBLE, e.t - b.seen) * (1.0::DOUBLE / 600)) AS full_ FROM b JOIN e ON e.i = b.i + 1))
SELECT CASE WHEN ok THEN 'ok' ELSE 'RateLimited' END AS kind, count(*) AS n FROM b GROUP BY 1""",
)
def guarded_calls(spark, d):
    """One limiter for a whole stage, whatever tasks it runs in."""
    calls = _table(spark, d, "events").select("event_id", "ts", F.col("event_type").alias("prompt"))
    lanes = middleware.guarded_stage(calls, "prompt", str.upper, "event_id", "ts", bucket=lambda: middleware.TokenBucket(1 / 600, 20))
    both = lanes.data.unionByName(lanes.errors)
    return both.groupBy(F.coalesce("_error_kind", F.lit("ok")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
