"""One query per operator over the driver's tables, and the same result as SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import middleware
from .contracts import undelivered
from .errors import error_totals
from .functions.hashing import sha256_text, stable_hash64_column
from .functions.scalars import bucketise, characters, saturating_add, spelled_digit
from .functions.statistics import histogram, percentiles
from .journal.verify import compare
from .lineage import latest_contributors, merged_correlation
from .metrics import stage_metrics
from .operators import accumulate as acc
from .operators import join as joins
from .operators import tokens
from .operators import transform as tr
from .operators.accumulate import Agg
from .operators.cycle import iterate
from .order import canonical_fan_in, causal_order, number_rows
from .sinks.csv import CsvSink
from .sources.csv import read_csv
from .storage import shared_dir

QUERIES: dict = {}
ORACLES: dict = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def _net(price: str = "l_extendedprice", discount: str = "l_discount") -> F.Column:
    """Net price as an exact decimal: both factors have two decimals, so sums do not depend on their order."""
    return (F.col(price).cast("decimal(18,2)") * (F.lit(1).cast("decimal(4,2)") - F.col(discount).cast("decimal(4,2)"))).cast("decimal(18,4)")


NET = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4))"
SUM_NET = f"CAST(sum({NET}) AS DOUBLE)"


@query("q01_segment_revenue", f"SELECT c_mktsegment, {SUM_NET} AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R' GROUP BY c_mktsegment")
def segment_revenue(spark, d):
    lines = tr.filter_map(_table(spark, d, "lineitem"), F.col("l_returnflag") == "R", {"l_orderkey": "l_orderkey", "net": _net()})
    orders = _table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers = _table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    with_orders = joins.inner(orders, lines, "o_orderkey", "l_orderkey", "o_orderkey", unique_key=True)
    enriched = joins.inner(customers, with_orders, "c_custkey", "o_custkey", "c_custkey", unique_key=True)
    return acc.group_by("c_mktsegment", revenue=Agg.sum("net"), n=Agg.count()).apply(enriched).withColumn("revenue", F.col("revenue").cast("double"))


@query("tr01_map", f"SELECT l_orderkey, l_linenumber, l_partkey, CAST({NET} AS DOUBLE) AS net FROM lineitem")
def map_net(spark, d):
    return tr.map_rows(_table(spark, d, "lineitem"), {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "l_partkey": "l_partkey", "net": _net().cast("double")})


@query("tr02_filter", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'purchase' AND user_id > 10")
def filter_events(spark, d):
    return tr.filter_rows(_table(spark, d, "events").select("event_id", "user_id", "event_type"), "event_type = 'purchase' and user_id > 10")


@query("tr03_filter_map_buckets", "SELECT CASE WHEN l_quantity <= 10 THEN 'small' WHEN l_quantity <= 30 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def buckets(spark, d):
    rows = tr.filter_map(_table(spark, d, "lineitem"), "l_returnflag <> 'N'", {"bucket": bucketise("l_quantity", [(10, "small"), (30, "medium")], "large")})
    return acc.group_by("bucket", n=Agg.count()).apply(rows)


@query("tr04_try_map_errors", "SELECT CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 THEN 'Unknown' ELSE 'ok' END AS error_kind, count(*) AS n FROM events GROUP BY 1")
def try_map_errors(spark, d):
    events = _table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    lanes = tr.try_map(events, {"event_id": "event_id", "k": "k"}, F.when(F.col("k") > 50, F.concat(F.lit("typed try-map failed: k="), F.col("k"))))
    ok = lanes.data.agg(F.count(F.lit(1)).alias("n")).select(F.lit("ok").alias("error_kind"), "n")
    return ok.unionByName(error_totals(lanes.errors))


@query(
    "tr05_emit_many_characters",
    "SELECT CASE c WHEN '0' THEN 'zero' WHEN '1' THEN 'one' WHEN '2' THEN 'two' WHEN '3' THEN 'three' WHEN '4' THEN 'four' WHEN '5' THEN 'five' WHEN '6' THEN 'six' WHEN '7' THEN 'seven' WHEN '8' THEN 'eight' WHEN '9' THEN 'nine' ELSE upper(c) END AS shown, count(*) AS n FROM (SELECT unnest(string_split(c_name, '')) AS c FROM customer) WHERE c <> '' GROUP BY 1",
)
def characters_of_names(spark, d):
    chars = tr.emit_many(_table(spark, d, "customer"), characters(F.col("c_name")), "c")
    return tr.map_rows(chars, {"shown": spelled_digit(F.upper("c"))}).groupBy("shown").agg(F.count(F.lit(1)).alias("n"))


@query("tr06_route_types", "SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1")
def route_types(spark, d):
    events = _table(spark, d, "events").select("event_id", "event_type")
    clicks, purchases = tr.fan_out(events, lambda e: tr.port(e, "click"), lambda e: tr.port(e, "purchase"))
    return clicks.unionByName(purchases).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))


_LATEST_ORDER = "SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey"


def _orders(spark, d):
    return _table(spark, d, "orders").filter("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("jn01_inner_latest", f"SELECT c_custkey, c_mktsegment, o_orderkey, o_orderstatus FROM customer JOIN ({_LATEST_ORDER}) ON o_custkey = c_custkey")
def inner_latest(spark, d):
    customers = _table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return joins.inner(_orders(spark, d), customers, "o_custkey", "c_custkey", "o_orderkey").drop("o_custkey")


@query("jn02_left_latest", f"SELECT c_custkey, coalesce(o_orderkey, -1) AS last_order, o_orderkey IS NOT NULL AS matched FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' GROUP BY o_custkey) ON o_custkey = c_custkey")
def left_latest(spark, d):
    """The catalogue has urgent pending orders, so many customers have no match."""
    customers = _table(spark, d, "customer").select("c_custkey")
    reference = _table(spark, d, "orders").filter("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey")
    return joins.left(reference, customers, "o_custkey", "c_custkey", "o_orderkey", {"c_custkey": "stream.c_custkey", "last_order": "coalesce(ref.o_orderkey, -1)", "matched": "ref is not null"})


@query(
    "jn03_strict_cut",
    "WITH j AS (SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > -980) ON c_custkey = o_custkey) SELECT o_orderkey, c_mktsegment FROM j WHERE o_orderkey < coalesce((SELECT min(o_orderkey) FROM j WHERE c_mktsegment IS NULL), 9223372036854775807)",
)
def strict_cut(spark, d):
    """The catalogue lacks customers far in debt: the stream ends at the first order of one."""
    reference = _table(spark, d, "customer").filter("c_acctbal > -980")
    orders = _table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return joins.strict(reference, orders, "c_custkey", "o_custkey", "c_custkey", "o_orderkey", {"o_orderkey": "stream.o_orderkey", "c_mktsegment": "ref.c_mktsegment"}, unique_key=True).rows


def _live(spark, d):
    events = _table(spark, d, "events").select("event_id", "user_id", "event_type")
    return events.filter("event_type = 'signup'").withColumnRenamed("event_id", "signup_id"), events.filter("event_type = 'purchase'")


_AS_OF = "SELECT event_id, event_type, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS signup_id FROM events WHERE event_type IN ('signup', 'purchase')"
_LIVE_EXPRS = {"event_id": "stream.event_id", "user_id": "stream.user_id", "signup_id": "ref.signup_id"}


@query("jn04_inner_live", f"SELECT event_id, user_id, signup_id FROM ({_AS_OF}) WHERE event_type = 'purchase' AND signup_id IS NOT NULL")
def inner_live(spark, d):
    ref, stream = _live(spark, d)
    return joins.inner_live(ref, stream, "user_id", "user_id", "signup_id", "event_id", _LIVE_EXPRS)


@query("jn05_left_live", f"SELECT event_id, user_id, signup_id FROM ({_AS_OF}) WHERE event_type = 'purchase'")
def left_live(spark, d):
    ref, stream = _live(spark, d)
    return joins.left_live(ref, stream, "user_id", "user_id", "signup_id", "event_id", _LIVE_EXPRS)


@query(
    "jn06_strict_live",
    f"WITH j AS (SELECT * FROM ({_AS_OF}) WHERE event_type = 'purchase'), c AS (SELECT min(event_id) AS cut FROM j WHERE signup_id IS NULL) SELECT event_id, user_id, signup_id, false AS missed FROM j, c WHERE cut IS NULL OR event_id < cut UNION ALL SELECT event_id, user_id, NULL, true FROM j, c WHERE event_id = cut",
)
def strict_live(spark, d):
    """Purchases up to the first one of a user who has not signed up yet, and that one, marked."""
    ref, stream = _live(spark, d)
    out = joins.strict_live(ref, stream, "user_id", "user_id", "signup_id", "event_id", _LIVE_EXPRS)
    missed = out.misses.agg(F.min(F.struct("stream.event_id", "stream.user_id")).alias("m")).filter("m is not null")
    return out.rows.withColumn("missed", F.lit(False)).unionByName(missed.select("m.event_id", "m.user_id", F.lit(None).cast("long").alias("signup_id"), F.lit(True).alias("missed")))


@query("jn07_latest", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_event(spark, d):
    return joins.latest(_table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query(
    "jn10_multi_key",
    "SELECT l_orderkey, count(p_partkey) AS n_refs, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS size FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) LEFT JOIN (SELECT * FROM part WHERE p_size >= 25) ON p_partkey = l_partkey GROUP BY l_orderkey",
)
def multi_key(spark, d):
    asked = _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("parts"))
    found = joins.multi_key(_table(spark, d, "part").select("p_partkey", "p_size"), asked, "p_partkey", "parts", "p_partkey", "l_orderkey", admit="p_size >= 25")
    return found.select("l_orderkey", F.size("refs").cast("long").alias("n_refs"), F.aggregate("refs", F.lit(0).cast("long"), lambda s, r: s + r["p_size"]).alias("size"))


@query("jn13_chain", f"SELECT r_name, n_name, {SUM_NET} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name")
def chain(spark, d):
    lines = _table(spark, d, "lineitem").select("l_orderkey", _net().alias("net"))
    enriched = joins.chain(
        lines,
        (_table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "l_orderkey", "o_orderkey"),
        (_table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey", "o_custkey", "c_custkey"),
        (_table(spark, d, "nation"), "n_nationkey", "c_nationkey", "n_nationkey"),
        (_table(spark, d, "region"), "r_regionkey", "n_regionkey", "r_regionkey"),
        unique_keys=True,
    )
    return enriched.groupBy("r_name", "n_name").agg(F.sum("net").cast("double").alias("revenue"))


@query("ag01_reduce", "SELECT count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem HAVING count(*) > 0")
def reduce_lines(spark, d):
    fold = acc.reduce(n=Agg.count(), quantity=Agg.sum(F.col("l_quantity").cast("decimal(18,2)")), low=Agg.min("l_extendedprice"), high=Agg.max("l_extendedprice"))
    return fold.apply(_table(spark, d, "lineitem")).withColumn("quantity", F.col("quantity").cast("double"))


@query("ag02_group_by", "SELECT user_id, count(*) AS n, max(value) AS high, arg_min(event_type, event_id) AS first_type FROM events GROUP BY user_id")
def group_events(spark, d):
    return acc.group_by("user_id", n=Agg.count(), high=Agg.max("value"), first_type=Agg.first("event_type", "event_id")).apply(_table(spark, d, "events"), "event_id")


@query("ag03_conflate", "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def conflate_events(spark, d):
    return acc.conflate("user_id").apply(_table(spark, d, "events").select("user_id", "event_id", "value"), "event_id")


_AG04 = """
WITH RECURSIVE e AS (SELECT user_id AS k, value AS s, event_id AS o, row_number() OVER (ORDER BY event_id) AS i FROM events),
m AS (
  SELECT i, [{'s': s, 'o': -o, 'k': k}] AS l FROM e WHERE i = 1
  UNION ALL
  SELECT i, CASE WHEN len(n) > 10 THEN n[2:] ELSE n END
  FROM (SELECT e.i, list_sort(list_append(list_filter(m.l, lambda x: x.k <> e.k), {'s': e.s, 'o': -e.o, 'k': e.k})) AS n FROM m JOIN e ON e.i = m.i + 1)),
t AS (SELECT l FROM m WHERE i = (SELECT max(i) FROM e))
SELECT 10 AS capacity, CAST(len(l) AS INTEGER) AS count, CAST(r AS INTEGER) AS rank, l[len(l) + 1 - r].k AS key, l[len(l) + 1 - r].s AS score FROM (SELECT l, unnest(range(1, len(l) + 1)) AS r FROM t)
"""


@query("ag04_top_n", _AG04)
def top_n(spark, d):
    """The bounded map is order-dependent; tests also compare it with a row-at-a-time simulator."""
    out = acc.top_n(10, "user_id", "value").apply(_table(spark, d, "events"), "event_id")
    return out.select("capacity", "count", F.explode("top_n").alias("t")).select("capacity", "count", "t.rank", "t.key", "t.score")


@query("ag05_top_n_by", f"SELECT rank, l_partkey, revenue, n FROM (SELECT CAST(row_number() OVER (ORDER BY sum({NET}) DESC, l_partkey) AS INTEGER) AS rank, l_partkey, {SUM_NET} AS revenue, count(*) AS n FROM lineitem GROUP BY l_partkey) WHERE rank <= 10")
def top_n_by(spark, d):
    lines = _table(spark, d, "lineitem").select("l_partkey", _net().alias("net"))
    out = acc.top_n_by(10, "l_partkey", "net").ranked(lines, "l_partkey")
    return out.select("rank", F.col("key").alias("l_partkey"), F.col("total").cast("double").alias("revenue"), "n")


@query("ag06_custom_accumulator", "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS types, min(value) AS low, max(value) AS high FROM events GROUP BY user_id")
def custom_accumulator(spark, d):
    def add(s, r):
        return (r["user_id"], s[1] + 1, s[2] | {r["event_type"]}, min(s[3], r["value"]), max(s[4], r["value"]))

    def show(s):
        return [{"user_id": s[0], "n": s[1], "types": len(s[2]), "low": s[3], "high": s[4]}]

    events = _table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return acc.custom(events, lambda: (None, 0, frozenset(), float("inf"), float("-inf")), add, show, "user_id long, n long, types long, low double, high double", keys=["user_id"], order="event_id")


@query("ag07_running_balance", "SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS balance FROM events")
def balance(spark, d):
    events = _table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") == "purchase", 1).otherwise(-1).alias("amount"))
    return acc.running_balance(events, ["user_id"], "event_id", "amount").drop("amount")


@query("ag09_map_reduce_collect", "SELECT source, count(*) AS chunk_count, 'ok' AS status, string_agg(CAST(n_chars AS VARCHAR), ',' ORDER BY doc_id) AS joined FROM documents GROUP BY source")
def collect_chunks(spark, d):
    docs = _table(spark, d, "documents").select("source", "doc_id", F.col("n_chars").cast("string").alias("value"), F.lit("ok").alias("status"))
    manifests = docs.groupBy("source").agg(F.count(F.lit(1)).alias("chunk_count"))
    out = tokens.collect_by_input(manifests, docs, "source", "doc_id", "value")
    return out.select("source", "chunk_count", "status", F.array_join("values", ",").alias("joined"))


@query("ag10_counters", "SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counters FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def counters(spark, d):
    out = acc.counters(_table(spark, d, "events"), ["user_id"], "event_type")
    shown = F.transform(F.array_sort(F.map_entries("counters")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return out.select("user_id", F.array_join(shown, ",").alias("counters"))


@query(
    "ag10_funnel",
    "WITH u AS (SELECT user_id, bool_or(event_type = 'view') AS v, bool_or(event_type = 'click') AS c, bool_or(event_type = 'purchase') AS p FROM events GROUP BY user_id) SELECT count(*) FILTER (v) AS viewed, count(*) FILTER (v AND c) AS clicked, count(*) FILTER (v AND c AND p) AS bought FROM u",
)
def funnel(spark, d):
    steps = {"viewed": "event_type = 'view'", "clicked": "event_type = 'click'", "bought": "event_type = 'purchase'"}
    return acc.funnel(_table(spark, d, "events"), ["user_id"], steps)


@query(
    "ag10_sessions",
    "SELECT user_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, CAST(round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE) AS BIGINT) AS lasted FROM events GROUP BY user_id",
)
def user_sessions(spark, d):
    out = acc.session_fold(_table(spark, d, "events"), ["user_id"], "event_id", "event_type", "ts")
    return out.select("user_id", "n", F.col("first").alias("first_id"), F.col("last").alias("last_id"), F.array_join("kinds", ",").alias("kinds"), F.round("seconds").cast("long").alias("lasted"))


@query("em02_emit_always", "SELECT row_number() OVER w AS n, CAST(sum(user_id) OVER w AS BIGINT) AS users, CAST(row_number() OVER w AS BIGINT) AS _emitted_at, false AS _terminal FROM events WINDOW w AS (ORDER BY event_id) UNION ALL SELECT count(*), CAST(sum(user_id) AS BIGINT), count(*), true FROM events")
def emit_always(spark, d):
    return acc.reduce(n=Agg.count(), users=Agg.sum("user_id")).emit_always().apply(_table(spark, d, "events").select("event_id", "user_id"), "event_id")


@query(
    "em03_every_n_reduce",
    "WITH r AS (SELECT row_number() OVER w AS n, CAST(sum(user_id) OVER w AS BIGINT) AS users, max(value) OVER w AS high FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)) SELECT n, users, high, n AS _emitted_at, false AS _terminal FROM r WHERE n % 100 = 0 UNION ALL SELECT n, users, high, n, true FROM r WHERE n = (SELECT max(n) FROM r)",
)
def every_n_reduce(spark, d):
    fold = acc.reduce(n=Agg.count(), users=Agg.sum("user_id"), high=Agg.max("value")).emit_every_n(100)
    return fold.apply(_table(spark, d, "events").select("event_id", "user_id", "value"), "event_id")


@query(
    "em05_every_n_group_by",
    "WITH e AS (SELECT user_id, row_number() OVER (ORDER BY event_id) AS nth FROM events), c AS (SELECT DISTINCT nth AS stop, false AS term FROM e WHERE nth % 1000 = 0 UNION ALL SELECT max(nth), true FROM e) SELECT user_id, count(*) AS n, stop AS _emitted_at, term AS _terminal FROM c JOIN e ON nth <= stop GROUP BY user_id, stop, term",
)
def every_n_group(spark, d):
    return acc.group_by("user_id", n=Agg.count()).emit_every_n(1000).apply(_table(spark, d, "events").select("event_id", "user_id"), "event_id")


_EM04 = """
WITH RECURSIVE e AS (SELECT event_id, epoch_us(ts) AS t FROM events),
p AS (
  SELECT min(t) AS opened, (SELECT min(t) FROM e WHERE t >= (SELECT min(t) FROM e) + 86400000000) AS closed FROM e
  UNION ALL
  SELECT n.opened, (SELECT min(t) FROM e WHERE t >= n.opened + 86400000000)
  FROM (SELECT (SELECT min(t) FROM e WHERE t > p.closed) AS opened FROM p WHERE p.closed IS NOT NULL) n WHERE n.opened IS NOT NULL)
SELECT count(*) AS n, CAST(min(event_id) AS BIGINT) AS first_id, CAST(max(event_id) AS BIGINT) AS last_id
FROM p JOIN e ON e.t >= p.opened AND (p.closed IS NULL OR e.t <= p.closed) GROUP BY p.opened
"""


@query("em04_time_window", _EM04)
def time_window(spark, d):
    events = _table(spark, d, "events").select("event_id", "ts")
    fold = acc.reduce(n=Agg.count(), first_id=Agg.min("event_id"), last_id=Agg.max("event_id")).emit_within(86400)
    return fold.apply(events, "ts", "ts").drop("_period")


@query(
    "or01_canonical_fan_in",
    "SELECT row_number() OVER (ORDER BY n, source) AS _seq, source AS _input, key FROM (SELECT row_number() OVER (ORDER BY event_id) AS n, 'events' AS source, event_id AS key FROM events UNION ALL SELECT row_number() OVER (ORDER BY o_orderkey), 'orders', o_orderkey FROM orders)",
)
def fan_in(spark, d):
    events = _table(spark, d, "events").select(F.col("event_id").alias("key"))
    orders = _table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    return canonical_fan_in({"events": events, "orders": orders}, "key")


@query("or02_causal_order", "SELECT event_id, row_number() OVER (ORDER BY event_id % 7 + event_id % 5, event_id) AS _seq FROM events")
def causal(spark, d):
    clock = F.create_map(F.lit("a"), F.col("event_id") % 7, F.lit("b"), F.col("event_id") % 5)
    events = _table(spark, d, "events").select("event_id", clock.alias("_clock"))
    return causal_order(events, "_clock", "event_id").select("event_id", "_seq")


@query("st07_cycle", "SELECT CASE WHEN floor(log2(greatest(c_custkey, 1))) <= 8 THEN 'ok' ELSE 'Unknown' END AS lane, CAST(least(floor(log2(greatest(c_custkey, 1))), 8) AS INTEGER) AS depth, count(*) AS n FROM customer GROUP BY 1, 2")
def cycle(spark, d):
    start = _table(spark, d, "customer").select(F.col("c_custkey").alias("v"))
    lanes = iterate(start, lambda df: df.select(F.expr("v div 2").alias("v")), "v <= 1", 8)
    both = lanes.data.unionByName(lanes.errors)
    return both.groupBy(F.coalesce("_error_kind", F.lit("ok")).alias("lane"), F.col("_cycle_depth").alias("depth")).agg(F.count(F.lit(1)).alias("n"))


@query("ai01_estimate_text", "SELECT source, CAST(sum(ceil(octet_length(encode(text)) / 4.0)) AS BIGINT) AS estimated_tokens FROM documents GROUP BY source")
def estimate_text(spark, d):
    return tokens.estimates_by(_table(spark, d, "documents"), ["source"], "text")


@query("ai02_estimate_chat", "SELECT conv_id, CAST(ceil(sum(octet_length(encode(text))) / 4.0) + 4 * count(*) + 8 AS BIGINT) AS estimated_tokens FROM conversations GROUP BY conv_id")
def estimate_chat(spark, d):
    return tokens.HeuristicEstimator().chat(_table(spark, d, "conversations"), ["conv_id"], "text")


@query("ai03_remaining_budget", "SELECT doc_id, CAST(greatest(0, 500 - ceil(octet_length(encode(text)) / 4.0)) AS BIGINT) AS remaining FROM documents")
def remaining(spark, d):
    docs = _table(spark, d, "documents")
    return docs.select("doc_id", tokens.remaining_budget(500, tokens.HeuristicEstimator().text("text")).cast("long").alias("remaining"))


_AI04 = """
WITH RECURSIVE d AS (SELECT source, doc_id, CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT) AS tokens,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ordinal FROM documents),
f AS (
  SELECT source, doc_id, ordinal, tokens, CAST(0 AS BIGINT) AS grp, CASE WHEN tokens > 3000 THEN 0 ELSE tokens END AS used, tokens > 3000 AS oversize FROM d WHERE ordinal = 0
  UNION ALL
  SELECT d.source, d.doc_id, d.ordinal, d.tokens,
    CASE WHEN d.tokens <= 3000 AND f.used > 0 AND f.used + d.tokens <= 3000 THEN f.grp ELSE f.grp + 1 END,
    CASE WHEN d.tokens > 3000 THEN 0 WHEN f.used > 0 AND f.used + d.tokens <= 3000 THEN f.used + d.tokens ELSE d.tokens END,
    d.tokens > 3000
  FROM f JOIN d ON d.source = f.source AND d.ordinal = f.ordinal + 1)
SELECT source, doc_id, ordinal, tokens, grp, oversize FROM f
"""


@query("ai04_split_to_budget", _AI04)
def split_to_budget(spark, d):
    docs = _table(spark, d, "documents").select("source", "doc_id", tokens.HeuristicEstimator().text("text").alias("tokens"))
    return tokens.split_to_budget(docs, ["source"], "doc_id", "tokens", 3000)


#: Pieces of at most 4,000 bytes: a cut moves back over bytes inside a character (80 to BF), of which there are three at most.
_CHUNKS = """
WITH RECURSIVE x AS MATERIALIZED (SELECT doc_id, b - 1 AS b FROM (SELECT doc_id, unnest(h) AS h, generate_subscripts(h, 1) AS b FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS h FROM documents)) WHERE h BETWEEN '80' AND 'BF'),
p AS (
  SELECT source, doc_id, 0 AS piece, CAST(0 AS BIGINT) AS start, CAST(strlen(text) AS BIGINT) AS total FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT source, p.doc_id, piece + 1, start + 4000 - CASE WHEN x0.b IS NULL THEN 0 WHEN x1.b IS NULL THEN 1 WHEN x2.b IS NULL THEN 2 ELSE 3 END, total
  FROM p LEFT JOIN x x0 ON x0.doc_id = p.doc_id AND x0.b = start + 4000 LEFT JOIN x x1 ON x1.doc_id = p.doc_id AND x1.b = start + 3999 LEFT JOIN x x2 ON x2.doc_id = p.doc_id AND x2.b = start + 3998
  WHERE total - start > 4000),
d AS (SELECT source, CAST(ceil((coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY piece), total) - start) / 4.0) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id, piece) AS i FROM p),
f AS (
  SELECT source, i, tokens, CAST(0 AS BIGINT) AS chunk_index, tokens AS used, 1 AS held FROM d WHERE i = 1
  UNION ALL
  SELECT source, i, tokens, CASE WHEN shut THEN chunk_index + 1 ELSE chunk_index END, CASE WHEN shut THEN tokens ELSE used + tokens END, CASE WHEN shut THEN 1 ELSE held + 1 END
  FROM (SELECT d.source, d.i, d.tokens, f.chunk_index, f.used, f.held, f.used + d.tokens > 1000 OR f.held >= {max_items} AS shut FROM f JOIN d ON d.source IS NOT DISTINCT FROM f.source AND d.i = f.i + 1)),
c AS (SELECT source, chunk_index, CAST(sum(tokens) AS BIGINT) AS estimated_tokens, CAST(count(*) AS INTEGER) AS items FROM f GROUP BY source, chunk_index)
"""


@query("ai05_chunk_by_budget", _CHUNKS.format(max_items=50) + "SELECT source, chunk_index, count(*) OVER (PARTITION BY source) AS chunk_count, estimated_tokens, CAST(0 AS BIGINT) AS depth, items FROM c")
def chunks(spark, d):
    """Documents above the budget go in as pieces, so that whole texts are chunked."""
    docs = tokens.split_items(_table(spark, d, "documents").select("source", "doc_id", "text"), "doc_id", "text", 1000)
    out = tokens.chunk_by_budget(docs, ["source"], "doc_id", "text", lambda text, depth: text, 1000, 50)
    return out.select("source", "chunk_index", "chunk_count", "estimated_tokens", "depth", F.size("item_ordinals").alias("items"))


@query("ai07_map_reduce", _CHUNKS.format(max_items=1_000_000) + "SELECT source, 'ok' AS status, count(*) AS chunk_count, CAST((SELECT sum(length(text)) FROM documents WHERE documents.source IS NOT DISTINCT FROM c.source) + sum(items) - count(*) AS VARCHAR) AS result FROM c GROUP BY source")
def map_reduce(spark, d):
    docs = tokens.split_items(_table(spark, d, "documents").select("source", "doc_id", "text"), "doc_id", "text", 1000)
    out = tokens.map_reduce(docs, "source", "doc_id", "text", lambda text, depth: text, 1000, lambda p: str(len(p)), lambda p: str(sum(map(int, p.split("\n")))))
    return out.select("source", "status", "chunk_count", "result")


@query("ai08_inference", "SELECT conv_id, turn, text || ' (' || length(text) || ')' AS reply FROM conversations WHERE role = 'user'")
def inference(spark, d):
    prompts = _table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    return tokens.inference(prompts, "text", lambda p: f"{p} ({len(p)})").data.select("conv_id", "turn", "reply")


@query("ai10_text_hash", "SELECT doc_id, sha256(text) AS text_hash FROM documents")
def text_hash(spark, d):
    return _table(spark, d, "documents").select("doc_id", sha256_text("text").alias("text_hash"))


@query("ai12_structured_output", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def structured(spark, d):
    from pyspark.sql import types as T

    shape = T.StructType([T.StructField("k", T.LongType(), False)])
    lanes = tokens.decode_structured(_table(spark, d, "events"), "props", shape)
    return lanes.data.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("decoded.k").alias("total"))


#: FNV-1a over the bytes from its offset xor 7, then the finaliser, in 128-bit arithmetic.
_AP01 = """
WITH h AS (SELECT doc_id, list_reduce(list_concat([xor(14695981039346656037::UBIGINT, 7::UBIGINT)], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: CAST('0x' || p AS UBIGINT))),
  lambda a, b: CAST((CAST(xor(a, b) AS UHUGEINT) * 1099511628211) % 18446744073709551616::UHUGEINT AS UBIGINT)) AS h FROM documents),
m1 AS (SELECT doc_id, CAST((CAST(xor(h, h >> 33) AS UHUGEINT) * 18397679294719823053::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS h FROM h),
m2 AS (SELECT doc_id, CAST((CAST(xor(h, h >> 33) AS UHUGEINT) * 14181476777654086739::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS h FROM m1)
SELECT doc_id, lower(lpad(hex(xor(h, h >> 33)), 16, '0')) AS hash FROM m2
"""


@query("ap01_stable_hash", _AP01)
def stable_hash(spark, d):
    return _table(spark, d, "documents").select("doc_id", stable_hash64_column("text", 7).alias("hash"))


@query("ap03_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 0.999), 6) AS p999 FROM events GROUP BY event_type")
def exact_percentiles(spark, d):
    out = percentiles(_table(spark, d, "events"), "value", ["event_type"], exact=True)
    return out.select("event_type", *(F.round(c, 6).alias(c) for c in ("p50", "p90", "p95", "p99", "p999")))


@query("ap03_histogram", "SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, (SELECT unnest([10.0::DOUBLE, 50.0, 100.0]) AS le) GROUP BY event_type, le")
def value_histogram(spark, d):
    out = histogram(_table(spark, d, "events"), "value", [10.0, 50.0, 100.0], ["event_type"])
    return out.filter("le < double('infinity')").select("event_type", "le", "n")


@query(
    "ln01_parents",
    "SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS parents FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 100 GROUP BY user_id",
)
def parents(spark, d):
    out = latest_contributors(_table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id")
    return out.select("user_id", F.array_join("parents", ",").alias("parents"))


@query(
    "ln02_correlation",
    "WITH f AS (SELECT event_type, user_id, min(event_id) AS first FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY first, user_id) AS k FROM f) SELECT event_type, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY user_id) FILTER (k <= 100) AS correlations, count(*) > 100 AS truncated FROM r GROUP BY event_type",
)
def correlation(spark, d):
    out = merged_correlation(_table(spark, d, "events").select("event_type", "user_id", "event_id"), ["event_type"], "user_id", "event_id")
    return out.select("event_type", F.array_join("correlations", ",").alias("correlations"), "truncated")


@query("ct01_delivery_gaps", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def delivery_gaps(spark, d):
    receipts = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return undelivered(_table(spark, d, "orders"), receipts, "o_orderkey")


@query("vf01_compare_runs", "SELECT row_number() OVER (ORDER BY event_id) AS _pos FROM events QUALIFY event_id % 997 = 0")
def compare_runs(spark, d):
    baseline = number_rows(_table(spark, d, "events").select("event_id", "event_type", "value"), "event_id", "_pos")
    candidate = baseline.withColumn("value", F.when(F.col("event_id") % 997 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return compare(baseline, candidate).select("_pos")


_MW01 = """
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
b AS (
  SELECT user_id, i, t AS seen, 4.0::DOUBLE AS tokens, true AS admitted FROM e WHERE i = 1
  UNION ALL
  SELECT user_id, i, greatest(seen, t), CASE WHEN full_ + 1e-9 < 1 THEN full_ ELSE full_ - 1 END, full_ + 1e-9 >= 1
  FROM (SELECT e.user_id, e.i, e.t, b.seen, least(5.0::DOUBLE, b.tokens + greatest(0.0::DOUBLE, e.t - b.seen) * (1.0::DOUBLE / 600)) AS full_ FROM b JOIN e ON e.user_id = b.user_id AND e.i = b.i + 1))
SELECT user_id, admitted, count(*) AS n FROM b GROUP BY ALL
"""


@query("mw01_rate_limiter", _MW01)
def rate_limiter(spark, d):
    out = middleware.rate_limited(_table(spark, d, "events"), "event_id", "ts", 1 / 600, 5, keys=["user_id"])
    return out.groupBy("user_id", "admitted").agg(F.count(F.lit(1)).alias("n"))


_MW02 = """
WITH RECURSIVE e AS (SELECT user_id, event_type <> 'error' AS ok, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
b AS (
  SELECT user_id, i, 'closed' AS state, CASE WHEN ok THEN 0 ELSE 1 END AS fails, 0.0::DOUBLE AS opened, true AS allowed FROM e WHERE i = 1
  UNION ALL
  SELECT user_id, i,
    CASE WHEN now = 'open' THEN 'open' WHEN now = 'half_open' THEN (CASE WHEN ok THEN 'closed' ELSE 'open' END) WHEN NOT ok AND fails + 1 >= 2 THEN 'open' ELSE 'closed' END,
    CASE WHEN now = 'open' THEN fails WHEN now = 'half_open' OR ok OR fails + 1 >= 2 THEN 0 ELSE fails + 1 END,
    CASE WHEN now <> 'open' AND NOT ok AND (now = 'half_open' OR fails + 1 >= 2) THEN t ELSE opened END,
    now <> 'open'
  FROM (SELECT e.user_id, e.i, e.ok, e.t, b.fails, b.opened, CASE WHEN b.state = 'open' AND e.t - b.opened >= 3600 THEN 'half_open' ELSE b.state END AS now FROM b JOIN e ON e.user_id = b.user_id AND e.i = b.i + 1))
SELECT user_id, state, allowed, count(*) AS n FROM b GROUP BY ALL
"""


@query("mw02_circuit_breaker", _MW02)
def circuit_breaker(spark, d):
    calls = _table(spark, d, "events").withColumn("ok", F.col("event_type") != "error")
    out = middleware.breaker_states(calls, "event_id", "ts", "ok", lambda: middleware.CircuitBreaker(failures=2, open_for=3600), keys=["user_id"])
    return out.groupBy("user_id", "state", "allowed").agg(F.count(F.lit(1)).alias("n"))


@query("mx01_stage_metrics", "SELECT 'events' AS stage, 'events_total' AS metric, CAST(count(*) AS DOUBLE) AS value FROM events UNION ALL SELECT 'events', 'errors_total', CAST(count(*) AS DOUBLE) FROM events WHERE event_type = 'error'")
def metrics_table(spark, d):
    events = _table(spark, d, "events").withColumn("_error_kind", F.when(F.col("event_type") == "error", "Domain"))
    return stage_metrics("events", events).select("stage", "metric", "value")


@query("sr11_csv_round_trip", "SELECT n_nationkey, n_name, n_regionkey, CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS _seq FROM nation QUALIFY row_number() OVER (ORDER BY n_nationkey) > 5")
def csv_round_trip(spark, d):
    nation = _table(spark, d, "nation")
    path = f"{shared_dir(spark)}/nation-{uuid.uuid4().hex[:8]}"
    CsvSink(path, columns=nation.columns, single_file=True).write(nation, "n_nationkey")
    return read_csv(spark, path, nation.schema, skip_rows=5).data.drop("_error_kind", "_error_message")


@query("sc01_saturating", "SELECT l_orderkey, l_linenumber, l_partkey, least(CAST(l_partkey AS HUGEINT) + 9223372036854775000, 9223372036854775807)::BIGINT AS v FROM lineitem")
def saturating(spark, d):
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", saturating_add(F.col("l_partkey"), F.lit(9223372036854775000)).alias("v"))


from . import queries_runtime  # noqa: E402, F401  registers the rest with the decorator above
