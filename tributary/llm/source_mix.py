"""Mixing sources to target weights by hash-threshold histograms.

Every document gets 64 bits of a hash of its id and text, so null and repeated ids spread too. A source's budget is met by the documents whose hash lies
below a threshold of that source; the threshold is found without sorting documents:

1. sum sizes by source and by the top bits of the hash (map-side partial sums; at most 2**bits rows a source);
2. running sums over that small histogram give the bucket in which the budget runs out: everything below
   it is in, everything above it is out;
3. only the documents of that boundary bucket are summed again by the next bits, until all 64 bits are used.
4. What is left of the budget at the threshold's own value goes to its rows, as many as come nearest: one document as a rule. Rows
   that repeat id and text share a hash; there it does not matter which of them are taken, and they are counted off by the
   partition they are read in, however many they are.

A larger budget gives a larger threshold, so the selections for growing budgets are nested, and reruns agree.
A source whose target exceeds its size is taken whole as often as it fits, and the rest of the target
is a threshold selection, so no document is taken more than `cap` times.

Targets: sources in code point order (null last) have the weights 5, 2, 1, repeating, and share the sum of
all sizes. No target exceeds `cap` times its source's size; the excess is shared among the others by weight
until none is above. That is a level to which all sources are filled by weight: with sources in order of limit / weight,
it is the largest of (total - limits before) / (weights from here on), so prefix sums give it, in range partitions and
without rounds.

Defined results. Null text has size 0. A null source is a source of its own. Documents of size 0 have
taken 0. Texts of any length are read whole. Columns of docs with the operator's own names are carried in a struct. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, table, word_count

WEIGHTS, CAP = (5.0, 2.0, 1.0), 3.0
#: Bits of the hash that each histogram resolves, from the top; they add up to 64.
LEVELS = (12, 16, 36)
_MIN = -(2**63)


def row_hash(seed: int, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """64 bits of the MD5 of seed, id and text, as a signed long."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 16), 16, -10).cast("long")


def _ranges(df: DataFrame, by: Column, name: str) -> DataFrame:
    """df, written in range partitions of `by`, with _p (partition) and _i (place within it)."""
    dealt = df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id())
    dealt = dealt.select(*df.columns, F.shiftright("_at", 33).alias("_p"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_i"))
    return materialise(dealt, name)


def _before(dealt: DataFrame, **sums: Column) -> DataFrame:
    """_p and, for each sum, its total over the partitions before; one row a partition."""
    upto = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_p").agg(*(v.alias(k) for k, v in sums.items()))
    return F.broadcast(totals.select("_p", *(F.coalesce(F.sum(k).over(upto), F.lit(0)).alias(k) for k in sums)))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sizes(source, source_size) -> source, source_size, target. One row per source, nulls included."""
    dealt = _ranges(sizes, F.col("source").asc_nulls_last(), "sources")
    rank = F.col("_n") + F.col("_i")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    limit = F.lit(float(cap)) * F.col("source_size")
    ranked = dealt.join(_before(dealt, _n=F.count(F.lit(1))), "_p").select("source", "source_size", weight.alias("_w"), limit.alias("_limit"))
    # Prefix sums in order of limit / weight: the level is the largest that any source finds at its turn.
    dealt = _ranges(ranked, F.col("_limit") / F.col("_w"), "limits")
    upto = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    inside = [F.coalesce(F.sum(c).over(upto), F.lit(0.0)).alias(f"{c}_in") for c in ("_limit", "_w")]
    placed = dealt.select("_p", "_w", *inside).join(_before(dealt, _limit_at=F.sum("_limit"), _w_at=F.sum("_w")), "_p")
    total = dealt.agg(F.sum(F.col("source_size").cast("double")).alias("_total"), F.sum("_w").alias("_weights"))
    level = (F.col("_total") - F.col("_limit_at") - F.col("_limit_in")) / (F.col("_weights") - F.col("_w_at") - F.col("_w_in"))
    level = placed.crossJoin(F.broadcast(total)).agg(F.max(level).alias("_level"))  # one row
    return dealt.crossJoin(F.broadcast(level)).select("source", "source_size", F.least("_limit", F.col("_w") * F.col("_level")).alias("target"))


def _boundary(rows: DataFrame, key: list[str], bucket: Column, last: bool) -> DataFrame:
    """For each source in rows(source, _budget, size, _h): the bucket in which its budget runs out.

    On the last level a bucket is one hash value: as many of its _ties rows are taken as bring the sum nearest to the budget.
    """
    histogram = rows.groupBy(*key, "_budget", bucket.alias("_b")).agg(F.sum("size").alias("_sum"), F.count(F.lit(1)).alias("_ties"))
    upto = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    found = histogram.withColumn("_cum", F.sum("_sum").over(upto)).filter((F.col("_cum") > F.col("_budget")) & (F.col("_cum") - F.col("_sum") <= F.col("_budget")))
    left = F.col("_budget") - (F.col("_cum") - F.col("_sum"))
    taken = F.floor(left / (F.col("_sum") / F.col("_ties")) + 0.5).cast("long") if last else F.lit(0).cast("long")
    return found.select(*key, "_b", left.alias("_left"), taken.alias("_taken"), "_ties")


def mix_plan(rows: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """rows(source, size, _h), materialised -> one row per source (_src): source_size, target, and how its documents are taken."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(cap)))).otherwise(0).cast("long")
    targets = source_targets(sizes, weights, cap).withColumn("_whole", whole)
    budget = F.when(F.col("_whole") >= int(cap), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("target") - F.col("_whole") * F.col("source_size")))
    targets = materialise(targets.withColumn("_budget", budget).withColumnRenamed("source", "_src"), "targets")

    # Each level keeps only the rows of the boundary bucket of their source.
    open_rows = rows.join(targets.filter("_budget > 0").select("_src", "_budget"), F.col("source").eqNullSafe(F.col("_src"))).select("_src", "_budget", "size", "_h")
    none = F.lit(0).cast("long")
    shift, threshold = 64, targets.select("_src", none.alias("_thr"))
    for i, bits in enumerate(LEVELS):
        shift -= bits
        bucket = F.shiftrightunsigned("_h", shift).bitwiseAND((1 << bits) - 1)
        last = i == len(LEVELS) - 1
        edge = materialise(_boundary(open_rows, ["_src"], bucket, last), f"edge{i}").withColumnRenamed("_src", "_s")
        prefix = F.col("_thr").bitwiseOR(F.shiftleft(F.coalesce("_b", none), shift)).alias("_thr")
        included = [F.coalesce("_taken", none).alias("_taken"), F.coalesce("_ties", none).alias("_ties")] if last else []
        threshold = threshold.join(edge, F.col("_src").eqNullSafe(F.col("_s")), "left").select("_src", prefix, *included)
        if not last:
            inside = open_rows.join(edge, F.col("_src").eqNullSafe(F.col("_s")) & (bucket == F.col("_b")))
            open_rows = materialise(inside.select("_src", F.col("_left").alias("_budget"), "size", "_h"), f"open{i}")
    threshold = threshold.withColumnRenamed("_src", "_t")
    return materialise(targets.join(threshold, F.col("_src").eqNullSafe(F.col("_t"))).drop("_t"), "plan")


def _apply(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows(source, _h, ...) joined with the plan's row of their source, and _times: how often each is taken."""
    flip = F.lit(_MIN).cast("long")  # unsigned order as signed order
    at, bar = F.col("_h").bitwiseXOR(flip), F.col("_thr").bitwiseXOR(flip)
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("_src")))
    edge = (F.col("_budget") > 0) & (F.col("_h") == F.col("_thr"))
    split = edge & (F.col("_taken") > 0) & (F.col("_taken") < F.col("_ties"))
    extra = (F.col("_budget") > 0) & ((at < bar) | (edge & (F.col("_taken") >= F.col("_ties")) & (F.col("_ties") > 0)))
    plain = joined.filter(~split).withColumn("_times", F.col("_whole") + extra.cast("long"))
    # Rows that share the threshold's hash and are taken in part: counted off within the partition they are read in, then over partitions.
    tied = joined.filter(split).withColumn("_p", F.spark_partition_id()).withColumn("_o", F.monotonically_increasing_id())
    within = Window.partitionBy("_src", "_p").orderBy("_o")
    upto = Window.partitionBy("_src").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = tied.groupBy("_src", "_p").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_src").alias("_s"), F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_n"))
    counted = tied.withColumn("_r", F.row_number().over(within)).join(before, F.col("_src").eqNullSafe(F.col("_s")) & (F.col("_p") == F.col("_q")))
    counted = counted.withColumn("_times", F.col("_whole") + (F.col("_n") + F.col("_r") <= F.col("_taken")).cast("long"))
    return plain.unionByName(counted.select(*plain.columns))


def mix_sources(rows: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, seed: int = 6) -> DataFrame:
    """rows(doc_id, source, size, and _h or else a hash of doc_id alone) -> doc_id, source, size, source_size, target, taken."""
    h = F.col("_h") if "_h" in rows.columns else F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"))
    rows = materialise(rows.select("doc_id", "source", "size", h.alias("_h")), "sized")
    plan = mix_plan(rows, weights, cap)
    return _apply(rows, plan).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("_times")).alias("taken"))


def take_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, seed: int = 6) -> DataFrame:
    """The rows of docs(doc_id, source, text, ...) that the mix takes, each as often as it is taken."""
    # The rows travel as one struct, so no column of docs meets one of the operator's own.
    rows = docs.select(F.struct("*").alias("_row"), F.col("source"), row_hash(seed).alias("_h"))
    sized = docs.select("source", word_count(F.col("text")).alias("size"), row_hash(seed).alias("_h"))
    plan = mix_plan(materialise(sized, "sized"), weights, cap).select("_src", "_whole", "_budget", "_thr", "_taken", "_ties")
    dealt = _apply(rows, plan).filter("_times > 0")
    repeated = dealt.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    return repeated.select(*(F.col("_row")[c].alias(c) for c in docs.columns))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(6).alias("_h"))
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  CAST('0x' || substr(md5('6:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 16) AS UBIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0::DOUBLE, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS w FROM d GROUP BY source),
o AS (SELECT *, 3.0::DOUBLE * source_size AS lim, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST) AS i FROM s),
l AS (SELECT max(((SELECT sum(source_size) FROM s)::DOUBLE - coalesce((SELECT sum(b.lim) FROM o b WHERE b.i < o.i), 0)) / ((SELECT sum(w) FROM s) - coalesce((SELECT sum(b.w) FROM o b WHERE b.i < o.i), 0))) AS level FROM o),
t AS (SELECT source, source_size, least(lim, w * level) AS target FROM o, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS whole FROM t),
q AS (SELECT *, CASE WHEN whole >= 3 THEN 0.0 ELSE greatest(0.0, target - whole * source_size) END AS budget FROM p),
c AS (SELECT doc_id, d.source, size, source_size, target, whole, budget, sum(size) OVER (PARTITION BY d.source ORDER BY h) AS cum, sum(size) OVER (PARTITION BY d.source, h) AS here
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (whole + CASE
  WHEN budget <= 0 THEN 0 WHEN cum <= budget THEN 1 WHEN cum - here <= budget AND floor((budget - (cum - here)) / here + 0.5) >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""
