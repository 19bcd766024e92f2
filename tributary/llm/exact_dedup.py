"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

1. One pass over the texts turns each row into a 32-byte SHA-256 digest of its normalised text. Digests,
   not texts, are all that later steps move; they are written once and read back.
2. Misra-Gries: DataFrameStatFunctions.freqItems is the mergeable Misra-Gries summary (Karp, Shenker and
   Papadimitriou's form). It keeps at most 1/support counters, so every digest with more than
   support * rows occurrences is among its candidates, however large the input is.
3. The candidates are counted exactly, next to their winning row (map-side partial aggregates of at most
   1/support keys). Those verified as frequent are broadcast: at most 1/support rows of about 60 bytes.
4. Rows with a frequent digest are answered map-side from the broadcast. They are never shuffled, so no
   task ever gathers a hot group. Each of the other digests has at most support * rows rows, and those
   are shuffled by digest in the ordinary way.

Defined results. Null text counts as empty. Of equal texts the row with the largest doc_id stays; null
doc_ids come last; where that doc_id repeats, exactly one of its rows is kept (the last as stored). An
empty table gives an empty result. Texts of any length are read whole. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_ascii, materialise, table

#: A digest with more than this share of all rows is frequent. 1/SUPPORT bounds the summary and the broadcast.
SUPPORT = 0.001


def text_digest(text) -> F.Column:
    return F.sha2(lower_ascii(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.unhex(text_digest(F.col(text_col))).alias("_digest"))
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "digests")

    # The summary takes strings of hex digits; it is a DataFrame of one row with at most 1/support items.
    summary = rows.select(F.hex("_digest").alias("d")).freqItems(["d"], support)
    candidates = summary.select(F.explode("d_freqItems").alias("d")).select(F.unhex("d").alias("_digest"))
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    winner = F.max(F.struct(F.coalesce("_id", F.lit(-(2**63))).alias("o"), F.col("_row").alias("r"), F.col("_id").alias("id")))
    counted = (
        rows.join(F.broadcast(candidates), "_digest", "left_semi")
        .groupBy("_digest")
        .agg(F.count(F.lit(1)).alias("_n"), winner.alias("_win"))
        .crossJoin(F.broadcast(total))  # one row
        .filter(F.col("_n") > F.col("_total") * support)
        .select("_digest", "_n", "_win")
    )
    frequent = materialise(counted.coalesce(1), "frequent")  # at most 1/support rows, by the bound above

    def answer(df: DataFrame) -> DataFrame:
        return df.select(
            F.col("_id").alias(id_col),
            F.col("_win.id").alias("keep_id"),
            F.col("_n").alias("group_size"),
            (F.col("_row") == F.col("_win.r")).alias("kept"),
            F.lower(F.hex("_digest")).alias("text_sha256"),
        )

    hot = answer(rows.join(F.broadcast(frequent), "_digest"))
    rest = rows.join(F.broadcast(frequent.select("_digest")), "_digest", "left_anti")
    group = Window.partitionBy("_digest")
    cold = answer(rest.withColumn("_n", F.count(F.lit(1)).over(group)).withColumn("_win", winner.over(group)))
    return hot.unionByName(cold)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
