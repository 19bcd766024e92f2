"""Line deduplication with a log-template tree (DataFrame functions only).

A line is a path in a fixed-depth tree: its number of tokens, then its LEADING tokens. Variable fields are
generalised in two steps: a token with a digit is a wildcard from the start, and within a leaf a token
that fewer than MIN_DOCS documents have at its position is a wildcard too. What is left of a line is its
template. One rule holds for lines of every length: at least CONSTANT of a template's tokens are constant, so a line of n
tokens has at most floor(n * (1 - CONSTANT)) wildcards of both kinds together. A line that would need more is its own template if
its digits leave it enough constants, and has no template otherwise: rows of numbers are never taken for each other.
A template is recurring when MIN_DOCS distinct documents have it (SHORT_DOCS for fewer than MIN_TOKENS tokens). Lines of a
recurring template are dropped from every document but the first (smallest doc_id), which keeps the passage once.

Long lines recur without a template. A line of LONG_TOKENS or more that two documents have letter by letter
is no chance, and from VERY_LONG_TOKENS on its numbers may differ as well (within the rule above): it stays in the first document
only. It must have LEADING tokens without a digit: rows of numbers alone may well be alike by chance.

How it scales. Pass one explodes lines to hashes (their leaves, and long lines whole; no text) and counts them by
map-side partial sums. Pass two keeps the lines whose leaf or whole several documents reach, few in most corpora; text
goes on only for lines that may have wildcards. The lists that select them, and the documents' drops, grow with the data, so these joins are
shuffles at every size, and Spark splits their hot keys. Documents of a template are counted over lines that were
first made unique within each document. Lines dropped are returned as positions to their document.

Defined results. Lines end at U+000A. A null text stays null, an empty one empty, with 0 lines dropped.
Tokens are what single spaces separate, outer spaces aside. Lines without a token, which part paragraphs, are never dropped. A line
that repeats only inside one document is no recurrence. A document is a (doc_id, text) pair: rows that repeat both count once and are treated
alike. Texts of any length are read whole. A document all of whose lines are dropped stays, with the empty text. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialise, table

MIN_DOCS, MIN_TOKENS, LEADING = 4, 3, 3
#: Share of a template's tokens that are constant, at least (a fraction, so that bounds are whole numbers).
CONSTANT = (6, 7)
#: Tokens from which a line recurs with two documents: letter by letter, and with its numbers masked.
LONG_TOKENS, VERY_LONG_TOKENS = 9, 50
#: Documents that must have a line of fewer than MIN_TOKENS.
SHORT_DOCS = 5
#: Lowest two bits of a key: what it stands for.
_LEAF, _SHORT, _WHOLE = 0, 1, 2
WILD = "<*>"


def _key(kind: int, *of: Column) -> Column:
    return F.xxhash64(*of).bitwiseAND(F.lit(-4)).bitwiseOR(F.lit(kind).cast("long"))


def _without(text: Column, part: str) -> Column:
    return F.octet_length(F.replace(text, F.lit(part), F.lit("")))


def _free(size: Column) -> Column:
    """Wildcards that a line of this many tokens may have."""
    return F.floor(size * (CONSTANT[1] - CONSTANT[0]) / CONSTANT[1]).cast("int")


def _lines(rows: DataFrame) -> DataFrame:
    """_id, _key, _pos, _line (masked), _size, _wild, _leaf, _whole of every line with a token, in plain columns (one generated stage)."""
    lines = rows.select("_id", "_key", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_raw"))
    lines = lines.withColumn("_raw", F.trim("_raw")).filter("_raw <> ''")
    lines = lines.withColumn("_size", F.octet_length("_raw") - _without(F.col("_raw"), " ") + 1)
    lines = lines.withColumn("_line", F.when(F.col("_raw").rlike("[0-9]"), F.regexp_replace("_raw", "[^ ]*[0-9][^ ]*", WILD)).otherwise(F.col("_raw")))
    lines = lines.withColumn("_wild", F.floor((F.octet_length("_line") - _without(F.col("_line"), WILD)) / len(WILD)).cast("int"))
    size, line = F.col("_size"), F.col("_line")
    sound = F.col("_wild") <= _free(size)
    tree = F.when(size < MIN_TOKENS, _key(_SHORT, size, line)).otherwise(_key(_LEAF, size, F.substring_index(line, " ", LEADING)))
    kind = F.lit("whole")
    whole = F.when((size >= VERY_LONG_TOKENS) & sound, _key(_WHOLE, kind, line)).when(size >= LONG_TOKENS, _key(_WHOLE, kind, F.col("_raw")))
    return lines.withColumn("_leaf", F.when(sound, tree)).withColumn("_whole", F.when(size - F.col("_wild") >= LEADING, whole))


def line_drops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _key, _drop: positions of the lines to drop, for documents that have any."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(text_col)).alias("_key"), F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull())
    lines = _lines(rows)
    kind = F.col("_at").bitwiseAND(F.lit(3))

    # Keys that several documents may reach: counted by lines, of which documents that repeat a line have more.
    document = F.xxhash64("_id", "_key").alias("_doc")
    reached = lines.select(document, F.explode(F.array("_leaf", "_whole")).alias("_at")).filter("_at is not null")
    reached = reached.groupBy("_at").agg(F.count(F.lit(1)).alias("_n"), F.min("_doc").alias("_low"), F.max("_doc").alias("_high"))
    least = F.when(kind == _LEAF, MIN_DOCS).when(kind == _SHORT, SHORT_DOCS).otherwise(2)
    reached = materialise(reached.filter((F.col("_n") >= least) & (F.col("_low") != F.col("_high"))).select("_at"), "reached")

    found = lines.withColumn("_hash", F.xxhash64(F.lit(10), F.col("_line")))
    may_vary = (kind == _LEAF) & (_free(F.col("_size")) > 0) & (F.col("_size") > LEADING)
    found = found.select("_id", "_key", "_pos", "_hash", "_size", "_line", F.explode(F.array("_leaf", "_whole")).alias("_at")).filter("_at is not null")
    found = found.withColumn("_line", F.when(may_vary, F.col("_line"))).join(reached.hint("merge"), "_at", "left_semi")
    found = materialise(found.withColumn("_kind", kind.cast("int")), "lines")

    # Long lines of two documents: all but the first go, and where there is one document only it is the first.
    same = found.filter(F.col("_kind") == _WHOLE)
    first = same.groupBy("_at").agg(F.min(F.struct("_id", "_key")).alias("_keep"))
    again = same.join(first, "_at").filter(~F.struct("_id", "_key").eqNullSafe(F.col("_keep"))).select("_id", "_key", "_pos")

    # Distinct lines of the leaves (by leaf and hash), with the number of documents that have them.
    kept = found.filter(F.col("_kind") != _WHOLE).withColumnRenamed("_at", "_leaf")
    once = materialise(kept.select("_leaf", "_hash", "_id", "_key").distinct(), "once")
    members = once.groupBy("_leaf", "_hash").agg(F.count(F.lit(1)).alias("_docs"), F.min(F.struct("_id", "_key")).alias("_first"))
    members = materialise(members, "members")

    # Lines that may have wildcards: which of their tokens recur at their place in the leaf.
    varying = kept.filter("_line is not null").select("_leaf", "_hash", "_size", "_line").dropDuplicates(["_leaf", "_hash"])
    tokens = F.split("_line", " ", -1)
    placed = varying.join(members, ["_leaf", "_hash"]).select("_leaf", "_hash", "_docs", "_size", F.posexplode(tokens).alias("_at", "_word"))
    placed = placed.filter(F.col("_word") != WILD).select("_leaf", "_hash", "_docs", "_size", "_at", F.xxhash64("_word").alias("_token"))
    placed = materialise(placed, "placed")
    constant = placed.groupBy("_leaf", "_at", "_token").agg(F.sum("_docs").alias("_n")).filter(F.col("_n") >= MIN_DOCS).select("_leaf", "_at", "_token")
    held = placed.join(constant, ["_leaf", "_at", "_token"]).groupBy("_leaf", "_hash", "_size").agg(F.array_sort(F.collect_list(F.struct("_at", "_token"))).alias("_held"))
    general = held.filter(F.col("_size") - F.size("_held") <= _free(F.col("_size"))).select("_leaf", "_hash", F.xxhash64("_size", "_held").alias("_general"))

    # Every other line is its own template. Documents of a template are counted: a line's are known, and where several
    # lines share a template, a document that has two of them counts once. The first document of each is found.
    of_line = members.join(general, ["_leaf", "_hash"], "left").select("_leaf", "_hash", "_docs", "_first", F.coalesce("_general", "_hash").alias("_template"))
    of_line = materialise(of_line, "templates")
    sums = of_line.groupBy("_leaf", "_template").agg(F.sum("_docs").alias("_n"), F.max("_docs").alias("_most"), F.min("_first").alias("_keep"))
    enough = F.when(F.col("_leaf").bitwiseAND(F.lit(3)) == _SHORT, SHORT_DOCS).otherwise(MIN_DOCS)
    sums = materialise(sums.filter(F.col("_n") >= enough), "sums")
    sure, unsure = sums.filter(F.col("_most") >= enough), sums.filter(F.col("_most") < enough)
    # An unsure template's lines have fewer than MIN_DOCS documents each.
    shared = of_line.join(unsure.select("_leaf", "_template"), ["_leaf", "_template"]).select("_leaf", "_hash", "_template")
    counted = once.join(shared, ["_leaf", "_hash"]).select("_leaf", "_template", "_id", "_key").distinct().groupBy("_leaf", "_template").count()
    proved = unsure.join(counted.filter(F.col("count") >= MIN_DOCS), ["_leaf", "_template"])
    recurring = sure.select("_leaf", "_template", "_keep").union(proved.select("_leaf", "_template", "_keep"))
    drop = of_line.join(recurring, ["_leaf", "_template"]).select("_leaf", "_hash", "_keep")
    gone = kept.select("_id", "_key", "_pos", "_leaf", "_hash").join(drop, ["_leaf", "_hash"]).filter(~F.struct("_id", "_key").eqNullSafe(F.col("_keep")))
    gone = gone.select("_id", "_key", "_pos").union(again)
    return materialise(gone.groupBy("_id", "_key").agg(F.collect_set("_pos").alias("_drop")), "drops")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """docs with recurring lines taken out of text_col; with report also n_lines and n_dropped, which take the place of
    columns of docs with these names.

    The rows travel as one struct, so no column of docs meets one of the operator's own.
    """
    drops = line_drops(docs, id_col, text_col)
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_doc"), F.xxhash64(text_col).alias("_hash"))
    joined = rows.join(drops.hint("merge"), F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_key")), "left")
    text = F.col("_row")[text_col]
    lines = F.split(text, "\n", -1)

    def kept_lines(parts: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "_drop")
        return F.array_join(F.transform(places, lambda i: F.get(parts, i)), "\n")

    clean = F.when(F.col("_drop").isNull(), text).otherwise(let(lines, kept_lines))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines")
    n_dropped = F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long").alias("n_dropped")
    kept = [clean.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns if not (report and c in ("n_lines", "n_dropped"))]
    return joined.select(*kept, *([n_lines, n_dropped] if report else []))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
