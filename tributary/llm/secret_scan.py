r"""Secret scans: exact patterns, and a randomness test battery with false-discovery control (DataFrame functions only).

Base kinds (leftmost, non-overlapping per kind, failing matches dropped without a retry): assign, access, hex.
Positions come from the pieces between matches: a match ends where the pieces and matches up to it end,
a running sum that is taken in blocks, so it stays near linear in texts with very many matches.

The battery looks at every other token of MIN_LENGTH or more characters of the base64 alphabets. From the
characters it infers an encoding (hex, base32, alphanumeric, letters, base64) and takes three statistics:
  - alphabet uniformity: chi-squared over that alphabet;
  - runs: how often the character class (lower, upper, digit; about the alphabet's middle for letters of one case) changes;
  - serial correlation of neighbouring characters, as numbers and as letter pairs (mean log-ratio of a pair's
    frequency in written words to that of independent letters).
Two questions are asked of them. Is the token a random draw from its encoding? Chi-squared, runs and numerical correlation must lie within
TOLERANCE standard deviations of what such a draw gives, else p is 1. Could it have been written? Each statistic is a
normal score against written text in that encoding: letter and pair frequencies, their spread and the mean word length come from all words of the
corpus (each distinct word once, times the logarithm of its count, so that no phrase makes the language) and a small
built-in vocabulary, and expectations follow from them per encoding: conditional on the letters hex has, with two class changes a word where
both cases occur, and so on. The scores depend on each other, so their weighted sum is judged against an empirical null: all distinct words of the corpus and the
vocabulary are dealt into tokens of four to eight, every word into one token of each style, and the sums of these tokens give its mean and deviation (widened by
NULL_SLACK). Few words are dealt several times, each as often, until there are about NULL_TOKENS tokens a style.
Without a corpus the sum is divided by the sum of the weights, which no dependence exceeds.
Tokens of one length class (powers of two) are controlled together at level ALPHA by the
Benjamini-Hochberg step-up rule: short tokens, of which there are many and whose tests are weak, do not
set the bar for long ones. The rule needs ranks over the whole corpus; they come from a histogram of
-log10(p) in twentieths, at most 2,001 rows a class, so no p-values are sorted or gathered.
A token that touches a base span is not reported again. Its kind is random. What comes to the driver of the corpus' words is a
table of letter pairs, at most 676 rows.

Defined results. Null and empty texts have no spans: counts 0, base_sha256 of the empty string, spans ''.
Texts of any length are read whole. Rows that repeat are answered each. Further columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, materialise, table

KINDS = ("assign", "access", "hex", "random")
_WORDS = ("password", "passwd", "secret", "token", "api_?key")
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in _WORDS)
ASSIGN = rf"(?:{_EITHER})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
# A maximal run is long enough or not, so the length can stand in these two patterns. Not in ASSIGN, where
# a short value uses up its match.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
MIN_LENGTH, ALPHA = 20, 0.01
TOKEN = f"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}={{0,2}}"
_BLOCK = 256
#: Standard deviations within which a random draw's statistics lie; weights of the three written-text scores.
TOLERANCE, SCORES = 4.0, (1.0, 1.0, 2.0)
#: Least number of joined tokens a style for the null, about; words of a token, in turn; words that are dealt together, about; how many times
#: that a task deals; what the deviation is multiplied by.
NULL_TOKENS, NULL_LENGTHS, NULL_HAND, NULL_TASK, NULL_SLACK = 1000, (4, 5, 6, 7, 8), 600, 64, 1.25
#: Words of the corpus: whole runs of letters, shorter than the tokens under test.
WORD = rf"(?<![A-Za-z0-9+/_-])[A-Za-z]{{1,{MIN_LENGTH - 1}}}(?![A-Za-z0-9+/_-])"
#: Written words that count beside the corpus', for small corpora, each VOCABULARY_WEIGHT times.
VOCABULARY = """the of and that report which public would government between council measures under after people their about water other first house again
 get set user name file path list item count index value key map table row column data type class object string number account detail details service request
 response client server error message event handler factory manager controller config option default create update delete remove insert find search load save open close
 read write parse format convert build send receive start stop init next previous current total max min size length time date session order customer product price invoice
 und die der den nicht mit auf eine werden durch arbeit zeit behoerde leistung verwaltung les des une pour dans avec nous travail temps maison el los una para con por
 como trabajo tiempo casa ciudad internal international change process information system version""".split()
VOCABULARY_WEIGHT = 4.0


def _running(sums: Column) -> Column:
    """Running sums of an array of longs: within blocks, after each block's offset."""

    def scan(values: Column, start: Column) -> Column:
        empty = F.array().cast("array<long>")
        return F.aggregate(values, F.struct(start.alias("at"), empty.alias("out")), lambda s, v: F.struct((s["at"] + v).alias("at"), F.array_append(s["out"], s["at"] + v).alias("out")))["out"]

    zero = F.lit(0).cast("long")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sums) - 1) / _BLOCK).cast("int")), lambda b: F.slice(sums, b * _BLOCK + 1, F.lit(_BLOCK)))

    def whole(parts: Column) -> Column:
        totals = F.transform(parts, lambda b: F.aggregate(b, zero, lambda s, v: s + v))
        return let(totals, lambda t: let(scan(t, zero), lambda upto: F.flatten(F.transform(parts, lambda b, i: scan(b, F.get(upto, i) - F.get(t, i))))))

    return let(blocks, whole)


def located(text: Column, pattern: str) -> Column:
    """array<struct<start long, end long, token string>> of all leftmost non-overlapping matches, in code points."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))

    def spans(p: Column) -> Column:
        widths = F.transform(p["found"], lambda m, i: (F.char_length(m) + F.char_length(F.get(p["between"], i))).cast("long"))
        place = lambda ends: F.transform(p["found"], lambda m, i: F.struct((F.get(ends, i) - F.char_length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("token")))
        return let(widths, lambda w: let(_running(w), place))

    return F.when(text.rlike(pattern), let(parts, spans)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,token:string>>"))


def _upper_tail(z: Column) -> Column:
    """P(N(0, 1) > z), to about 1e-7 (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / F.lit(2**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = series * F.exp(-x * x) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


# --- written text --------------------------------------------------------------------------------------

#: By size of the inferred alphabet: its letters, and the shares of its character classes in a random draw.
ENCODINGS = {16: (6, (10, 6)), 26: (26, (13, 13)), 32: (26, (26, 6)), 36: (26, (26, 10)), 52: (26, (26, 26)), 64: (26, (26, 26, 10))}


@dataclass(frozen=True)
class Written:
    """What letters do in written words: log-ratios of pairs, and what follows for each encoding."""

    ratio: tuple[float, ...]
    expected: dict[int, tuple[float, float, float, float]]  # share of equal characters, rate of class changes, mean and variance of a pair
    null: dict[int, tuple[float, float]] = field(default_factory=dict)  # mean and deviation of written tokens' scores

    @classmethod
    def of(cls, pairs: dict[str, float], word_length: float, spread: float) -> Written:
        """From weighted counts of letter pairs, the mean word length, and how much more than single pairs whole words vary."""
        counts = [[pairs.get(chr(97 + a) + chr(97 + b), 0.0) + 1 for b in range(26)] for a in range(26)]
        total = sum(map(sum, counts))
        p = [[c / total for c in row] for row in counts]
        first, second = [sum(row) for row in p], [sum(col) for col in zip(*p, strict=True)]
        ratio = [[math.log(x * 676) for x in row] for row in p]
        bound = 1 / max(word_length, 1.5)  # share of a joined token's pairs that lie across a word's end

        def expect(k: int) -> tuple[float, float, float, float]:
            letters, _ = ENCODINGS[k]
            inside = [(a, b) for a in range(letters) for b in range(letters)]
            mass, across = sum(p[a][b] for a, b in inside), sum(first[b] * second[a] for a, b in inside)
            moment = lambda power: sum(((1 - bound) * p[a][b] / mass + bound * first[b] * second[a] / across) * ratio[a][b] ** power for a, b in inside)
            mean, variance = moment(1), max(moment(2) - moment(1) ** 2, 0.01)
            share = sum(first[a] ** 2 for a in range(letters)) / sum(first[:letters]) ** 2
            if k >= 52:  # a word's first letter may be a capital
                share *= 1 - 2 * bound * (1 - bound)
            if k == 26:
                rate = sum(p[a][b] for a, b in inside if (a < 13) != (b < 13))
            else:
                rate = min(0.6, 2 * bound if k >= 52 else 2 / (word_length + 2))
            return max(share, 2 / k), rate, mean, variance * spread

        return cls(tuple(x for row in ratio for x in row), {k: expect(k) for k in ENCODINGS})


#: Least factor by which words vary more than their pairs, for words that the table has not seen.
_SPREAD = 1.5


def _vocabulary() -> tuple[Counter, float, float]:
    """Weighted pairs, letters and words of the built-in vocabulary."""
    pairs = Counter()
    for w in VOCABULARY:
        for a, b in zip(w, w[1:], strict=False):
            pairs[a + b] += VOCABULARY_WEIGHT
    return pairs, VOCABULARY_WEIGHT * sum(map(len, VOCABULARY)), VOCABULARY_WEIGHT * len(VOCABULARY)


def _built_in() -> Written:
    pairs, letters, words = _vocabulary()
    return Written.of(pairs, letters / words, _SPREAD)


def written_words(docs: DataFrame, text_col: str = "text") -> Written:
    """Written text as the corpus has it: every distinct word of all texts counts 1 + log2(its occurrences)."""
    words = docs.select(F.explode(F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0))).alias("w"))
    words = words.groupBy(F.lower("w").alias("w")).agg((1 + F.log2(F.count(F.lit(1)))).alias("n"))
    words = materialise(words, "words")
    pairs, letters, total = _vocabulary()
    found = words.filter(F.length("w") > 1).select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2)))).alias("p"))
    for r in found.groupBy("p").agg(F.sum("n").alias("n")).collect():  # at most 676 rows
        pairs[r["p"]] += r["n"]
    sums = words.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.length("w")).alias("letters")).first()
    length = (letters + (sums["letters"] or 0)) / (total + (sums["n"] or 0))
    plain = Written.of(pairs, length, 1.0)
    # How much whole words vary, in units of what independent pairs would give.
    _, _, mean, variance = plain.expected[26]
    codes = F.transform(F.split("w", "", -1), lambda c: F.ascii(c) - 97)
    off = let(_pair_sum(codes, plain), lambda s: F.pow(s["sum"] - s["n"] * mean, F.lit(2.0)))
    more = words.filter(F.length("w") > 1).agg((F.sum(F.col("n") * off) / F.sum(F.col("n") * (F.length("w") - 1) * variance)).alias("r")).first()["r"]
    written = Written.of(pairs, length, max(_SPREAD, more or 0.0))
    return replace(written, null=_null(written, words.filter(F.length("w") > 1).select("w")))


def joined_tokens(words: DataFrame) -> DataFrame:
    """words(w) and the vocabulary dealt into tokens: t, one a style from each four to eight words. Every word is in as many tokens as every other."""
    own = words.sparkSession.createDataFrame([(w,) for w in VOCABULARY], "w string")
    words = words.union(own).distinct()
    total = words.count()
    rounds = -(-NULL_TOKENS * sum(NULL_LENGTHS) // (len(NULL_LENGTHS) * total))
    hands = -(-total // NULL_HAND)
    dealt = words.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("h", F.xxhash64("w", "round"))
    dealt = dealt.withColumn("hand", F.pmod(F.xxhash64("w"), F.lit(hands)))
    dealt = dealt.repartition(-(-hands // NULL_TASK), "round", "hand").groupBy("round", "hand").agg(F.sort_array(F.collect_list(F.struct("h", "w"))).alias("ws"))
    turn = sum(NULL_LENGTHS)
    turns = F.sequence(F.lit(0), F.floor((F.size("ws") - 1) / turn).cast("int"))
    cuts = lambda i: F.array(*(F.slice("ws", i * turn + sum(NULL_LENGTHS[:c]) + 1, F.lit(n)) for c, n in enumerate(NULL_LENGTHS)))
    spans = F.flatten(F.transform(turns, cuts))
    parts = dealt.select(F.explode(F.filter(spans, lambda x: F.size(x) > 0)).alias("ws"))
    digit = lambda x: F.pmod(x["h"], F.lit(10)).cast("string")
    styles = (lambda x: x["w"], lambda x: F.concat(x["w"], digit(x)), lambda x: F.initcap(x["w"]), lambda x: F.concat(F.initcap(x["w"]), digit(x)))
    return parts.select(F.explode(F.array(*(F.array_join(F.transform("ws", f), "") for f in styles))).alias("t"))


def _null(written: Written, words: DataFrame) -> dict[int, tuple[float, float]]:
    """Mean (0 at least) and deviation of the scores of tokens joined from written words, by encoding. Tokens too short to be tested say nothing of those that are."""
    rows = joined_tokens(words).filter(F.char_length("t") >= MIN_LENGTH)
    scored = rows.select(let(_figures(F.col("t"), written), lambda f: F.struct(f["k"].alias("k"), _score(f, written).alias("s"))).alias("x"))
    found = {r["k"]: (max(r["m"], 0.0), NULL_SLACK * r["d"]) for r in scored.groupBy("x.k").agg(F.avg("x.s").alias("m"), F.stddev("x.s").alias("d")).collect() if r["d"]}
    return {k: found[k if k in found else 36] for k in ENCODINGS} if 36 in found else {}


def _pair_sum(codes: Column, written: Written) -> Column:
    """Sum of log-ratios and number n of the neighbouring letters; codes count from a, other characters lie outside 0-25."""
    table = F.array(*[F.lit(x) for x in written.ratio])  # folded to one constant
    letter = lambda c: (c >= 0) & (c < 26)
    pairs = F.zip_with(codes, F.slice(codes, F.lit(2), F.size(codes)), lambda a, b: F.when(letter(a) & letter(b), F.get(table, a * 26 + b)))
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    return F.aggregate(pairs, zero, lambda s, x: F.struct((s["sum"] + F.coalesce(x, F.lit(0.0))).alias("sum"), (s["n"] + x.isNotNull().cast("int")).alias("n")))


def battery(token: Column, written: Written | None = None) -> Column:
    """p-value of a token against the hypothesis that it was written, not drawn at random."""
    written = written or _built_in()
    return let(F.rtrim(token, F.lit("=")), lambda bare: let(_figures(bare, written), lambda f: _p_value(f, written)))


def _figures(bare: Column, written: Written) -> Column:
    n = F.char_length(bare).cast("double")
    k = (
        F.when(bare.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16)
        .when(bare.rlike("^([a-z]+|[A-Z]+)$"), 26)
        .when(bare.rlike("^[A-Z2-7]+$"), 32)
        .when(bare.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), 36)
        .when(bare.rlike("^[A-Za-z]+$"), 52)
        .otherwise(64)
    )
    chars = F.filter(F.split(bare, "", -1), lambda c: c != "")
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s + F.pow(n - F.char_length(F.replace(bare, c, F.lit(""))), F.lit(2.0)))
    # Classes, marks left out as they also join written words: each character's, so that its changes can be counted.
    low = F.lower(bare)
    classed = F.when(k == 26, F.translate(low, "abcdefghijklmnopqrstuvwxyz", "l" * 13 + "u" * 13)).otherwise(
        F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "[+/_-]+", ""), "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d")
    )
    runs = F.char_length(F.regexp_replace(classed, "(.)\\1+", "$1"))
    codes = F.transform(chars, lambda c: F.ascii(c).cast("double"))
    letters = F.transform(chars, lambda c: F.ascii(F.lower(c)) - 97)

    def moments(x: Column) -> Column:
        mean = F.aggregate(x, F.lit(0.0), lambda s, c: s + c) / F.size(x)

        def correlation(m: Column) -> Column:
            variance = F.aggregate(x, F.lit(0.0), lambda s, c: s + (c - m) * (c - m))
            lagged = F.aggregate(F.zip_with(x, F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: (a - m) * (b - m)), F.lit(0.0), lambda s, c: s + F.coalesce(c, F.lit(0.0)))
            return let(variance, lambda v: F.when(v > 0, F.abs(lagged / v)).otherwise(1.0))

        return let(mean, correlation)

    return F.struct(
        n.alias("n"),
        k.alias("k"),
        squares.alias("squares"),
        F.greatest(runs - 1, F.lit(0)).cast("double").alias("changes"),
        F.greatest(F.char_length(classed) - 1, F.lit(1)).cast("double").alias("places"),
        let(codes, moments).alias("serial"),
        let(letters, lambda x: _pair_sum(x, written)).alias("pairs"),
    )


def _by_encoding(k: Column, values: dict[int, float]) -> Column:
    out = None
    for size, value in values.items():
        out = (F if out is None else out).when(k == size, F.lit(float(value)))
    return out


def _drawn(f: Column) -> Column:
    """Whether the statistics are those of a draw: chi-squared has k - 1 degrees of freedom, classes change with the chance that two draws differ."""
    k, places = f["k"], f["places"]
    chi = k / f["n"] * f["squares"] - f["n"]
    draw = _by_encoding(k, {size: 1 - sum(c * c for c in classes) / sum(classes) ** 2 for size, (_, classes) in ENCODINGS.items()})
    return (
        ((chi - (k - 1)) / F.sqrt(2.0 * (k - 1)) <= TOLERANCE)
        & (F.abs(f["changes"] - places * draw) / F.sqrt(places * draw * (1 - draw)) <= TOLERANCE)
        & (f["serial"] * F.sqrt(f["n"]) <= TOLERANCE)
    )


def _score(f: Column, written: Written) -> Column:
    """Weighted mean of the normal scores against written text: expected sum of squared shares (with a spread for their clustering), runs, pairs."""
    n, k, places = f["n"], f["k"], f["places"]
    share, rate, mean, variance = (_by_encoding(k, {size: e[i] for size, e in written.expected.items()}) for i in range(4))
    spread = k / n * F.sqrt(1.44 * F.pow(n, F.lit(3.0)) * share * share + 2 * n * n * share)
    z_chi = (k * ((n - 1) * share + 1) - n - (k / n * f["squares"] - n)) / spread
    z_runs = (f["changes"] - places * rate) / F.sqrt(places * rate * (1 - rate))
    z_serial = F.when(f["pairs"]["n"] > 0, (f["pairs"]["n"] * mean - f["pairs"]["sum"]) / F.sqrt(f["pairs"]["n"] * variance)).otherwise(0.0)
    return (SCORES[0] * z_chi + SCORES[1] * z_runs + SCORES[2] * z_serial) / sum(SCORES)


def _p_value(f: Column, written: Written) -> Column:
    z = _score(f, written)
    if written.null:
        mean, deviation = (_by_encoding(f["k"], {size: e[i] for size, e in written.null.items()}) for i in (0, 1))
        z = (z - mean) / deviation
    return let(z, lambda z: F.when((f["n"] < 2) | ~_drawn(f), 1.0).otherwise(_upper_tail(z)))


def step_up_bars(histogram: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """histogram(size, bin, n) -> size, bar: Benjamini-Hochberg by length class. Bin b holds p-values of at most 10**(-b / 20), and counts with that."""
    upto = Window.partitionBy("size").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = histogram.withColumn("rank", F.sum("n").over(upto)).withColumn("m", F.sum("n").over(Window.partitionBy("size")))
    return ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / 20) * F.col("m") <= alpha * F.col("rank")).groupBy("size").agg(F.min("bin").alias("bar"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and all spans of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hits = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(located(text, p).alias(k) for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN), strict=True)))
    hits = materialise(hits, "located")
    written = written_words(docs, text_col)
    value = lambda s: F.regexp_extract(s["token"], f"^{ASSIGN}", 1)
    hits = hits.withColumn("assign", F.filter("assign", lambda s: F.char_length(value(s)) >= 6))

    def named(kind: str) -> Column:
        order = F.lit(KINDS.index(kind))
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), order.alias("kind"), s["end"].alias("end")))

    def tested(base: Column) -> Column:
        free = F.filter("random", lambda s: ~F.exists(base, lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))
        return F.transform(
            free,
            lambda s: F.struct(
                s["start"].alias("start"),
                s["end"].alias("end"),
                F.floor(F.log2(F.char_length(s["token"]))).cast("int").alias("size"),
                F.least(F.floor(-20 * F.log10(F.greatest(battery(s["token"], written), F.lit(1e-100)))), F.lit(2000)).cast("int").alias("bin"),
            ),
        )

    base = F.array_sort(F.concat(*(named(k) for k in KINDS[:3])))
    both = let(base, lambda b: F.struct(b.alias("base"), tested(b).alias("random")))
    hits = hits.select("doc_id", both.alias("both"), *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]))
    hits = materialise(hits.select("doc_id", "both.base", "both.random", *(f"n_{k}" for k in KINDS[:3])), "hits")

    # Benjamini-Hochberg by length class over the histogram; a bin counts with its largest p-value.
    histogram = hits.select(F.explode("random").alias("r")).groupBy("r.size", "r.bin").agg(F.count(F.lit(1)).alias("n"))
    bars = step_up_bars(histogram, alpha)
    bars = bars.agg(F.map_from_entries(F.collect_list(F.struct("size", "bar"))).alias("bars"))  # one row, one entry a power of two

    found = hits.crossJoin(F.broadcast(bars))
    chosen = F.filter("random", lambda s: s["bin"] >= F.coalesce(F.element_at("bars", s["size"]), F.lit(2001)))
    more = F.transform(chosen, lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end")))

    def joined(spans: Column) -> Column:
        name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id",
        *(f"n_{k}" for k in KINDS[:3]),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", more))).alias("spans"),
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op4's base spans, which SQL can say."""
    return op4_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


SECRET_BASE_SQL = r"""
SELECT doc_id, len(list_filter(regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda v: length(v) >= 6)) AS n_assign,
  len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 20)) AS n_access,
  len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda v: length(v) >= 24)) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
"""
