"""Toxicity: cumulative-link (proportional-odds) ordinal regression on sparse text features.

Grades. Labels say toxic or not; a toxic text is graded 1 to GRADES by the evidence in it: the sum of the log-odds between the
classes of its telling features (odds of MIN_ODDS or more), each times log(1 + occurrences), at quantiles of the toxic sample. Odds are
cross-fitted: a text's evidence is weighed by what the other FOLDS - 1 folds of the sample say, never by itself (near copies share a fold). Grade 0 is clean.

Model. P(grade <= j) = sigmoid(theta_j - w.x) with one weight vector for all thresholds and
theta_0 < theta_1 < ... kept in order by their parametrisation. Features are words, and first PREFIX letters of
longer words, each as log(1 + occurrences). The vocabulary is all that the sample's classes differ in (log-odds of MIN_ODDS or more either way, and a G-test
of MIN_G or more). Fitting is full-batch Adam on the negative
log-likelihood with an L2 penalty.

The sample is bounded: at most SAMPLE labelled documents of each class, those with the smallest hash of
their id among the documents there are of at most SAMPLE_CHARS characters (these are drawn by ids and lengths alone, so no text moves but the sample's). It
goes to the driver; everything else is map-side: every whole text is scored where it lies, without a shuffle.

Output: expected severity sum(j * P(grade = j)), the chance of grade 1 or more, and toxic: severity at or
above the bar that has the best F1 on held-out texts: each fold is scored by a model of the others.

Defined results. Null and empty texts have no features and get the severity of an empty text. Labels
of unknown documents, and null labels, are left out; of labels that repeat an id the largest counts. Texts of any length are scored whole; equal texts
get equal severities. Further columns are kept by drop_toxic and not read by grade. Without labels of both classes nothing is toxic:
severity 0. Rows that repeat are answered each. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SAMPLE, SAMPLE_CHARS, FOLDS = 2000, 20_000, 3
GRADES, PREFIX, MIN_DOCS, MIN_ODDS, MIN_G = 3, 5, 5, 2.0, 20.0

_WORD = re.compile(r"[^\W\d_]+")


def counts(text: str | None) -> Counter:
    """Occurrences of words and of the first letters of longer words (marked by a trailing hyphen)."""
    words = Counter(_WORD.findall((text or "").lower()))
    for word, n in list(words.items()):
        if len(word) > PREFIX:
            words[f"{word[:PREFIX]}-"] += n
    return words


def copy_key(text: str | None) -> int:
    """Smallest hash of five-word shingles: equal for two texts with the chance of their shingles' similarity."""
    words = (text or "").lower().split()
    return min(xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Ordinal:
    """Weights by feature, and ascending thresholds."""

    def __init__(self, weights: dict[str, float], thresholds: list[float]):
        self.weights, self.thresholds, self.bar = weights, thresholds, float("inf")

    def score(self, text: str | None) -> tuple[float, float]:
        """Expected severity, and the chance of grade 1 or more."""
        return self.of(counts(text)) if self.thresholds else (0.0, 0.0)

    def of(self, features: Counter) -> tuple[float, float]:
        """The same from a text's features."""
        if not self.thresholds:
            return 0.0, 0.0
        weights, total = self.weights, 0.0
        for feature, n in features.items():
            w = weights.get(feature)
            if w is not None:
                total += w * np.log1p(n)
        above = _sigmoid(total - np.array(self.thresholds))  # P(grade > j)
        return float(above.sum()), float(above[0])


def _g_test(k1: int, n1: int, k0: int, n0: int) -> float:
    """Likelihood ratio statistic of the two shares k1/n1 and k0/n0; unlike a z-score it copes with zero counts."""
    total = 0.0
    for k, n in ((k1, n1), (k0, n0)):
        for have, want in ((k, n * (k1 + k0) / (n1 + n0)), (n - k, n * (n1 + n0 - k1 - k0) / (n1 + n0))):
            total += have * np.log(have / want) if have else 0.0
    return 2 * total


class _Sample:
    """Labelled texts as counts of features, with their folds."""

    def __init__(self, texts: list[str], toxic: list[int]):
        # Of texts with the same key (near copies, mostly) the first counts.
        once = {(copy_key(t), label): t for t, label in sorted(zip((t or "" for t in texts), toxic, strict=True), reverse=True)}
        keys = sorted(once)
        self.rows, self.y = [counts(once[k]) for k in keys], np.array([k[1] for k in keys], np.int64)
        self.fold = np.array([k[0] % FOLDS for k in keys], np.int64)

    def odds(self, chosen: np.ndarray) -> dict[str, float]:
        """Log-odds between the classes, within the chosen rows, of the features that tell them apart."""
        seen = (Counter(), Counter())
        for i in chosen:
            seen[self.y[i]].update(self.rows[i].keys())
        n1 = int(self.y[chosen].sum())
        n0, out = len(chosen) - n1, {}
        if not n1 or not n0:
            return out
        for f in set(seen[0]) | set(seen[1]):
            k1, k0 = seen[1][f], seen[0][f]
            if k1 + k0 >= MIN_DOCS:
                o = np.log((k1 + 0.5) / (n1 - k1 + 0.5)) - np.log((k0 + 0.5) / (n0 - k0 + 0.5))
                if abs(o) >= MIN_ODDS and _g_test(k1, n1, k0, n0) >= MIN_G:
                    out[f] = float(o)
        return out

    def grades(self, odds_without: list[dict[str, float]]) -> np.ndarray:
        """Grade of each row, its evidence weighed by the odds of the other folds."""
        amount = np.array([sum(o * np.log1p(n) for f, n in r.items() if (o := odds_without[k].get(f, 0.0)) >= MIN_ODDS) for r, k in zip(self.rows, self.fold, strict=True)])
        cuts = np.quantile(amount[self.y == 1], np.arange(1, GRADES) / GRADES)
        return np.where(self.y == 1, 1 + np.searchsorted(cuts, amount, side="right"), 0)


class _Ordinal:
    """Negative log-likelihood of the cumulative-link model on sparse rows, and its gradient."""

    def __init__(self, rows: list[Counter], grade: np.ndarray, features: list[str], l2: float):
        index = {f: i for i, f in enumerate(features)}
        at = [(i, index[f], np.log1p(n)) for i, r in enumerate(rows) for f, n in r.items() if f in index]
        self.row_of, self.column, self.value = (np.array(c) for c in zip(*at, strict=True)) if at else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        self.grade, self.n, self.width, self.l2 = grade, len(rows), len(features), l2

    @staticmethod
    def thresholds(a: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate(([a[0]], np.exp(a[1:]))))

    def gradient(self, w: np.ndarray, a: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, and its derivatives by the weights and by the thresholds' parameters."""
        theta, i = self.thresholds(a), np.arange(self.n)
        s = np.bincount(self.row_of, weights=w[self.column] * self.value, minlength=self.n)
        below = np.concatenate((np.zeros((self.n, 1)), _sigmoid(theta[None, :] - s[:, None]), np.ones((self.n, 1))), axis=1)
        hi, lo = below[i, self.grade + 1], below[i, self.grade]
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p / self.n, lo * (1 - lo) / p / self.n
        g_theta = np.zeros(GRADES + 2)
        np.add.at(g_theta, self.grade + 1, -d_hi)
        np.add.at(g_theta, self.grade, d_lo)
        g_a = np.cumsum(g_theta[1:-1][::-1])[::-1] * np.concatenate(([1.0], np.exp(a[1:])))
        decay = self.l2 / max(self.width, 1) ** 0.5
        g_w = np.bincount(self.column, weights=(d_hi - d_lo)[self.row_of] * self.value, minlength=self.width) + decay * w
        return float(-np.log(p).mean() + decay * (w @ w) / 2), g_w, g_a

    def solve(self, steps: int, rate: float) -> tuple[np.ndarray, list[float]]:
        params = [np.zeros(self.width), np.zeros(GRADES)]
        moments = [(np.zeros_like(x), np.zeros_like(x)) for x in params]
        for step in range(1, steps + 1):
            _, *slopes = self.gradient(*params)
            for x, g, (m, v) in zip(params, slopes, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return params[0], self.thresholds(params[1]).tolist()


def fit(texts: list[str], toxic: list[int], steps: int = 600, rate: float = 0.1, l2: float = 0.0002) -> Ordinal:
    """Fit on labelled texts. toxic: 0 or 1."""
    data = _Sample(texts, toxic)
    everything = np.arange(len(data.rows))
    if len(set(data.y.tolist())) < 2:
        return Ordinal({}, [])
    others = [everything[data.fold != k] for k in range(FOLDS)]
    odds_without = [data.odds(rows) for rows in others]
    grade = data.grades(odds_without)

    def model(chosen: np.ndarray, odds: dict[str, float]) -> Ordinal:
        features = sorted(odds)
        w, thresholds = _Ordinal([data.rows[i] for i in chosen], grade[chosen], features, l2).solve(steps, rate)
        return Ordinal({f: float(x) for f, x in zip(features, w, strict=True) if abs(x) > 1e-4}, thresholds)

    severity = np.zeros(len(data.rows))
    for k, (rows, odds) in enumerate(zip(others, odds_without, strict=True)):
        held_out = everything[data.fold == k]
        if len(held_out):
            part = model(rows, odds) if len(set(data.y[rows].tolist())) == 2 else Ordinal({}, [])
            severity[held_out] = [part.of(data.rows[i])[0] for i in held_out]
    whole = model(everything, data.odds(everything))
    whole.bar = _best_bar(severity, data.y)
    return whole


def _best_bar(severity: np.ndarray, y: np.ndarray) -> float:
    """The severity from which on a text counts as toxic: the middle of the gap with the best F1."""
    order = np.argsort(-severity, kind="stable")
    s, hits = severity[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # a cut between equal scores is none
    at = int(np.argmax(f1))
    return float((s[at] + s[at + 1]) / 2) if at + 1 < len(s) else float(s[at])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """Fit on the bounded sample of labelled documents."""
    known = labels.select(F.col("doc_id").cast("long").alias("_label_id"), F.col("toxic").cast("int").alias("_toxic")).filter("_toxic in (0, 1)")
    known = known.groupBy("_label_id").agg(F.max("_toxic").alias("_toxic"))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).filter(F.char_length("_text") <= SAMPLE_CHARS)
    # Ids are drawn among labelled documents that there are; then a bounded table of ids is broadcast to fetch their texts.
    there = known.join(rows.select(F.col("_id").alias("_label_id")), "_label_id", "left_semi").withColumn("_hash", F.xxhash64("_label_id"))
    drawn = [there.filter(F.col("_toxic") == c).orderBy("_hash", "_label_id").limit(SAMPLE) for c in (0, 1)]
    found = rows.join(F.broadcast(drawn[0].unionByName(drawn[1])), F.col("_id") == F.col("_label_id"))
    parts = [found.filter(F.col("_toxic") == c).orderBy("_hash", "_text").limit(SAMPLE) for c in (0, 1)]
    sample = parts[0].unionByName(parts[1]).select("_text", "_toxic").collect()  # at most 2 * SAMPLE * SAMPLE_CHARS characters
    return fit([r["_text"] for r in sample], [r["_toxic"] for r in sample])


def _scorer(model: Ordinal):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            columns = [*batch.columns[:-1], pa.array([s for s, _ in scores], pa.float64()), pa.array([p for _, p in scores], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "severity", "p_toxic"])

    return score


def grade(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity, p_toxic, toxic for each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(_scorer(model), "doc_id long, severity double, p_toxic double").withColumn("toxic", F.col("severity") >= F.lit(model.bar))


def drop_toxic(docs: DataFrame, model: Ordinal, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text the model does not call toxic, with all their columns."""
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                yield part.filter(pa.array([model.score(t.as_py())[0] < model.bar for t in part.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return grade(docs, train(docs, table(spark, sf_dir, "labels")))
