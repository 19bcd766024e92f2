"""Personal data: exact base patterns, and a linear-chain CRF over word shapes that adds what they miss.

Base kinds (leftmost, non-overlapping per kind, matches that fail their test dropped without a retry):
email, ip, card (Luhn), phone. The scanners below are linear in the text, also on runs of one character.

The CRF tags tokens of number groups: runs of digits and of the marks between them. Its features are
token shapes (digit-run length or the mark), their neighbours' shapes, the size of the group, whether it opens with a zero, and the
two words before it. Weights come from labelled_table(), a small table of labelled sentences, by maximum
likelihood (forward-backward, full-batch Adam) in a few seconds. Decoding is Viterbi in numpy, over batches of
groups padded to a common length. A text's groups are separate chains, each with its own start: text between them, and groups with fewer than MIN_DIGITS
digits, belong to no chain. A group is decoded whole, however long (about 100 bytes of memory a token of it). A decoded span is kept
if its number of digits lies in the limits of its kind, DIGITS.

Spans the CRF adds: phone numbers without a plus sign, card-like numbers whether or not they pass Luhn, dotted quads
in other writings and national identity numbers (kind id). A span that touches a base span is dropped,
so base spans stay as they are.

Defined results. Null and empty texts have no spans: counts 0, base_sha256 of the empty string, spans ''.
Texts of any length are read whole. Rows that repeat are answered each. Further columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone", "id")
MIN_DIGITS = 7
#: Padded tokens that are decoded in one numpy batch (a longer group is a batch of its own), and tokens whose features are looked up at once.
BATCH_TOKENS, LOOKUP = 16_384, 4096
#: Digits that a span of each kind has.
DIGITS = {"phone": (7, 15), "card": (13, 19), "ip": (4, 12), "id": (9, 9)}

Span = tuple[int, int, str]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            done = found.end()
            yield start, done, "email"
            at = text.find("@", done)
        else:  # this local part cannot be used again: an address has one @
            done = at + 1
            at = text.find("@", done)


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.start(), m.end(), "card"


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then kind as listed."""
    spans = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        spans += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        spans += _cards(text)
        if "+" in text:
            spans += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdecimal, m.group())) <= 15]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


# --- the CRF -------------------------------------------------------------------------------------------

TAGS = ("O", *(f"{p}-{k}" for k in ("phone", "card", "ip", "id") for p in "BI"))
_GROUP = re.compile(r"[0-9(+][0-9().+/:\- ]*+")
_TOKEN = re.compile(r"[0-9]+|[^0-9]")
def groups(text: str) -> list[tuple[int, str]]:
    """(start, text) of the number groups with MIN_DIGITS digits or more, ending in their last digit or bracket."""
    out = []
    for m in _GROUP.finditer(text):
        part = m.group().rstrip(" .:/-+(")
        if len(part) >= MIN_DIGITS and sum(map(str.isdecimal, part)) >= MIN_DIGITS:
            out.append((m.start(), part))
    return out


def _shape(token: str) -> str:
    return f"d{min(len(token), 13) if len(token) < 7 or len(token) > 12 else 7 + (len(token) - 7) // 2}" if token[0].isdigit() else token


def features(tokens: list[str], before: str, lo: int = 0, hi: int | None = None) -> list[list[str]]:
    """Features of the tokens from lo to hi of a group."""
    hi = len(tokens) if hi is None else hi
    edge = ["^^", "^"][lo:]
    shapes = [*edge, *(_shape(t) for t in tokens[max(0, lo - 2) : hi + 2]), "$", "$$"]
    digits = sum(len(t) for t in tokens if t[0].isdigit())
    first = next((t for t in tokens if t[0].isdigit()), "")
    size, zero = f"n{min(digits, 20)}", f"z{first[:1] == '0'}"
    *_, farther, word = ["", "", *before.split()]
    out = []
    for i in range(hi - lo):
        a, b, c, d, e = shapes[i : i + 5]
        out.append(["bias", f"s={c}", f"p={b}", f"q={d}", f"pc={b}|{c}", f"cq={c}|{d}", f"pcq={b}|{c}|{d}", f"aa={a}|{b}", f"ee={d}|{e}", f"{size}|{c}", f"{zero}|{size}|{c}", f"w={word}", f"v={farther}", f"first={lo + i == 0}", f"w={word}|{c}", f"w={word}|{size}", f"v={farther}|{c}", f"v={farther}|{size}"])
    return out


def labelled_table() -> list[tuple[str, list[Span]]]:
    """The training table: sentences and the spans of their number groups, in four languages, made by rule."""
    rng = np.random.default_rng(7)
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    forms = {
        "phone": ["(###) ###-####", "###-###-####", "###.###.####", "### ### ####", "0## ### ####", "0##/#######", "0### #######", "0## #### ####", "0# ## ## ## ##", "0#.##.##.##.##", "0##-########", "+## ### ### ###", "+1 (###) ###-####", "###-####"],
        "card": ["#### #### #### ####", "####-####-####-####", "4###############", "#### ###### #####"],
        "ip": [""],
        "id": ["###-##-####", "### ## ####"],
        "": ["20##-##-##", "##/##/20##", "##.##.20##", "20##-##-## ##:##:##", "#######", "########", "##########", "### ### ###", "#.#########", "#### - ####", "## ## ## ## ## ## ## ## ##", "#" * 20, "#" * 24, "###.###.###", "(####) ####", "978-#-##-######-#", "978-#-###-#####-#", "#-###-#####-#", "####-####", "##,###.##"],
        "-": ["###-###-####", "###-##-####", "### ### ####", "##-###-####"],  # of articles: only the word before tells
    }
    words = {
        "phone": ["call", "phone", "tel", "mobile", "cell", "ring", "llame", "telefon", "appelez", "fax", "handy", "reach", "dial", "at", "und", "de"],
        "card": ["card", "visa", "karte", "tarjeta", "carte", "paid", "at", "und", "de"],
        "ip": ["host", "server", "ip", "address", "at", "und", "de"],
        "id": ["ssn", "social", "insurance", "security", "id", "at", "und", "de"],
        "": ["on", "dated", "order", "version", "total", "page", "am", "el", "le", "und", "de", "isbn", "invoice", "at", "the", "since"],
        "-": ["part", "isbn", "sku", "item", "article", "model", "serial", "invoice", "order", "artikel", "pieza"],
    }

    def write(form: str) -> str:
        return "".join(num(1) if c == "#" else c for c in form) or ".".join(str(x) for x in rng.integers(10, 255, 4))

    rows = []
    for kind, written in forms.items():
        for form in written:
            if form == "###-####" and kind:  # too short to stand without its word
                known = [w for w in words[kind] if w not in ("at", "und", "de")]
            else:
                known = words[kind]
            for i in range(4 * len(known) if kind == "-" else 2 * len(known) if kind else 28):
                word = known[i % len(known)]
                value = write(form)
                heads = (f"we see {word}: ", f"the {word} ", f"his {word} is ", f"{word} number ", f"a {word} no. ", f"{word} at ", f"{word} le ")
                head = heads[i % len(heads)]
                text = f"{head}{value}{' and then' if i % 2 else '.'}"
                rows.append((text, [(len(head), len(head) + len(value), kind)] if kind in KINDS else []))
    return rows


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class _Training:
    """Labelled chains, and the gradient of their log-likelihood by forward-backward."""

    def __init__(self, rows: list[list[list[str]]], tags: list[list[int]], tag_count: int):
        self.vocabulary: dict[str, int] = {}
        for row in rows:
            for names in row:
                for name in names:
                    self.vocabulary.setdefault(name, len(self.vocabulary))
        k = self.k = tag_count
        self.shape = ((len(self.vocabulary) + 1, k), (k + 1, k))  # the last row of emit is of unknown features, that of trans starts a chain
        n, width = len(rows), max(map(len, rows))
        self.live = np.arange(width)[None, :] < np.array([len(r) for r in rows])[:, None]
        names = [f for row in rows for f in row]  # of the live tokens, row by row
        self.ids = np.full((len(names), max(map(len, names))), len(self.vocabulary), np.int64)
        for i, f in enumerate(names):
            self.ids[i, : len(f)] = [self.vocabulary[x] for x in f]
        gold = np.zeros((n, width), np.int64)
        for i, row in enumerate(tags):
            gold[i, : len(row)] = row
        order = np.argsort(self.ids.ravel(), kind="stable")
        self.present, self.begin = np.unique(self.ids.ravel()[order], return_index=True)
        self.token = np.repeat(np.arange(len(names)), self.ids.shape[1])[order]
        self.want_e = self._by_feature(np.eye(k)[gold[self.live]])
        self.want_t = np.zeros(self.shape[1])
        np.add.at(self.want_t, (np.full(n, k), gold[:, 0]), 1)
        inner = self.live[:, 1:]
        np.add.at(self.want_t, (gold[:, :-1][inner], gold[:, 1:][inner]), 1)

    def _by_feature(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape[0])
        out[self.present] = np.add.reduceat(weights[self.token], self.begin, axis=0)
        return out

    def gradient(self, emit: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood, and its derivatives by emit and trans."""
        live, k = self.live, self.k
        n, width = live.shape
        s = np.zeros((n, width, k))
        s[live] = emit[self.ids].sum(axis=1)
        alpha = np.zeros((n, width, k))
        alpha[:, 0] = s[:, 0] + trans[k]
        for t in range(1, width):
            new = _lse(alpha[:, t - 1, :, None] + trans[None, :k], 1) + s[:, t]
            alpha[:, t] = np.where(live[:, t, None], new, alpha[:, t - 1])
        beta = np.zeros((n, width, k))
        for t in range(width - 2, -1, -1):
            new = _lse(trans[None, :k] + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(live[:, t + 1, None], new, 0.0)
        z = _lse(alpha[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
        have_e, have_t = self._by_feature(node[live]), np.zeros(self.shape[1])
        have_t[k] = node[:, 0].sum(axis=0)
        pair = np.exp(alpha[:, :-1, :, None] + trans[None, None, :k] + (s + beta)[:, 1:, None, :] - z[:, None, None, None])
        have_t[:k] = (pair * live[:, 1:, None, None]).sum(axis=(0, 1))
        value = float((self.want_e * emit).sum() + (self.want_t * trans).sum() - z.sum())
        return value, self.want_e - have_e, self.want_t - have_t


class Crf:
    """Linear-chain conditional random field with string features."""

    def __init__(self, vocabulary: dict[str, int], emit: np.ndarray, trans: np.ndarray):
        self.vocabulary, self.emit, self.trans = vocabulary, emit, trans

    def scores(self, tokens: list[str], before: str) -> np.ndarray:
        """Emission scores (tokens, tags) of a group; features are looked up a block of tokens at a time."""
        unknown, out = len(self.vocabulary), np.empty((len(tokens), self.emit.shape[1]))
        for lo in range(0, len(tokens), LOOKUP):
            hi = min(len(tokens), lo + LOOKUP)
            ids = [[self.vocabulary.get(name, unknown) for name in names] for names in features(tokens, before, lo, hi)]
            out[lo:hi] = self.emit[np.array(ids, np.int64)].sum(axis=1)
        return out

    def viterbi(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of each group, from its emission scores. Ties go to the lower tag number."""
        if not scores:
            return []
        lengths = np.array([len(s) for s in scores])
        n, width, tags = len(scores), int(lengths.max()), self.emit.shape[1]
        emit = np.zeros((n, width, tags))
        for i, s in enumerate(scores):
            emit[i, : len(s)] = s
        best, back = emit[:, 0] + self.trans[-1], np.zeros((n, width, tags), np.int8)
        for t in range(1, width):
            step = best[:, :, None] + self.trans[None, :-1]
            back[:, t] = step.argmax(axis=1)
            new = step.max(axis=1) + emit[:, t]
            best = np.where((t < lengths)[:, None], new, best)
        at = best.argmax(axis=1)
        out = np.zeros((n, width), np.int8)
        for t in range(width - 1, -1, -1):
            live = t < lengths
            out[live, t] = at[live]
            at = np.where(live, back[np.arange(n), t, at], at)
        return [row[:k] for row, k in zip(out, lengths, strict=True)]

    @classmethod
    def train(cls, rows: list[list[list[str]]], tags: list[list[int]], steps: int = 80, rate: float = 0.2, l2: float = 0.02) -> Crf:
        data = _Training(rows, tags, len(TAGS))
        weights = [np.zeros(data.shape[0]), np.zeros(data.shape[1])]
        moments = [(np.zeros_like(x), np.zeros_like(x)) for x in weights]
        for step in range(1, steps + 1):
            _, *slopes = data.gradient(*weights)
            for x, slope, (m, v) in zip(weights, slopes, moments, strict=True):
                grad = (l2 * x - slope) / len(rows)
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            weights[0][-1] = 0
        return cls(data.vocabulary, *weights)


def _word_before(text: str, start: int) -> tuple[int, str]:
    """Start of the word that ends at most three marks or spaces before start, and the word."""
    end = start
    while end > max(0, start - 3) and not (text[end - 1].isalnum() or text[end - 1] == "_"):
        end -= 1
    begin = end
    while begin and text[begin - 1].isalpha():
        begin -= 1
    return begin, text[begin:end].lower()


def _before(text: str, start: int) -> str:
    """The two words before start, the farther one first."""
    begin, word = _word_before(text, start)
    return f"{_word_before(text, begin)[1]} {word}" if word else ""


@lru_cache(maxsize=1)
def model() -> Crf:
    rows, tags = [], []
    for text, spans in labelled_table():
        for start, part in groups(text):
            tokens = _TOKEN.findall(part)
            row, at = [], start
            for token in tokens:
                kind, first = next(((k, at == a) for a, b, k in spans if a <= at < b), ("", False))
                row.append(TAGS.index(f"{'B' if first else 'I'}-{kind}") if kind else 0)
                at += len(token)
            rows.append(features(tokens, _before(text, start)))
            tags.append(row)
    return Crf.train(rows, tags)


def _batches(work: list[tuple[int, int, list[str]]]) -> Iterator[list[tuple[int, int, list[str]]]]:
    """Groups of like lengths, at most BATCH_TOKENS padded tokens together."""
    batch: list[tuple[int, int, list[str]]] = []
    for item in sorted(work, key=lambda w: len(w[2])):
        if batch and (len(batch) + 1) * len(item[2]) > BATCH_TOKENS:
            yield batch
            batch = []
        batch.append(item)
    if batch:
        yield batch


def _decoded(text: str, start: int, tokens: list[str], tags: list[int]) -> Iterator[Span]:
    """Spans of a tagged group, ending in their last token that is no space."""
    at, kind, begun, end = start, "", 0, 0
    for token, tag in [*zip(tokens, tags, strict=True), ("", 0)]:
        name = TAGS[tag]
        if kind and name != f"I-{kind}":
            if DIGITS[kind][0] <= sum(map(str.isdecimal, text[begun:end])) <= DIGITS[kind][1]:
                yield begun, end, kind
            kind = ""
        if name[0] == "B":
            kind, begun = name[2:], at
        at += len(token)
        if kind and token.strip():
            end = at


def crf_spans(texts: list[str], crf: Crf) -> list[list[Span]]:
    """Spans that the CRF finds in each text."""
    work = [(i, start, _TOKEN.findall(part)) for i, text in enumerate(texts) if _DIGIT.search(text) for start, part in groups(text)]
    out: list[list[Span]] = [[] for _ in texts]
    for batch in _batches(work):
        tagged = crf.viterbi([crf.scores(tokens, _before(texts[i], start)) for i, start, tokens in batch])
        for (i, start, tokens), tags in zip(batch, tagged, strict=True):
            out[i] += _decoded(texts[i], start, tokens, tags.tolist())
    return [sorted(spans) for spans in out]


def _joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _scanner(crf: Crf):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                counts, digests, found = [], [], []
                for text, more in zip(texts, crf_spans(texts, crf), strict=True):
                    base = base_spans(text)
                    extra = [s for s in more if not any(s[0] < b[1] and b[0] < s[1] for b in base)]
                    kinds = [k for _, _, k in base]
                    counts.append([kinds.count(k) for k in KINDS[:4]])
                    digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    found.append(_joined(sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2])))))
                columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array(digests, pa.string()), pa.array(found, pa.string())], SCHEMA.replace(" long", "").replace(" string", "").split(", "))

    return scan


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts, base_sha256 and all spans of each row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scanner(model()), SCHEMA)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op1's base spans, which SQL can say."""
    return op1_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


PII_BASE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
  regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ips,
  list_transform(regexp_extract_all(text, '[0-9]([ -]?[0-9])+'), lambda c: regexp_replace(c, '[ -]', '', 'g')) AS cards,
  regexp_extract_all(text, '\+[0-9][ ().0-9-]+[0-9]') AS phones FROM t)
SELECT doc_id, n_email,
  len(list_filter(ips, lambda a: len(list_filter(string_split(a, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || left(ltrim(p, '0'), 3) AS INTEGER) > 255)) = 0)) AS n_ip,
  len(list_filter(cards, lambda c: length(c) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(c) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(c[length(c) + 1 - i] AS INTEGER)
    WHEN CAST(c[length(c) + 1 - i] AS INTEGER) > 4 THEN 2 * CAST(c[length(c) + 1 - i] AS INTEGER) - 9 ELSE 2 * CAST(c[length(c) + 1 - i] AS INTEGER) END)) % 10 = 0)) AS n_card,
  len(list_filter(phones, lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 10 AND 15)) AS n_phone
FROM m
"""
