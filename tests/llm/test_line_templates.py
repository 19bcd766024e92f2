"""Line templates against a plain re-statement of the rule, on random corpora."""

import random
import re
from collections import defaultdict

from tributary.llm import line_dedup as lines


def drops_by_force(rows):
    """{doc_id: positions dropped} for rows (doc_id, text) with distinct ids."""
    wild = lambda t: lines.WILD if re.search("[0-9]", t) else t
    free = lambda n: n * (lines.CONSTANT[1] - lines.CONSTANT[0]) // lines.CONSTANT[1]
    leaves, wholes = defaultdict(list), defaultdict(set)
    for doc, text in rows:
        for pos, raw in enumerate((text or "").split("\n")):
            raw = raw.strip(" ")
            if not raw:
                continue
            tokens = [wild(t) for t in raw.split(" ")]
            n, sound = len(tokens), tokens.count(lines.WILD) <= free(len(tokens))
            if n >= lines.LONG_TOKENS and n - tokens.count(lines.WILD) >= lines.LEADING:
                wholes[tuple(tokens) if n >= lines.VERY_LONG_TOKENS and sound else (raw,)].add((doc, pos))
            if sound:
                leaves[(n, *(tokens if n < lines.MIN_TOKENS else tokens[: lines.LEADING]))].append((doc, pos, tuple(tokens)))
    gone = defaultdict(set)

    def drop(places):
        first = min(doc for doc, _ in places)
        for doc, pos in places:
            if doc != first:
                gone[doc].add(pos)

    for places in wholes.values():
        drop(places)
    for leaf in leaves.values():
        docs_of = defaultdict(set)
        for doc, _, tokens in leaf:
            docs_of[tokens].add(doc)
        at = defaultdict(int)
        for tokens, docs in docs_of.items():
            for i, t in enumerate(tokens):
                at[i, t] += len(docs)
        templates = defaultdict(set)
        for doc, pos, tokens in leaf:
            kept = tuple(i for i, t in enumerate(tokens) if t != lines.WILD and at[i, t] >= lines.MIN_DOCS)
            may = len(tokens) > lines.LEADING and free(len(tokens)) > 0 and len(tokens) - len(kept) <= free(len(tokens))
            templates[tuple((i, tokens[i]) for i in kept) if may else tokens].add((doc, pos))
        for places in templates.values():
            size = len(next(t for d, p, t in leaf if (d, p) in places))
            if len({doc for doc, _ in places}) >= (lines.SHORT_DOCS if size < lines.MIN_TOKENS else lines.MIN_DOCS):
                drop(places)
    return {doc: sorted(at) for doc, at in gone.items()}


def corpus(seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "CamelCaseName", "delta", "of", "ünd", "", "x\r", "tab\tword"]
    fields = [
        lambda: rng.choice(words),
        lambda: str(rng.randrange(100)),
        lambda: f"user{rng.randrange(30)}",
        lambda: rng.choice("anna bert carl dora emil".split()),
    ]
    forms = []
    for _ in range(12):  # lines with fixed words and a few fields; hot leaves share their leading tokens
        n = rng.choice([1, 2, 3, 4, 5, 6, 8, 9, 12, 20, 55])
        forms.append([rng.choice(words) if rng.random() < 0.85 else None for _ in range(n)])
    forms += [["error", "in", "module", None, "at", "line", None], ["error", "in", "module", "net", "at", "line", None], [None] * 3, [None] * 60]
    rows = []
    for i in range(40):
        text = []
        for _ in range(rng.randrange(8)):
            form = rng.choice(forms)
            text.append(" ".join(rng.choice(fields)() if t is None else t for t in form))
        rows.append((i, "\n".join(text)))
    return rows


def test_dropped_lines_match_brute_force(spark):
    for seed in range(6):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r["_id"]: sorted(r["_drop"]) for r in lines.line_drops(docs).collect()}
        want = drops_by_force(rows)
        assert want and got == want, seed


def test_rows_of_numbers_stay(spark, documents):
    rng = random.Random(1)
    table = lambda: "\n".join(f"{rng.randrange(99)} {rng.randrange(999)} {rng.random():.3f}" for _ in range(20))
    sheet = lambda: "\n".join(" ".join(str(rng.randrange(99)) for _ in range(60)) for _ in range(3))
    rows = [(i, f"{table()}\n{sheet()}\nrow {i} 7 8 9\n0 0 0\n{'0 ' * 12}1\nsum of {'0 ' * 60}") for i in range(10)]
    assert all(r["n_dropped"] == 0 for r in lines.dedup_lines(documents(*rows), report=True).collect())


def test_word_fields_are_generalised_in_short_lines_too(spark, documents):
    rows = [(i, f"alpha beta gamma delta {n} end of line\nown {n * 2}") for i, n in enumerate(["anna", "bert", "carl", "dora", "emil"])]
    assert sorted((r["doc_id"], r["n_dropped"]) for r in lines.dedup_lines(documents(*rows), report=True).collect()) == [(0, 0), (1, 1), (2, 1), (3, 1), (4, 1)]


def test_a_very_long_text_and_clashing_report_columns(spark, documents):
    shared = "these nine words stand in two of the documents"
    rows = [(1, f"{shared}\n" + "\n".join(f"line {chr(97 + i % 26)}{'q' * (i % 7)} of {'z' * (i % 11)} its own kind" for i in range(20_000))), (2, f"{'w ' * 300_000}\n{shared}")]
    out = {r["doc_id"]: (r["n_dropped"], r["n_lines"]) for r in lines.dedup_lines(documents(*rows), report=True).collect()}
    assert out[2] == (1, 2) and out[1][1] == 20_001
