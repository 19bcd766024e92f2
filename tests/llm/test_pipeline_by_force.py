"""The pipeline against a plain re-statement of its stages, on a small corpus with odd rows."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tributary.llm import line_dedup, pack, simhash_dedup, source_mix, toxicity

from .test_line_templates import drops_by_force
from .test_mix_and_pack import targets_by_force

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('lnrst')}"
    shared = [" ".join(word() for _ in range(12)) for _ in range(3)]
    rows, labels = [], []
    for i in range(150):
        text = "\n".join(" ".join(word() for _ in range(rng.randrange(8, 40))) for _ in range(rng.randrange(1, 4)))
        toxic = i % 4 == 0
        if toxic:
            text += " " + " ".join(rng.choices(["vilest", "rotten", "nasty"], k=rng.randrange(3, 9)))
        if i % 5 == 1:
            text += "\n" + shared[i % 3]
        if i % 30 == 2:
            text = rows[1][1] + f" {word()}"
        rows.append((i, text, ["web", "books", None, "mail"][rng.randrange(4)]))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    rows += [(900, None, "web"), (901, "", "books"), (902, "long " * 3000, "mail"), (7, rows[7][1], rows[7][2])]
    return rows, labels


def links_by_force(texts):
    """Groups of places by the stage's links."""
    prints = [simhash_dedup.fingerprint(t, simhash_dedup.WIDE_SHINGLE, more=simhash_dedup.WIDE_WORDS - 1) for t in texts]
    parts = [64 * w + simhash_dedup.WIDE_SEGMENT * s for w in (0, 1) for s in range(3)]
    group = list(range(len(texts)))
    for i, x in enumerate(prints):
        for j in range(i):
            d = x ^ prints[j]
            meet = min((d >> a & ((1 << simhash_dedup.WIDE_SEGMENT) - 1)).bit_count() for a in parts) <= 1
            if meet and d.bit_count() <= simhash_dedup.WIDE_DISTANCE and (d & (2**128 - 1)).bit_count() <= simhash_dedup.MEETING:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = corpus(3)
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, _id string")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_every_stage_by_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    pairs = lambda df: sorted(((r["doc_id"], r["text"], r["source"]) for r in df.collect()), key=repr)
    stages = dict(corpus_pipeline.STAGES)

    rows = pairs(docs)
    kept = stages["toxicity"](spark, docs, folder).persist()
    want = [r for r in rows if model.score(r[1])[0] < model.bar]
    assert pairs(kept) == want and 0 < len(want) < len(rows) and kept.columns == columns

    lines = stages["line_dedup"](spark, kept, folder).persist()
    gone = drops_by_force(sorted({(i, t) for i, t, _ in want if t is not None}))
    clean = [(i, t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get(i, ())), s) for i, t, s in want]
    assert pairs(lines) == sorted(clean, key=repr) and gone and lines.columns == columns
    assert lines.filter(F.col("n_chars") != F.char_length("text")).count() == 0

    single = stages["simhash_dedup"](spark, lines, folder).persist()
    clean.sort(key=lambda r: r[0])
    group = links_by_force([t for _, t, _ in clean])
    first = {}
    for r, g in zip(clean, group, strict=True):
        first.setdefault(g, r)
    assert pairs(single) == sorted(first.values(), key=repr) and len(first) < len(clean) and single.columns == columns

    mixed = stages["source_mix"](spark, single, folder).persist()
    sizes, taken = Counter(), defaultdict(int)
    for _, t, s in first.values():
        sizes[s] += len((t or "").split())
    want_targets = targets_by_force(sizes)
    for _, t, s in pairs(mixed):
        taken[s] += len((t or "").split())
    largest = max(len((t or "").split()) for _, t, _ in first.values())
    assert all(abs(taken[s] - want_targets[s]) <= largest for s in sizes) and mixed.columns == columns
    assert max(Counter(i for i, _, _ in pairs(mixed)).values()) <= source_mix.CAP

    packed = [r.asDict() for r in stages["best_fit_pack"](spark, mixed, folder).collect()]
    ids = pack._ids(pack._tokenizer_path(None))
    tokens = Counter()
    for i, t, _ in pairs(mixed):
        tokens[i] += len(ids.encode(t or "")) // 4 + 1
    got, sequences = Counter(), defaultdict(list)
    for r in packed:
        got[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == tokens
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= pack.CAPACITY
    assert len(sequences) == sum(c for _, c in pack.complete_bins(Counter(r["length"] for r in packed)))


def test_run_gives_the_stages_result_again(spark, folder):
    rows = lambda df: sorted(map(repr, df.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert rows(corpus_pipeline.run(spark, folder)) == rows(corpus_pipeline.run(spark, folder))


def test_empty_tables_pass_through(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert line_dedup.line_drops(spark.read.parquet(f"{tmp_path}/documents.parquet")).count() == 0
