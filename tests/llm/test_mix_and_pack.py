import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tributary.llm import pack as packing
from tributary.llm import source_mix as mixing


def targets_by_force(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        share = {s: rest * weight[s] / w for s in names if s not in capped}
        over = {s for s, t in share.items() if t > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


def test_targets_and_taken(spark, documents):
    rng = random.Random(1)
    sources = ["b", "a", "Z", "é", None, "tiny", "\U0001f600"]
    rows = [(i, "w " * rng.randrange(0, 30), rng.choice(sources[:5] * 6 + sources)) for i in range(1500)] + [(5000, None, "a"), (None, "x y", "b")]
    docs = documents(*rows).selectExpr("doc_id", "source", "size(regexp_extract_all(coalesce(text, ''), '[^ ]+', 0)) AS size")
    docs = docs.withColumn("size", docs["size"].cast("long"))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall("[^ ]+", t or ""))
    out = mixing.mix_sources(docs).collect()
    want = targets_by_force(sizes)
    taken = Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    assert len(out) == len(rows) and all(abs(taken[s] - want[s]) <= 30 for s in sizes)
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix_sources(docs.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in out}


def test_stage_repeats_rows_and_handles_empty(spark, documents):
    docs = documents((1, "a b c", "x"), (2, "d e", "y"), (2, "d e", "y"), (3, None, None), (4, "f " * 40, "y"))
    kept = mixing.take_mix(docs)
    assert kept.columns == docs.columns
    per = Counter(r["doc_id"] for r in kept.collect())
    assert per[1] == 3  # x weighs 5 and cannot reach its share: three times its size
    assert mixing.take_mix(documents()).count() == 0 and mixing.take_mix(documents((1, None, "a"))).count() == 0


def bins_by_force(items, capacity):
    items = sorted(items, reverse=True)

    def fit(i, room):
        if i == len(items):
            return True
        for j in range(len(room)):
            if room[j] >= items[i] and room[j] not in room[:j]:
                room[j] -= items[i]
                if fit(i + 1, room):
                    return True
                room[j] += items[i]
        return False

    k = 0
    while not fit(0, [capacity] * k):
        k += 1
    return k


def test_bin_completion_is_optimal_on_small_instances():
    rng = random.Random(3)
    for _ in range(200):
        histogram = Counter(rng.randint(1, 20) for _ in range(rng.randint(0, 9)))
        solution = packing.complete_bins(histogram, 20)
        used = Counter()
        for filling, copies in solution:
            assert sum(filling) <= 20
            for k in filling:
                used[k] += copies
        assert used == histogram and sum(c for _, c in solution) == bins_by_force(histogram.elements(), 20)


def test_bin_completion_near_the_bound_on_large_histograms():
    rng = random.Random(4)
    histogram = Counter(min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    solution = packing.complete_bins({k: 50 * n for k, n in histogram.items()})
    assert sum(c for _, c in solution) <= 1.01 * packing.lower_bound({k: 50 * n for k, n in histogram.items()}, 2048)


def test_dominance():
    assert packing.dominates((5,), (3, 2)) and packing.dominates((4, 3), (4, 2)) and not packing.dominates((3, 3), (5,))


def test_ids_are_the_tokenizers():
    ids, rng = packing.Ids(packing._tokenizer_path(None)), random.Random(3)
    alphabet = "aZ é'tsrevmld\t\n 12²½\x85\xa0·ª.,<|>€\x1c"
    for _ in range(2000):
        text = "".join(rng.choice(alphabet) for _ in range(30))
        assert ids.encode(text) == ids.whole(text), repr(text)
    for text in ("", "a  ", "<|endoftext|> x", "it's  we'll", "x" * 5000, " " * 5000):
        assert ids.encode(text) == ids.whole(text)


def test_pieces_are_placed_gapless(spark, documents):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "b", "gamma delta"]) for _ in range(rng.choice([1, 5, 40, 300])))) for i in range(60)]
    rows += [(60, None), (61, ""), (61, ""), (62, "z " * 9000), (None, "q")]
    out = packing.pack(documents(*rows), capacity=256).collect()
    ids = packing.Ids(packing._tokenizer_path(None))
    by_sequence, pieces = {}, {}
    for r in out:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append(r)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    long = sorted(pieces[62], key=lambda r: r["piece"])
    data = np.frombuffer(ids.encode("z " * 9000) + bytes(4), "<u4")
    assert [r["length"] for r in long[1:]] == [256] * (len(long) - 1) and sum(r["length"] for r in long) == len(data)
    assert all(r["ids_crc32"] == zlib.crc32(data[r["start"] : r["start"] + r["length"]].tobytes()) for r in long)
    assert [r["length"] for r in pieces[60]] == [1] and len(pieces[61]) == 2
    assert packing.pack(documents()).count() == 0


def fewest_sequences(items, capacity):
    """By dynamic programming over subsets: (sequences, filled part of the last) of the best order."""
    best = [(0, capacity)] + [None] * ((1 << len(items)) - 1)
    for mask in range(1, 1 << len(items)):
        found = []
        for i, k in enumerate(items):
            if mask >> i & 1:
                n, used = best[mask ^ (1 << i)]
                found.append((n, used + k) if used + k <= capacity else (n + 1, k))
        best[mask] = min(found)
    return best[-1][0]


def test_bin_completion_is_optimal_on_many_small_cases():
    rng = random.Random(30)
    for case in range(2000):
        capacity = rng.choice([10, 30, 100, 1000])
        low, high = rng.choice([(0.05, 0.5), (0.15, 0.4), (0.02, 1.0)])
        items = [max(1, rng.randint(int(low * capacity), int(high * capacity))) for _ in range(rng.randint(0, 9))]
        solution = packing.complete_bins(Counter(items), capacity)
        assert sum(c for _, c in solution) == fewest_sequences(items, capacity), (case, capacity, items)
        assert packing.lower_bound(Counter(items), capacity) <= fewest_sequences(items, capacity)


def test_bin_completion_finds_what_greedy_fillings_miss():
    items = [159, 160, 167, 172, 183, 188, 218, 235, 243, 246, 255, 302, 393]
    assert sum(c for _, c in packing.complete_bins(Counter(items), 1000)) == 3


def test_fillings_are_complete_and_ordered():
    rng = random.Random(31)
    for _ in range(200):
        counts, room = [0] * 25, rng.randint(0, 24)
        for _ in range(rng.randint(0, 8)):
            counts[rng.randint(1, 24)] += 1
        lengths = [k for k, n in enumerate(counts) if n]
        got = [(w, f) for w, f in packing.fillings(lengths, counts, room) if f is not None]
        every = {()}
        for k in lengths:
            every |= {tuple(sorted((*f, *[k] * n), reverse=True)) for f in every for n in range(counts[k] + 1)}
        maximal = {f for f in every if sum(f) <= room and not any(counts[k] > f.count(k) and k <= room - sum(f) for k in lengths)}
        assert len(got) == len(set(got)) and {f for _, f in got} == maximal
        assert got == sorted(got, key=lambda g: (g[0], tuple(-x for x in g[1]))) and all(w == room - sum(f) for w, f in got)


def test_rows_that_repeat_id_and_text_come_near_the_target_too(spark, documents):
    rows = [(None, "w " * 10, "a")] * 500 + [(i, "x " * 10, "b") for i in range(100)]
    docs = documents(*rows)
    for _ in range(2):
        kept = Counter(r["source"] for r in mixing.take_mix(docs.repartition(7)).collect())
        assert abs(10 * kept["a"] - 30_000 / 7) <= 10 and abs(10 * kept["b"] - 12_000 / 7) <= 10
    sized = docs.select("doc_id", "source", mixing.word_count(docs["text"]).alias("size"), mixing.row_hash(6).alias("_h"))
    taken = Counter()
    for r in mixing.mix_sources(sized).collect():
        taken[r["source"]] += r["taken"]
    assert abs(taken["a"] - 30_000 / 7) <= 10 and abs(taken["b"] - 12_000 / 7) <= 10


def test_targets_of_many_sources(spark):
    rng = random.Random(8)
    sizes = {f"s{i:03d}": int(rng.paretovariate(0.6)) for i in range(300)} | {None: 7, "zero": 0}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
    want = targets_by_force(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_the_query_equals_its_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in mixing.op6_source_mix(spark, folder).select("doc_id", "size", "source_size", "target", "taken").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    assert got == sorted(con.execute(mixing.OP6_SQL).fetchall())
