import hashlib
import random
import re

import numpy as np
import xxhash

from tributary.llm import exact_dedup as exact
from tributary.llm import line_dedup as lines
from tributary.llm import simhash_dedup as sim


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_dedup_matches_brute_force(spark, documents):
    rng = random.Random(1)
    texts = ["Hot Text", None, "", "ÄB", "äb", "İx"] + [f"t{i}" for i in range(40)]
    rows = [(i, rng.choice(texts[:1] * 30 + texts)) for i in range(400)]
    out = {r["doc_id"]: r for r in exact.exact_dedup(documents(*rows), support=0.05).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    for i, t in rows:
        g, r = groups[lower(t)], out[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(g), len(g), i == max(g), hashlib.sha256(lower(t).encode()).hexdigest())


def test_exact_dedup_keeps_one_of_repeated_rows(spark, documents):
    out = exact.exact_dedup(documents((1, "a"), (1, "A"), (None, "a"), (None, "z"), (None, "z"))).collect()
    assert sum(r["kept"] for r in out) == 2 and len(out) == 5
    assert exact.exact_dedup(documents()).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["Ab", "c", " ", "\t", "\x0b", "é", "\xa0", "\x85", "Z "]) for _ in range(rng.randrange(60)))
        assert sim.fingerprint(text) == brute_fingerprint(text), repr(text)
    assert sim.fingerprint(None) == 0
    assert sim.fingerprint("w " * 200_000) == brute_fingerprint("w w w w")


def test_any_four_bits_leave_a_segment_with_at_most_one():
    rng = random.Random(5)
    for _ in range(20_000):
        bits = rng.sample(range(64), 4)
        assert min(sum(a <= b < a + n for b in bits) for a, n in sim.SEGMENTS) <= 1


def components_by_force(fps, ids):
    u = np.array(sorted(set(fps)), np.uint64)
    parent = {int(x): int(x) for x in u}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(u):
        for y in u[i + 1 :][np.bitwise_count(u[i + 1 :] ^ x) <= 4]:
            parent[find(int(x))] = find(int(y))
    low = {}
    for f, i in zip(fps, ids, strict=True):
        low[find(f)] = min(low.get(find(f), i), i)
    return [low[find(f)] for f in fps]


def test_components_match_brute_force(spark):
    rng = random.Random(7)
    fps = [0, 0, 0b1111, 0b11111, (1 << 64) - 1]
    for _ in range(12):  # chains and dense clusters about random centres
        at = rng.getrandbits(64)
        for _ in range(25):
            fps.append(at)
            for _ in range(rng.randrange(5)):
                at ^= 1 << rng.randrange(64)
    ids = list(range(len(fps)))
    rng.shuffle(ids)
    prints = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in zip(ids, fps, strict=True)], "doc_id long, fp long")
    out = {r["doc_id"]: r["component_id"] for r in sim.simhash_components(prints).collect()}
    assert [out[i] for i in ids] == components_by_force(fps, ids)


def test_near_duplicate_stage(spark, documents):
    text = " ".join(f"w{i}" for i in range(300))
    docs = documents((5, text), (3, text + " x"), (9, "other words here now " * 3), (9, "other words here now " * 3), (None, None), (7, ""))
    kept = sim.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 3, 7, 9]
    assert sim.keep_one(documents()).count() == 0 and sim.near_duplicates(documents()).count() == 0


BOILER = "This page was printed by user {} and all rights are reserved by the owners of it"


def test_templates_with_variable_fields_go_from_all_but_the_first(spark, documents):
    rows = [(i, f"unique opening number {chr(97 + i) * 5} goes here\n{BOILER.format(i)}\nAll rights reserved.") for i in range(6)]
    out = {r["doc_id"]: r for r in lines.dedup_lines(documents(*rows), report=True).collect()}
    assert out[0]["n_dropped"] == 0 and out[0]["text"] == rows[0][1]
    assert all(out[i]["n_dropped"] == 2 and out[i]["text"] == rows[i][1].split("\n")[0] for i in range(1, 6))


def test_word_fields_are_generalised_in_a_leaf(spark, documents):
    names = ["anna", "bert", "carl", "dora", "emil"]
    rows = [(i, f"thank you for reading dear {n} and do come back to us again soon\nbody {n * 3} text of {n} {i}") for i, n in enumerate(names)]
    out = {r["doc_id"]: r["n_dropped"] for r in lines.dedup_lines(documents(*rows), report=True).collect()}
    assert out == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1}


def test_lines_that_do_not_recur_stay(spark, documents):
    docs = documents((1, "same line in one text\nsame line in one text\nsame line in one text\nsame line in one text"), (2, None), (3, ""), (4, "a b"), (5, "a b"), (6, "a b"), (7, "a b"))
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()}
    assert out == {r["doc_id"]: r["text"] for r in docs.collect()}
    assert lines.dedup_lines(documents()).count() == 0


def test_repeated_rows_count_once(spark, documents):
    docs = documents(*[(1, "one line of four\nx")] * 5, (2, "other things"))
    assert [r["n_dropped"] for r in lines.dedup_lines(docs, report=True).collect()] == [0] * 6


def test_long_lines_recur_with_two_documents(spark, documents):
    line = "a passage of nine or more words that two documents share"
    very = " ".join(f"w{chr(97 + i % 26)}" for i in range(60))
    rows = [(1, f"{line}\n{very} 17"), (2, f"opening\n{line}"), (3, f"{very} 18\nclosing"), (4, "eight words that two of the documents share"), (5, "eight words that two of the documents share"), (6, line + " 1"), (7, line + " 2")]
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(documents(*rows)).collect()}
    assert out == dict(rows) | {2: "opening", 3: "closing"}
    twice = documents((1, line), (1, line), (2, "other"))
    assert [r["n_dropped"] for r in lines.dedup_lines(twice, report=True).collect()] == [0] * 3


def test_short_lines_recur_as_they_are(spark, documents):
    rows = [(i, f"Les.\n\nAnd ornd.\n{i}\nbody {chr(97 + i)}") for i in range(lines.SHORT_DOCS)]
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(documents(*rows)).collect()}
    assert out == {i: t if i == 0 else f"\n{i}\nbody {chr(97 + i)}" for i, t in rows}


def test_a_document_counts_once_in_a_template(spark, documents):
    names = ["anna", "bert", "carl", "dora"]
    line = "thank you for reading dear {} and do come back to us again soon"
    rows = [(1, "\n".join(line.format(n) for n in names[:2])), (2, "\n".join(line.format(n) for n in names[2:]))]
    assert [r["n_dropped"] for r in lines.dedup_lines(documents(*rows), report=True).collect()] == [0, 0]


def test_near_duplicates_match_brute_force_end_to_end(spark, documents):
    rng = random.Random(11)
    rows = []
    for i in range(120):
        words = [rng.choice(["a", "b", "c", "d", "e"]) + str(rng.randrange(40)) for _ in range(rng.choice([0, 1, 3, 60, 200]))]
        rows.append(" ".join(words))
        for _ in range(rng.randrange(3)):
            near = list(words)
            if near:
                near[rng.randrange(len(near))] = "x"
            rows.append(" ".join(near).upper() if rng.random() < 0.3 else " ".join(near))
    rows += [None, ""]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    out = {r["doc_id"]: r for r in sim.near_duplicates(documents(*zip(ids, rows, strict=True))).collect()}
    fps = [brute_fingerprint(t) for t in rows]
    assert [out[i]["fingerprint"] for i in ids] == [f"{f:016x}" for f in fps]
    assert [out[i]["component_id"] for i in ids] == components_by_force(fps, ids)


def test_sub_runs_of_hot_keys_lose_no_link(spark, monkeypatch):
    rng = random.Random(12)
    base = rng.getrandbits(64)
    fps = [(base & ((1 << 22) - 1)) | rng.getrandbits(42) << 22 for _ in range(1500)]  # all share the first segment
    for at in fps[:200]:
        for _ in range(2):
            fps.append(at ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))))
    frame = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "doc_id long, fp long")
    want = components_by_force(fps, list(range(len(fps))))
    for rows in (sim.HOT_ROWS, 4):
        monkeypatch.setattr(sim, "HOT_ROWS", rows)
        assert rows != 4 or len(sim._hot_keys(frame.select("fp").distinct())) >= 22
        out = {r["doc_id"]: r["component_id"] for r in sim.simhash_components(frame).collect()}
        assert [out[i] for i in range(len(fps))] == want


def test_similar_groups_match_brute_force(spark, documents):
    rng = random.Random(13)
    rows = []
    for _ in range(40):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([2, 30, 120]))]
        rows.append(" ".join(words))
        for share in (0.01, 0.03, 0.2):
            rows.append(" ".join("q" if rng.random() < share else w for w in words))
    prints = [sim.fingerprint(t, sim.WIDE_SHINGLE, more=sim.WIDE_WORDS - 1) for t in rows]
    parts = [64 * w + sim.WIDE_SEGMENT * s for w in (0, 1) for s in range(3)]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(prints):
        for j in range(i):
            d = x ^ prints[j]
            if d.bit_count() <= sim.WIDE_DISTANCE and (d & (2**128 - 1)).bit_count() <= sim.MEETING and min((d >> a & ((1 << sim.WIDE_SEGMENT) - 1)).bit_count() for a in parts) <= 1:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    out = {r["doc_id"]: r["component_id"] for r in sim.similar_groups(documents(*enumerate(rows))).collect()}
    assert [out[i] for i in range(len(rows))] == [find(i) for i in range(len(rows))]
    assert sim.WIDE_DISTANCE == 77


def jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_similar_texts_are_found_and_others_left(spark, documents):
    rng = random.Random(14)
    rows = []
    for i in range(240):
        words = [f"w{rng.randrange(3000)}" for _ in range(300)]
        rows += [" ".join(words), " ".join("q" if rng.random() < (0.01, 0.02, 0.06)[i % 3] else w for w in words)]
    out = {r["doc_id"]: r["component_id"] for r in sim.similar_groups(documents(*enumerate(rows))).collect()}
    found = {"near": [], "far": []}
    for i in range(0, len(rows), 2):
        j = jaccard(rows[i], rows[i + 1])
        if j >= 0.85 or j < 0.65:
            found["near" if j >= 0.85 else "far"].append(out[i] == out[i + 1])
    assert sum(found["near"]) >= 0.85 * len(found["near"]) > 60 and sum(found["far"]) <= 0.02 * len(found["far"]) and len(found["far"]) > 60
    assert sum(len({out[i], out[j]}) == 1 for i in range(0, 480, 2) for j in range(0, i, 2)) == 0


def test_every_pair_at_the_similarity_is_in_one_group(spark, documents, monkeypatch):
    rng = random.Random(15)
    rows = ["", " ", "one two", "One  two", "a b c d " * 50, "a b c d " * 9 + "a"]
    for _ in range(150):  # pairs near the similarity, which the fingerprints find about half of
        n = rng.choice([8, 9, 30, 120, 400])
        words = [f"w{rng.randrange(4000)}" for _ in range(n)]
        share = rng.choice([0.005, 0.02, 0.025])
        rows += [" ".join(words), " ".join("q" if rng.random() < share else w for w in words), " ".join(words[rng.randrange(0, 1 + n // 5) :])]
    rows += [" ".join(["the same words in front of all texts and behind them"] * 3 + [f"v{rng.randrange(9000)}" for _ in range(12)]) for _ in range(40)]
    weighted = " ".join(f"x{i}" for i in range(60))  # one set of shingles, counted differently
    rows += [weighted + " " + " ".join([weighted] * k) + " x0 x1 x2 x3" + " x0 x1 x2 x3 x4 x5" * m for k, m in ((1, 0), (1, 90), (30, 90))]
    words = [t.lower().split() for t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    shares = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(rows)) for j in range(i)}
    pairs = [p for p, s in shares.items() if s >= 0.8]
    assert any(s == 0.8 for s in shares.values()) and len(pairs) > 150
    for share in (sim.SHINGLE_SHARE, 1):  # with and without frequent shingles known
        monkeypatch.setattr(sim, "SHINGLE_SHARE", share)
        out = {r["doc_id"]: r["component_id"] for r in sim.similar_groups(documents(*enumerate(rows)), exact=True).collect()}
        assert [(i, j) for i, j in pairs if out[i] != out[j]] == []
    # What is in one group is linked through texts of about that similarity.
    assert len(set(out.values())) > 150


def test_the_stage_keeps_one_of_every_similar_pair(spark, documents):
    rows = []
    for i in range(60):  # 90 shingles and 72 of them: the fingerprints do not find all of these pairs
        words = [f"w{i}x{k}" for k in range(94)]
        rows += [" ".join(words), " ".join(words[18:])]
    assert jaccard(*rows[:2]) == 0.8
    docs = documents(*enumerate(rows))
    assert len({r["component_id"] for r in sim.similar_groups(docs).collect()}) > 60
    assert sorted(r["doc_id"] for r in sim.keep_one(docs).collect()) == list(range(0, 120, 2))
