import hashlib
import random
import re

from tributary.llm import pii

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_match_brute_force():
    rng = random.Random(4)
    for _ in range(5000):
        text = "".join(rng.choice("a1@..-+ ()9255é") for _ in range(40))
        assert pii.base_spans(text) == brute(text), text


def test_scanners_are_linear_in_long_runs():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1 " * 100_000, "a@" * 100_000, "(" * 200_000):
        pii.base_spans(text)
        pii.crf_spans([text], pii.model())


def test_crf_on_held_out_forms():
    cases = {"please call 415-555-2671 now": "phone", "her number (312) 555-0188.": "phone", "ssn 078-05-1120 given": "id", "on 2024-01-05 12:30:11 it ran": None, "version 3.14159265358 and": None, "order 20240105 came": None}
    for text, kind in cases.items():
        found = pii.crf_spans([text], pii.model())[0]
        assert ([k for _, _, k in found] == [kind]) if kind else not found, (text, found)


def test_training_table_is_learnt():
    table = pii.labelled_table()
    right = sum(found == spans for (_, spans), found in zip(table, pii.crf_spans([t for t, _ in table], pii.model()), strict=True))
    assert right / len(table) > 0.98


def test_edge_rows(spark, documents):
    rows = pii.find_pii(documents((1, None), (2, ""), (3, "a@b.co x +1 (988) 555-2485"), (3, "a@b.co x +1 (988) 555-2485"), (None, "10.0.0.1"))).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    empty = hashlib.sha256(b"").hexdigest()
    assert by[1][0]["base_sha256"] == by[2][0]["base_sha256"] == empty and by[1][0]["spans"] == ""
    assert len(by[3]) == 2 and by[3][0]["spans"] == "email:0:6,phone:9:26" and by[None][0]["n_ip"] == 1
    assert pii.find_pii(documents()).count() == 0


def test_viterbi_matches_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(30):
        tags = 4
        crf = pii.Crf({}, rng.normal(size=(1, tags)), rng.normal(size=(tags + 1, tags)))
        scores = [rng.normal(size=(int(n), tags)) for n in rng.integers(1, 6, 5)]
        for s, got in zip(scores, crf.viterbi(scores), strict=True):
            value = lambda y: crf.trans[-1, y[0]] + sum(s[i, t] for i, t in enumerate(y)) + sum(crf.trans[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
            assert tuple(got) == max(itertools.product(range(tags), repeat=len(s)), key=value)


def test_gradient_matches_differences():
    import numpy as np

    rows = [[["a", "b"], ["b"], ["c", "a"]], [["c"], ["a"]], [["b", "c"]]]
    data = pii._Training(rows, [[0, 1, 2], [2, 2], [1]], 3)
    rng = np.random.default_rng(2)
    weights = [rng.normal(size=shape) for shape in data.shape]
    weights[0][-1] = 0  # unknown features
    value, *slopes = data.gradient(*weights)
    for x, slope in zip(weights, slopes, strict=True):
        for at in np.ndindex(x.shape):
            if x is weights[0] and at[0] == x.shape[0] - 1:
                continue  # padding
            x[at] += 1e-6
            assert abs((data.gradient(*weights)[0] - value) / 1e-6 - slope[at]) < 1e-4
            x[at] -= 1e-6


def held_out(n, seed):
    """Sentences with words, and mostly forms, that the training table does not have."""
    rng = random.Random(seed)
    write = lambda form: "".join(str(rng.randrange(10)) if c == "#" else c for c in form)
    cases = [
        ("phone", ["### ###-####", "(###)###-####", "0## ####-####", "0#-##-##-##-##", "0## / #######", "##-####-####"], ["reach us under", "dial", "whatsapp", "contact", "hotline"]),
        ("card", ["#### #### #### ####", "5###############", "####.####.####.####"], ["mastercard", "charged to", "debit", "kreditkarte"]),
        ("id", ["### ## ####", "###-##-####"], ["ssn no", "social security no", "taxpayer"]),
        ("", ["20##-##-##T##:##", "##.##.20## ##:##", "978-##-####-###-#", "###,###,###", "##.###.###", "20##/##/##", "#### #### ####", "1.##########"], ["released", "of", "revenue", "volume", "measured", "created", "about"]),
        ("", ["###-###-####", "##-###-####"], ["part no", "sku", "isbn", "model", "item"]),
    ]
    for _ in range(n):
        kind, forms, words = rng.choice(cases)
        word, value = rng.choice(words), write(rng.choice(forms))
        head = rng.choice(["please note ", "Our ", "", "hier: "]) + word + rng.choice([" ", ": ", " - "])
        yield head + value + rng.choice([" thanks", ".", ", and more", "\nnext"]), (len(head), len(head) + len(value), kind) if kind else None


def test_precision_and_recall_on_held_out_forms():
    cases = list(held_out(600, 5))
    found = pii.crf_spans([t for t, _ in cases], pii.model())
    wanted = sum(span is not None for _, span in cases)
    hits = sum(span in spans for (_, span), spans in zip(cases, found, strict=True) if span)
    given = sum(map(len, found))
    print(f"precision {hits / given:.3f}, recall {hits / wanted:.3f}")
    assert hits / given >= 0.85 and hits / wanted >= 0.7


def test_what_stands_before_in_a_group_does_not_cut_a_number():
    for pairs in range(64):
        text = "phone " + "12 " * pairs + "or 415-555-2671 end"
        assert (text.index("415"), text.index(" end"), "phone") in pii.crf_spans([text], pii.model())[0]
    long = "phone " + "12 " * 5000 + "415-555-2671 end"
    assert len(pii.crf_spans([long] * 2, pii.model())) == 2


def test_features_by_blocks_are_those_of_the_whole():
    tokens = ["12", "-", "345", " ", "6", ".", "78", "/", "9"]
    for lo in range(len(tokens)):
        for hi in range(lo + 1, len(tokens) + 1):
            assert pii.features(tokens, "call", lo, hi) == pii.features(tokens, "call")[lo:hi]
