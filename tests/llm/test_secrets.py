import hashlib
import random
import re

from pyspark.sql import functions as F

from tributary.llm import secret_scan as scan

WORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"


def brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"({WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans_match_brute_force(spark, documents):
    rng = random.Random(6)
    parts = ["password=", "Token : ", "secret:'", "api_key=", "APIKEY=", "abc", "abcdef", "é", " ", "AKIA", "AKIA" + "Z9" * 8, "0123456789abcdef" * 2, "f" * 23, "\U0001f600", "==", "\n"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for i in range(400)] + [(400, None), (401, ""), (402, ("0" * 30 + "g") * 700)]
    for r in scan.scan_secrets(documents(*rows)).collect():
        want = brute(rows[r["doc_id"]][1] or "")
        text = ",".join(f"{scan.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), rows[r["doc_id"]]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in want) for i in range(3)]


def test_battery_tells_random_from_written(spark):
    rng = random.Random(8)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    drawn = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(50)]
    written = ["internationalisierungsbehoerden", "a" * 40, "some_long_variable_name_of_code", "path/to/some/folder/with/files", "abcdefghijklmnopqrstuvwxyzabcdefgh"]
    p = lambda xs: [r[0] for r in spark.createDataFrame([(x,) for x in xs], "t string").select(scan.battery(F.col("t"))).collect()]
    assert max(p(drawn)) < 0.01 and min(p(written)) > 0.05


def test_random_tokens_are_added_and_base_spans_stay(spark, documents):
    rng = random.Random(9)
    token = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789") for _ in range(44))
    out = {r["doc_id"]: r["spans"] for r in scan.scan_secrets(documents((1, f"key {token} end"), (2, f"password={token}"), (3, "eine internationalisierungsbehoerde"))).collect()}
    assert out == {1: "random:4:48", 2: "assign:0:53", 3: ""}
    assert scan.scan_secrets(documents()).count() == 0


def test_random_letters_of_one_case_are_found(spark, documents):
    rng = random.Random(10)
    drawn = ["".join(rng.choices(a, k=n)) for n in (128, 256) for a in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(20)]
    words = "the of and that report which public would government between council measures under after people their about water other first house again".split()
    written = ["".join(rng.choice(words) for _ in range(30))[:n] for n in (20, 32, 64, 128) for _ in range(20)]
    p = lambda xs: [r[0] for r in spark.createDataFrame([(x,) for x in xs], "t string").select(scan.battery(F.col("t"))).collect()]
    assert max(p(drawn)) < 0.01 and min(p(written)) > 0.01
    assert [r["spans"] for r in scan.scan_secrets(documents((1, f"key {drawn[0]} end"))).collect()] == ["random:4:132"]


def spans_by(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["spans"] for r in scan.scan_secrets(docs).sort("doc_id").collect()]


WRITTEN = """account active address after amount archive array attach audit balance batch before binary block buffer cache cancel category change channel check child clear
 client cluster code command commit compare compute connect content context copy core count cursor database decode delay depth device dialog digest display document domain
 driver dynamic edit element empty enable encode engine entity entry envelope equal execute export extend external field filter finish flag folder frame function global grid
 group handle header hidden history identity image import initial input invoke issue join label language layer layout level limit link listener local logger login lookup
 market master matrix member memory merge method metric mode model module monitor network node notify offset online operator output owner package packet page panel parent
 partition password patch pattern payload payment pending permission phase pointer policy pool position prefix primary priority private process profile progress project
 property protocol provider proxy queue random range record recovery region register relation release remote render repeat replace report resource restore result retry
 return review role root route rule runtime sample schedule schema scope score script section segment sender sequence shared signal single source spring stack stage standard
 state static status storage store stream style subject submit support switch symbol sync target task template text thread ticket token topic trace track trade transfer
 trigger update upload valid vector vendor version view volume wait warning widget window worker wrapper zone""".split()


def test_camel_case_identifiers_are_not_secrets(spark):
    rng = random.Random(20)
    names = ["".join(w.capitalize() for w in rng.choices(WRITTEN, k=5)) for _ in range(1000)]
    assert sum("random" in s for s in spans_by(spark, [f"call {n} here" for n in names])) < 20


def test_lower_case_secrets_are_found(spark):
    rng = random.Random(21)
    drawn = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=40)) for _ in range(500)]
    assert sum("random" in s for s in spans_by(spark, [f"the key is {t} today" for t in drawn])) >= 450


def test_false_discoveries_stay_near_the_level(spark):
    rng = random.Random(22)
    joins = [
        lambda ws: "".join(ws),
        lambda ws: "_".join(ws),
        lambda ws: "".join(w.capitalize() for w in ws),
        lambda ws: "-".join(ws) + f"-{rng.randrange(1000)}",
        lambda ws: "/".join(ws),
        lambda ws: "".join(ws).upper(),
        lambda ws: "".join(f"{w}{rng.randrange(10)}" for w in ws),
    ]
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = [lower + upper + digits + "+/", lower + upper + digits, lower + digits, upper + digits, upper + "234567", lower]
    rows = []
    for i in range(1500):
        if i % 3 == 0:
            rows.append((True, "".join(rng.choices(alphabets[i // 3 % len(alphabets)], k=rng.choice([40, 64])))))
        else:
            text = rng.choice(joins)(rng.choices(WRITTEN, k=rng.choice([4, 5, 6, 8])))
            rows.append((False, text if len(text) >= scan.MIN_LENGTH else text * 2))
    found = ["random" in s for s in spans_by(spark, [f"we read {t} and more" for _, t in rows])]
    false = sum(f for f, (secret, _) in zip(found, rows, strict=True) if not secret)
    true = sum(f for f, (secret, _) in zip(found, rows, strict=True) if secret)
    assert false <= max(3, 0.02 * (false + true)) and true >= 400


def test_step_up_rule_matches_brute_force(spark):
    rng = random.Random(23)
    for alpha in (0.01, 0.2):
        bins = [(rng.randrange(4, 7), int(min(2000, rng.expovariate(1 / 25)))) for _ in range(300)]
        counted = {b: bins.count(b) for b in set(bins)}
        histogram = spark.createDataFrame([(s, b, n) for (s, b), n in counted.items()], "size int, bin int, n long")
        got = {r["size"]: r["bar"] for r in scan.step_up_bars(histogram, alpha).collect()}
        for size in range(4, 7):
            p = sorted(10 ** (-b / 20) for s, b in bins if s == size)
            last = max((x for i, x in enumerate(p, 1) if x <= alpha * i / len(p)), default=None)
            rejected = sum(x <= last for x in p) if last else 0
            assert rejected == sum(s == size and size in got and b >= got[size] for s, b in bins)


def test_every_word_of_the_corpus_is_in_the_null(spark, monkeypatch):
    rng = random.Random(24)
    words = sorted({"".join(rng.choices("abcdefghij", k=rng.randrange(6, 12))) for _ in range(7000)})
    seen = []
    joined = scan.joined_tokens
    monkeypatch.setattr(scan, "joined_tokens", lambda ws: seen.append(sorted(r["t"] for r in joined(ws).collect())) or joined(ws))
    scan.written_words(spark.createDataFrame([(" ".join(words[i : i + 50]),) for i in range(0, len(words), 50)], "text string"))
    tokens = seen[0]
    # Each word's letters are in one token of every style: capitalised and plain, with and without digits.
    plain = [t for t in tokens if t.islower() and t.isalpha()]
    total = sum(map(len, {*words, *scan.VOCABULARY}))
    assert sum(map(len, plain)) == total and sum(sum(c.isalpha() for c in t) for t in tokens) == 4 * total
    assert all(any(w in t for t in plain) for w in words[::50])
    few = [r["t"] for r in joined(spark.createDataFrame([], "w string")).collect()]
    assert len(few) >= 0.8 * 4 * scan.NULL_TOKENS
