import random

from tributary.llm import toxicity as tox


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    bad = ["vilest", "rotten", "nasty"]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 60))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(rng.randrange(2, 8)):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((" ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy_and_order():
    train, test = corpus(600, 1), corpus(300, 2)
    model = tox.fit([t for t, _ in train], [y for _, y in train])
    right = sum((model.score(t)[0] >= model.bar) == bool(y) for t, y in test)
    assert right / len(test) > 0.97
    assert model.thresholds == sorted(model.thresholds)
    mild, grave = model.score("worda " * 20 + "nasty rotten")[0], model.score("nasty rotten vilest " * 6)[0]
    assert grave > mild > model.score("worda " * 20)[0]


def test_one_class_calls_nothing_toxic():
    model = tox.fit(["a b", "c d"], [0, 0])
    assert model.score("a")[0] == 0.0 < model.bar


def test_stage_and_edges(spark, documents):
    rows = [(i, t) for i, (t, _) in enumerate(corpus(200, 3))] + [(None, "nasty rotten vilest nasty"), (500, None), (501, "")]
    labels = spark.createDataFrame([(i, 0, y) for i, (_, y) in enumerate(corpus(200, 3))] + [(9999, 0, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    docs = documents(*rows)
    model = tox.train(docs, labels)
    graded = {r["doc_id"]: r for r in tox.grade(docs, model).collect()}
    assert graded[None]["toxic"] and not graded[500]["toxic"] and graded[500]["severity"] == graded[501]["severity"]
    kept = tox.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r["toxic"] for r in graded.values())
    assert tox.grade(documents(), model).count() == 0
    assert tox.train(documents(), labels).bar == float("inf")


def test_gradient_matches_differences():
    import numpy as np

    data = tox._Sample(*zip(*corpus(40, 5), strict=True))
    grade = np.arange(len(data.rows)) % (tox.GRADES + 1)
    features = sorted({f for r in data.rows for f in r})[:12]
    loss = tox._Ordinal(data.rows, grade, features, 0.01)
    rng = np.random.default_rng(3)
    params = [rng.normal(size=12) * 0.3, rng.normal(size=tox.GRADES) * 0.3]
    value, *slopes = loss.gradient(*params)
    for x, slope in zip(params, slopes, strict=True):
        for i in range(len(x)):
            x[i] += 1e-6
            assert abs((loss.gradient(*params)[0] - value) / 1e-6 - slope[i]) < 1e-4
            x[i] -= 1e-6


def test_severity_follows_how_bad_held_out_texts_are():
    rng = random.Random(6)
    vocabulary = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    levels = [["vilest", "monstrous"], ["rotten", "nasty"], ["silly", "rude"]]

    def text(level):
        words = [rng.choice(vocabulary) for _ in range(40)]
        for _ in range(0 if level is None else 2 + 3 * (2 - level)):
            words[rng.randrange(40)] = rng.choice(levels[level])
        return " ".join(words)

    rows = [(text(lv), int(lv is not None), lv) for lv in [0, 1, 2, None, None, None] * 150]
    model = tox.fit([t for t, _, _ in rows[:600]], [y for _, y, _ in rows[:600]])
    by = {lv: [model.score(t)[0] for t, _, level in rows[600:] if level == lv] for lv in (None, 2, 1, 0)}
    means = [sum(v) / len(v) for v in by.values()]
    assert means == sorted(means) and means[0] < 0.5 < means[1]
    flagged = {lv: sum(s >= model.bar for s in v) / len(v) for lv, v in by.items()}
    assert flagged[None] < 0.02 and min(flagged[lv] for lv in (0, 1, 2)) > 0.95


def test_near_copies_share_a_fold_and_grades_are_cross_fitted():
    data = tox._Sample(*zip(*corpus(90, 7), strict=True))
    nothing = data.grades([{}] * tox.FOLDS)
    assert set(nothing[data.y == 0].tolist()) <= {0} and len(set(nothing[data.y == 1].tolist())) == 1


def test_a_very_long_text_and_ties(spark, documents):
    rows = [(i, t) for i, (t, _) in enumerate(corpus(120, 8))]
    labels = spark.createDataFrame([(i, 0, y) for i, (_, y) in enumerate(corpus(120, 8))] + [(0, 0, 0)], "doc_id long, quality int, toxic int")
    docs = documents(*rows, (900, "word " * 300_000 + "nasty rotten vilest " * 50), (901, rows[0][1]))
    model = tox.train(docs, labels)
    graded = {r["doc_id"]: r for r in tox.grade(docs, model).collect()}
    assert graded[900]["toxic"] and graded[901]["severity"] == graded[0]["severity"]


def test_labels_of_missing_documents_do_not_shrink_the_sample(spark, documents, monkeypatch):
    monkeypatch.setattr(tox, "SAMPLE", 60)
    rows = corpus(120, 9)
    labels = spark.createDataFrame([(i, 0, y) for i, (_, y) in enumerate(rows)] + [(i, 0, i % 2) for i in range(1000, 9000)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(tox, "fit", lambda texts, toxic: seen.append(sum(toxic)) or tox.Ordinal({}, []))
    tox.train(documents(*[(i, t) for i, (t, _) in enumerate(rows)]), labels)
    assert seen == [sum(y for _, y in rows)]
