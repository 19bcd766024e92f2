import random

import pytest
from pyspark.sql import functions as F

from tributary.operators import accumulate as acc
from tributary.operators.accumulate import Agg
from tributary.operators.emission import EveryN, TimeWindow
from tributary.sources.functional import finite


def rows(spark, data, schema="key string, value double"):
    return finite(spark, data, schema)


def simulate_top_n(data, cap):
    scores = {}
    for i, (k, v) in enumerate(data):
        scores[k] = (v, i)
        if len(scores) > cap:
            del scores[min(scores, key=lambda x: (scores[x][0], -scores[x][1]))]
    return [(k, v) for k, (v, _) in sorted(scores.items(), key=lambda kv: (-kv[1][0], kv[1][1]))]


def test_top_n_forgets_evicted_keys(spark):
    out = acc.top_n(1, "key", "value").apply(rows(spark, [("a", 10.0), ("b", 8.0), ("a", 4.0)])).first()
    assert [(x["key"], x["score"]) for x in out["top_n"]] == [("a", 4.0)]


def test_top_n_contract(spark):
    data = [("a", 10.0), ("b", 8.0), ("a", 4.0)]
    out = acc.top_n(2, "key", "value").apply(rows(spark, data)).first()
    assert [(x["rank"], x["key"], x["score"]) for x in out["top_n"]] == [(1, "b", 8.0), (2, "a", 4.0)] and out["capacity"] == 2 and out["count"] == 2
    by = acc.top_n_by(2, "key", "value").apply(rows(spark, data)).first()
    assert [(x["key"], x["total"]) for x in by["top_n"]] == [("a", 14.0), ("b", 8.0)] and by["total_items"] == 2


def test_top_n_matches_simulator(spark):
    rng = random.Random(5)
    data = [(f"k{rng.randrange(20)}", float(rng.randrange(8))) for _ in range(400)]
    for cap in (1, 3, 7):
        out = acc.top_n(cap, "key", "value").apply(rows(spark, data)).first()
        assert [(x["key"], x["score"]) for x in out["top_n"]] == simulate_top_n(data, cap)


def test_top_n_empty_and_bad_capacity(spark):
    assert acc.top_n(1, "key", "value").apply(rows(spark, [])).count() == 0
    assert acc.top_n_by(1, "key", "value").apply(rows(spark, [])).count() == 0
    with pytest.raises(ValueError):
        acc.top_n(0, "key", "value")


def test_empty_reduce_emits_nothing(spark):
    assert acc.reduce(n=Agg.count()).apply(rows(spark, [])).count() == 0


def test_every_n_with_tail_and_repeat(spark):
    fold = acc.reduce(n=Agg.count()).emit_every_n(2)
    five = fold.apply(rows(spark, [("a", 1.0)] * 5)).orderBy("_emitted_at", "_terminal")
    assert [r["n"] for r in five.collect()] == [2, 4, 5]
    four = fold.apply(rows(spark, [("a", 1.0)] * 4)).orderBy("_emitted_at", "_terminal")
    assert [r["n"] for r in four.collect()] == [2, 4, 4]
    with pytest.raises(ValueError):
        EveryN(0)


def test_group_by_emit_always_shows_every_bucket(spark):
    out = acc.group_by("key", n=Agg.count()).emit_always().apply(rows(spark, [("a", 1.0), ("b", 1.0), ("a", 1.0)]))
    shown = [r for r in out.collect() if not r["_terminal"]]
    assert len(shown) == 5 and sum(r["_terminal"] for r in out.collect()) == 2
    changed = acc.GroupBy(acc.EmitAlways(), ["key"], {"n": Agg.count()}, changes_only=True).apply(rows(spark, [("a", 1.0), ("b", 1.0), ("a", 1.0)]))
    assert changed.filter("not _terminal").count() == 3


def test_group_by_every_n_matches_simulator(spark):
    rng = random.Random(2)
    data = [(f"k{rng.randrange(6)}", float(i)) for i in range(103)]
    out = acc.group_by("key", n=Agg.count(), total=Agg.sum("value")).emit_every_n(10).apply(rows(spark, data))
    want, state = [], {}
    for i, (k, v) in enumerate(data, 1):
        n, t = state.get(k, (0, 0.0))
        state[k] = (n + 1, t + v)
        if i % 10 == 0:
            want += [(x, *s, i, False) for x, s in state.items()]
    want += [(x, *s, len(data), True) for x, s in state.items()]
    assert sorted(map(tuple, out.select("key", "n", "total", "_emitted_at", "_terminal").collect())) == sorted(want)


def test_tumbling_period_is_anchored_and_keeps_its_closing_row(spark):
    data = [(float(t),) for t in (0, 5, 12, 13, 30)]
    df = finite(spark, data, "t double")
    out = acc.reduce(n=Agg.count(), low=Agg.min("t")).emit_within(10).apply(df, "_seq", "t")
    assert sorted((r["n"], r["low"]) for r in out.collect()) == [(2, 13.0), (3, 0.0)]
    with pytest.raises(ValueError):
        TimeWindow(0)


def test_time_windows_match_simulator(spark):
    rng = random.Random(9)
    times, t = [], 0.0
    for _ in range(200):
        t += rng.choice([0.5, 1.0, 2.0, 25.0])
        times.append(t)
    out = acc.reduce(n=Agg.count()).emit_within(10).apply(finite(spark, [(x,) for x in times], "t double"), "_seq", "t")
    want, opened, n = [], None, 0
    for x in times:
        opened = x if opened is None else opened
        n += 1
        if x - opened >= 10:
            want.append(n)
            opened, n = None, 0
    want += [n] if n else []
    assert sorted(r["n"] for r in out.collect()) == sorted(want)


def test_conflate(spark):
    out = acc.conflate("key").apply(rows(spark, [("a", 1.0), ("b", 2.0), ("a", 3.0)]))
    assert sorted((r["key"], r["value"]) for r in out.collect()) == [("a", 3.0), ("b", 2.0)]
    always = acc.conflate("key").emit_always().apply(rows(spark, [("a", 1.0), ("b", 2.0), ("a", 3.0)]))
    assert always.filter("not _terminal").count() == 5


def test_custom_accumulator_with_policy(spark):
    out = acc.custom(rows(spark, [("a", 1.0)] * 5), lambda: 0, lambda s, r: s + 1, lambda s: [{"n": s}], "n long", EveryN(2))
    assert [r["n"] for r in out.collect()] == [2, 4, 5]
    reset = acc.custom(finite(spark, [(0.0,), (5.0,), (12.0,)], "t double"), lambda: 0, lambda s, r: s + 1, lambda s: [{"n": s}], "n long", TimeWindow(10), ts="t")
    assert [r["n"] for r in reset.collect()] == [3]


def test_marked_rows_are_not_accumulated(spark):
    df = rows(spark, [("a", 1.0), ("a", 2.0)]).withColumn("_error_kind", F.when(F.col("value") > 1, "Domain"))
    assert acc.reduce(n=Agg.count()).apply(df).first()["n"] == 1


def test_running_balance_and_counters(spark):
    df = rows(spark, [("a", 1.0), ("a", -3.0), ("b", 2.0)])
    assert [r["balance"] for r in acc.running_balance(df, ["key"], "_seq", "value").orderBy("_seq").collect()] == [1.0, -2.0, 2.0]
    assert {r["key"]: r["counters"] for r in acc.counters(df, ["key"], "value").collect()}["b"] == {2.0: 1}


def test_time_windows_lose_no_row_whose_time_lies_before_its_period(spark):
    df = finite(spark, [(float(t),) for t in (10, 8, 12, 21, 22)], "t double")
    out = acc.reduce(n=Agg.count()).emit_within(10).apply(df, "_seq", "t")
    assert sorted(r["n"] for r in out.collect()) == [1, 4]


@pytest.mark.parametrize("chain_rows", [4_000_000, 60])
def test_time_windows_match_simulator_out_of_order(spark, monkeypatch, chain_rows):
    from tributary.operators import fold

    monkeypatch.setattr(fold, "CHAIN_ROWS", chain_rows)
    rng = random.Random(11)
    for _ in range(2):
        t, data = 0.0, []
        for i in range(300):
            t += rng.choice([0.1, 1.0, 30.0, -15.0])
            data.append((t, f"k{i % 3}"))
        want, opened, group = [], None, []
        for i, (x, _) in enumerate(data, 1):
            opened = x if opened is None else opened
            group.append(i)
            if x - opened >= 10:
                want.append(group)
                opened, group = None, []
        want += [group] if group else []
        df = finite(spark, data, "t double, key string")
        got = acc.in_periods(df, "_seq", "t", 10)
        assert sorted((r["_seq"], r["_period"]) for r in got.collect()) == sorted((i, g[0]) for g in want for i in g)
        spans = [(r["_first"], r["_last"]) for r in acc.periods(df, "_seq", "t", 10).collect()]
        assert sorted(spans) == sorted((g[0], g[-1] if n < len(want) - 1 or data[g[-1] - 1][0] - data[g[0] - 1][0] >= 10 else None) for n, g in enumerate(want))


def test_ordered_folds_keep_large_numbers_and_nulls(spark):
    big = 2**53
    df = finite(spark, [(None, 1), (big, 2), (big + 1, None), (None, 3), (big, 4)], "k long, v long")
    out = acc.custom(df, lambda: None, lambda s, r: (r["k"], [*(s[1] if s else []), r["v"]]), lambda s: [{"k": s[0], "vs": s[1]}], "k long, vs array<long>", keys=["k"])
    assert sorted(((r["k"] or 0), r["vs"]) for r in out.collect()) == [(0, [1, 3]), (big, [2, 4]), (big + 1, [None])]
    whole = acc.custom(df, lambda: [], lambda s, r: [*s, r["k"]], lambda s: [{"ks": s}], "ks array<long>")
    assert whole.first()["ks"] == [None, big, big + 1, None, big]


def test_global_folds_hand_their_state_on(spark, monkeypatch):
    from tributary.operators import fold

    rng = random.Random(12)
    data = [(f"k{rng.randrange(9)}", float(rng.randrange(50))) for _ in range(500)]
    want = simulate_top_n(data, 4)
    monkeypatch.setattr(fold, "CHAIN_ROWS", 50)
    out = acc.top_n(4, "key", "value").apply(rows(spark, data).repartition(7)).first()
    assert [(x["key"], x["score"]) for x in out["top_n"]] == want
    every = acc.custom(rows(spark, data).repartition(7), lambda: 0, lambda s, r: s + 1, lambda s: [{"n": s}], "n long", EveryN(100))
    assert sorted(r["n"] for r in every.collect()) == [100, 200, 300, 400, 500, 500]
