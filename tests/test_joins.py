import pytest

from tributary.operators import join as joins
from tributary.operators.join import JoinBuilder
from tributary.sources.functional import finite


def ref(spark, rows):
    return finite(spark, rows, "seq long, k string, v string").drop("_seq")


def stream(spark, rows):
    return finite(spark, rows, "seq long, k string").drop("_seq")


EXPRS = {"seq": "stream.seq", "v": "ref.v"}


def test_last_write_wins_and_never_adds_rows(spark):
    out = joins.inner(ref(spark, [(1, "k", "old"), (2, "k", "new")]), stream(spark, [(3, "k")]), "k", "k", "seq", EXPRS)
    assert [tuple(r) for r in out.collect()] == [(3, "new")]


def test_left_preserves_the_stream(spark):
    out = joins.left(ref(spark, [(1, "a", "x")]), stream(spark, [(2, "a"), (3, "b"), (4, None)]), "k", "k", "seq", EXPRS)
    assert sorted(map(tuple, out.collect())) == [(2, "x"), (3, None), (4, None)]


def test_strict_cuts_at_the_first_miss(spark):
    out = joins.strict(ref(spark, [(1, "a", "x")]), stream(spark, [(1, "a"), (2, "b"), (3, "a")]), "k", "k", "seq", "seq", EXPRS)
    assert [tuple(r) for r in out.rows.collect()] == [(1, "x")] and out.status == "poison"


def test_strict_without_a_miss_is_natural(spark):
    out = joins.strict(ref(spark, [(1, "a", "x")]), stream(spark, [(1, "a")]), "k", "k", "seq", "seq", EXPRS)
    assert out.rows.count() == 1 and out.status == "natural"


def test_strict_raise_mode(spark):
    out = joins.strict(ref(spark, [(1, "a", "x")]), stream(spark, [(1, "a"), (2, "b")]), "k", "k", "seq", "seq", EXPRS, mode="raise")
    with pytest.raises(Exception, match="a strict join missed"):
        out.rows.collect()


LIVE_REF, LIVE_STREAM = [(2, "k", "A"), (4, "k", "B")], [(1, "k"), (3, "k"), (5, "k")]


def test_live_joins_see_the_catalogue_as_it_was(spark):
    r, s = ref(spark, LIVE_REF), stream(spark, LIVE_STREAM)
    assert sorted(map(tuple, joins.inner_live(r, s, "k", "k", "seq", "seq", EXPRS).collect())) == [(3, "A"), (5, "B")]
    assert sorted(map(tuple, joins.left_live(r, s, "k", "k", "seq", "seq", EXPRS).collect())) == [(1, None), (3, "A"), (5, "B")]
    assert joins.strict_live(r, s, "k", "k", "seq", "seq", EXPRS).rows.count() == 0


def test_builder(spark):
    built = JoinBuilder("inner").with_reference(ref(spark, LIVE_REF)).catalog_key("k").stream_key("k").ordered_by("seq").project(EXPRS)
    assert sorted(map(tuple, built.join(stream(spark, LIVE_STREAM)).collect())) == [(1, "B"), (3, "B"), (5, "B")]
    assert sorted(map(tuple, built.live().join(stream(spark, LIVE_STREAM)).collect())) == [(3, "A"), (5, "B")]
    with pytest.raises(ValueError):
        JoinBuilder("full")


def test_multi_key_keeps_the_order_of_keys(spark):
    s = finite(spark, [(1, ["b", "a", "zz"]), (2, [])], "id long, ks array<string>").drop("_seq")
    out = joins.multi_key(ref(spark, [(1, "a", "x"), (2, "b", "y")]), s, "k", "ks", "seq", "id")
    assert {r["id"]: [x["v"] for x in r["refs"]] for r in out.collect()} == {1: ["y", "x"], 2: []}


def test_live_joins_of_hot_keys_are_the_plain_ones(spark):
    import random

    rng = random.Random(4)
    at = rng.sample(range(5000), 1200)
    ref = spark.createDataFrame([(i, rng.choice(["hot", "hot", "a", None]), f"v{i}") for i in at[:400]], "o long, k string, v string")
    stream = spark.createDataFrame([(i, rng.choice(["hot"] * 4 + ["a", "b", None])) for i in at[400:]], "o long, k string")
    for how in (joins.inner_live, joins.left_live):
        exprs = {"o": "stream.o", "v": "ref.v"}
        rows = [sorted(map(tuple, how(ref, stream.repartition(5), "k", "k", "o", "o", exprs, hot_keys=hot).collect()), key=repr) for hot in (False, True)]
        assert rows[0] == rows[1] and rows[0]
