"""Queries of the subpackage against their SQL, and very long texts."""

import hashlib
import os

import duckdb
import pytest

from tributary.llm import ORACLES, QUERIES
from tributary.llm import chat_format as chat
from tributary.llm import exact_dedup as exact
from tributary.llm import secret_scan, source_mix, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))


def test_very_long_texts_are_read_whole(spark, documents):
    text = "Word wörd " * 150_000 + "end"
    docs = documents((1, text), (2, text.upper().replace("Ö", "ö")), (3, text[:-1]))
    groups = {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in exact.exact_dedup(docs).collect()}
    assert groups[1] == groups[2] and groups[1][:2] == (2, 2) and groups[3][:2] == (3, 1)
    assert groups[1][2] == hashlib.sha256(text.replace("W", "w").encode()).hexdigest()

    kept = {r["doc_id"] for r in source_mix.take_mix(docs).collect()}
    assert kept == {1, 2, 3}
    sized = docs.select("doc_id", source_mix.word_count(docs["text"]).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in sized} == {1: 300_001, 2: 300_001, 3: 300_001}

    model = toxicity.Ordinal({"end": 5.0}, [1.0, 2.0, 3.0])
    assert {r["doc_id"]: r["severity"] > 1 for r in toxicity.grade(docs, model).collect()} == {1: True, 2: True, 3: False}

    secret = "x" * 1_000_000 + " password=hunter22 " + "y" * 1_000_000
    found = secret_scan.scan_secrets(documents((1, secret))).first()
    assert found["n_assign"] == 1 and found["spans"].startswith("assign:1000001:1000018")


def test_a_very_long_turn_is_formatted(spark):
    text = "</turn> \\ <turn>" * 100_000
    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    out = chat.chat_digests(rows).first()
    assert out["loss_chars"] == len(text) and out["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
