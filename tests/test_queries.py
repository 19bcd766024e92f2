"""Every query with SQL, against DuckDB on the smallest tables; the entry point and its guard."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tributary.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, oracle, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = oracle.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize(("first", "kind"), [(0, "bigint"), (2**53, "decimal(38,0)")])
def test_sums_of_journal_reads_that_a_long_does_not_hold(spark, tmp_path, first, kind):
    """The SQL itself fails there; without its last cast it gives what the query does."""
    db = duckdb.connect()
    db.execute(f"CREATE TABLE events AS SELECT {first} + i AS event_id, i % 9 AS user_id FROM range(400) t(i)")
    db.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    sql = f"SELECT read, n, ids FROM ({ORACLES['jr03_journal_reads']})"
    if first:
        with pytest.raises(duckdb.ConversionException):
            db.execute(sql).fetchall()
        sql = sql.replace("AS BIGINT", "AS HUGEINT")
    df = QUERIES["jr03_journal_reads"](spark, str(tmp_path))
    assert df.dtypes == [("read", "string"), ("n", "bigint"), ("ids", kind)]
    assert sorted((r["read"], r["n"], int(r["ids"])) for r in df.collect()) == sorted(db.execute(sql).fetchall())


def test_journal_reads_without_rows_have_no_sum(spark, tmp_path):
    duckdb.sql("SELECT i AS event_id, i AS user_id FROM range(2) t(i)").write_parquet(f"{tmp_path}/events.parquet")
    df = QUERIES["jr03_journal_reads"](spark, str(tmp_path))
    assert {r["read"]: (r["n"], r["ids"]) for r in df.collect()} == {"after": (0, None), "at": (0, None), "last": (2, 1), "by_id": (0, None), "causal": (2, 2)}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_does_not_import_the_corpus_operators():
    code = "import sys, tributary.queries, tributary.plans.flow, tributary.plans.composites, tributary.streaming.lowering, tributary.journal.effects; sys.exit(any('llm' in m for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent).returncode == 0
