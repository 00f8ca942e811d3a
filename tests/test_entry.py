"""The driver's contract, and every registered query against its SQL in DuckDB on the smallest tables."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from lodestack.plans import queries as core

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple("" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.astype(object).itertuples(index=False))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(core.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = core.QUERIES[name](spark, FOLDER).toPandas(), duck.execute(core.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_stream_extract(spark):
    got = core.QUERIES["stream_extract"](spark, FOLDER)
    events = spark.read.parquet(f"{FOLDER}/events.parquet").where("event_id % 2 = 0").select("event_id", "user_id", "event_type")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, events.collect()))
