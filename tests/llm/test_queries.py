"""The registered queries of this subpackage against SQL or brute force on the smallest tables."""

import hashlib
import os
import re

import duckdb
import pytest

from lodestack.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, FOLDER).toPandas(), con.execute(queries.ORACLES[name]).fetchdf()
    rows = lambda df: sorted(map(str, df[sorted(want.columns)].astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_secret_query_by_the_patterns(spark):
    kinds = {"assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op10_secret_scan(spark, FOLDER).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        found = []
        for n, (kind, pattern) in enumerate(kinds.items()):
            for m in re.finditer(pattern, text, re.ASCII | (re.IGNORECASE if kind == "assign" else 0)):
                if len(m[2] if kind == "assign" else m[0]) >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                    found.append((m.start(), n, kind, m.end()))
        want = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(f[2] == k for f in found) for k in kinds)


def test_row_counts(spark):
    docs, pages = (spark.read.parquet(f"{FOLDER}/{t}.parquet").count() for t in ("documents", "pages"))
    for name in ("op1_weighted_sampling", "op3_simhash", "op8_quality", "op9_mixing"):
        assert queries.QUERIES[name](spark, FOLDER).count() == docs
    assert queries.op4_html_extract(spark, FOLDER).count() == pages
