"""Registered queries with SQL against DuckDB, over whole tables; those without, for their columns and one row a document."""

import glob
import os

import duckdb
import pytest

from beamframe.llm import queries
from tests.llm.cases import same


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_is_its_sql(spark, sf_dir, tables, name):
    got, want = queries.QUERIES[name](spark, sf_dir), tables.sql(queries.ORACLE_SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    same([tuple(r[c] for c in order) for r in got.collect()], [tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall()])


@pytest.mark.parametrize("name", ["op8_token_files", "op9_quality_outliers"])
def test_one_row_a_document(spark, sf_dir, tables, name):
    got = queries.QUERIES[name](spark, sf_dir).select("doc_id").collect()
    same([tuple(r) for r in got], tables.sql("SELECT doc_id FROM documents").fetchall())


def test_languages_of_documents_that_were_not_learned_from(spark, sf_dir):
    import zlib

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op7_language_crf(spark, sf_dir).collect()}
    assert set(got) == set(docs)
    known = {d["lang"] for d in docs.values() if d["lang"]}
    right = held = 0
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in docs[i]["text"] or "")
        assert (r["lang_pred"] != "und") == letters and r["lang_pred"] in known | {"und"}
        if r["held_out"] and letters and docs[i]["lang"]:
            held, right = held + 1, right + (r["lang_pred"] == docs[i]["lang"])
    assert held and right >= 0.9 * held
