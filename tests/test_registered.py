"""Registered queries beside their SQL twin on the smallest tables; the whole list runs in check_oracle.py."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import norm

SAMPLE = ["pii_hits_masked", "thread_replies", "takeoff_by_document", "form_fdf", "page_ranges", "merge_documents", "booklet_order",
          "search_exact", "paragraphs", "reading_order", "document_margins", "recognised_values", "page_pairs", "gesture_steps",
          "permissions", "decoded_texts", "edit_sessions"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "kind", "hits"] and df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, data, name):
    con = duckdb.connect()
    for file in os.listdir(data):
        con.sql(f"create view {file.removesuffix('.parquet')} as select * from '{data}/{file}'")
    relation = con.sql(entry.oracle_sql()[name])
    columns = sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    want = [tuple(norm(r[i]) for i in at) for r in relation.fetchall()]
    frame = entry.queries()[name](spark, data)
    assert sorted(frame.columns) == columns
    got = [tuple(norm(r[c]) for c in columns) for r in frame.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and got
