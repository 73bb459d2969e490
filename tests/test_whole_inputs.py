"""Registered queries against SQL over the whole of their tables."""

from __future__ import annotations

import duckdb
import pytest

from loomwright.operators import narrative
from loomwright.plans.catalog import QUERIES

SF = "/root/testdata/sf0.01"
WHOLE = {
    "left_enrich": """
WITH k AS (SELECT DISTINCT o_custkey AS a, l_suppkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT c.c_custkey AS id, min(b) AS first_supplier, count(b) AS suppliers FROM customer c LEFT JOIN k ON k.a = c.c_custkey GROUP BY ALL""",
    "payload_merge": """
WITH p AS (SELECT 'c' || c_custkey AS name, c_acctbal AS v FROM customer), s AS (SELECT 'C' || s_suppkey AS name, s_acctbal AS v FROM supplier)
SELECT coalesce(p.name, s.name) AS name, coalesce(p.v, s.v) AS v FROM s FULL OUTER JOIN p ON lower(s.name) = lower(p.name)""",
    "range_join_mentions": """
WITH r AS (SELECT c_custkey AS id, c_custkey * 3 AS lo, c_custkey * 3 + 40 AS hi FROM customer)
SELECT id, event_id, row_number() OVER (PARTITION BY id ORDER BY value DESC, event_id) AS ord FROM events JOIN r ON event_id BETWEEN lo AND hi""",
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_against_sql_over_whole_tables(spark, name):
    con = duckdb.connect()
    for t in ("customer", "supplier", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(WHOLE[name])
    want = sorted(map(repr, rel.fetchall()))
    got = sorted(repr(tuple(r)) for r in QUERIES[name](spark, SF).select(*rel.columns).collect())
    assert len(want) > 0 and got == want


def test_ranges_meet_mentions_by_bucket(spark):
    spots = [("a", k, 0.5, "x") for k in (-70, -1, 0, 63, 64, 65, 300, None)] + [("b", 5, 0.5, "y"), (None, 5, 0.5, "z")]
    spans = [("a", 1, -100, 64), ("a", 2, 64, 64), ("a", 3, 0, 2**31 - 1), ("a", 4, 9, 3), ("a", 5, None, 3), ("b", 6, 0, 500), ("c", 7, 0, 500)]
    m = spark.createDataFrame(spots, "book_id string, chapter_index int, confidence double, text string")
    r = spark.createDataFrame(spans, "book_id string, arc int, start_chapter int, end_chapter int")
    out = narrative.in_chapters(m, r, "arc")
    got = sorted((x["book_id"], x["arc"], x["chapter_index"], x["ord"]) for x in out.collect())
    want = []
    for book, arc, lo, hi in spans:
        inside = sorted(c for b, c, _, _ in spots if b == book and None not in (c, lo) and lo <= c <= hi)
        want += [(book, arc, c, n) for n, c in enumerate(inside, 1)]
    assert got == sorted(want) and out.columns == ["book_id", "chapter_index", "confidence", "text", "arc", "start_chapter", "end_chapter", "ord"]
    assert "_bucket" in out._jdf.queryExecution().optimizedPlan().toString()
