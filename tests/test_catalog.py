"""Every registered SQL is that of a query and can be planned; some queries are run against it."""

from __future__ import annotations

import duckdb
import pytest

from loomwright.plans import catalog, catalog_books, catalog_flows

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
RUN = ("scan_characters", "frequent_names", "entity_importance", "split_chapters", "relation_edges", "antecedents", "arc_segments", "fused_characters", "resolved_names", "connected_names", "aggressive_cleaning", "scan_events", "cleaned_descriptions", "decoded_files", "stage_feed", "task_outcomes", "mention_files", "asset_files", "replaced_books", "graph_files")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_sql_belongs_to_queries_and_plans(con):
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) and len(catalog.ORACLE_SQL) > 170 and catalog_books.NAMES and catalog_flows.WEIGHTS
    for sql in catalog.ORACLE_SQL.values():
        con.execute(f"EXPLAIN {sql}")


def _rounded(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", RUN)
def test_against_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    rel = con.sql(catalog.ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in df.columns]
    got = sorted(repr([_rounded(v) for v in r]) for r in df.collect())
    assert len(got) > 0 and got == sorted(repr([_rounded(r[k]) for k in at]) for r in rel.fetchall())
