"""Registered queries that run streams, or write files and read them back, all in new folders of the shared one.

Those folders stay: the DataFrames returned read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relations
from ..session import new_folder
from ..sources import exports, tables, text_files
from ..streaming import outcomes, stages
from .catalog import _EDGES, _edges, _t, query

WEIGHTS = {"click": 25, "view": 10, "purchase": 15}
_STATUS = "CASE event_id % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'RUNNING' ELSE 'FAILED' END"


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream; a path with a pattern may name a file as well as a folder."""
    return spark.readStream.schema(_t(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


@query(f"""
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS book_id, event_type AS stage, {_STATUS} AS status, date_trunc('millisecond', ts) AS ts FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL),
l AS (SELECT book_id, stage, status FROM e QUALIFY row_number() OVER (PARTITION BY book_id, stage ORDER BY ts DESC, status DESC) = 1),
w(stage, w) AS (VALUES {', '.join(f"('{s}', {w})" for s, w in WEIGHTS.items())}),
b AS (
  SELECT book_id, coalesce(sum(CASE status WHEN 'COMPLETED' THEN w WHEN 'RUNNING' THEN w / 2.0 ELSE 0 END), 0)::DOUBLE AS progress,
         coalesce(bool_or(status = 'FAILED' AND w IS NOT NULL), false) AS failed, count(*) FILTER (status = 'COMPLETED' AND w IS NOT NULL) = {len(WEIGHTS)} AS ended
  FROM l LEFT JOIN w USING (stage) GROUP BY book_id),
t AS (SELECT book_id, max(ts) AS ts FROM e GROUP BY book_id)
SELECT book_id, CASE WHEN ended THEN 'end' ELSE 'snapshot' END AS kind, progress, failed, ts FROM b JOIN t USING (book_id)
UNION ALL
SELECT book_id, 'heartbeat', progress, failed, ts + INTERVAL 2 HOUR FROM b JOIN t USING (book_id) WHERE NOT ended AND ts + INTERVAL 2 HOUR <= (SELECT max(ts) FROM e)""")
def stage_feed(spark, sf):
    """All events as one batch of the feed: a snapshot or an end for each book, and heartbeats of those silent for two hours."""
    k = F.col("event_id") % 3
    status = F.when(k == 0, "COMPLETED").when(k == 1, "RUNNING").otherwise("FAILED")
    rows = _stream(spark, sf, "events").select(F.col("user_id").alias("book_id"), F.col("event_type").alias("stage"), status.alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    out = stages.feed(rows, WEIGHTS, heartbeat_ms=2 * 3_600_000, late="0 seconds")
    folder = new_folder(spark, "feed")
    stages.started(out, f"{folder}/rows", f"{folder}/stream").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""
WITH t AS (SELECT event_id AS id, event_id % 4 AS k, event_id % 21 = 5 AS final FROM events)
SELECT id, CASE WHEN k = 0 THEN 'done' WHEN final OR k = 3 THEN 'dead' ELSE 'done' END AS outcome,
       CASE WHEN k = 0 OR final THEN 1 WHEN k = 3 THEN 3 ELSE k + 1 END AS attempt FROM t""")
def task_outcomes(spark, sf):
    """Tasks of which some succeed at the second or third try, some never, and some must not be tried again."""
    tasks = _stream(spark, sf, "events").select(F.col("event_id").alias("id"))

    def work(rows: DataFrame, attempt: int) -> DataFrame:
        return rows.withColumns({"error": F.when(F.col("id") % 4 >= attempt, F.lit("busy")), "final": F.col("id") % 21 == 5})

    return outcomes.run_once(tasks, work, new_folder(spark, "tasks")).select("id", "outcome", "attempt")


@query("""
SELECT o_custkey % 25 AS book_id, 'item' AS type, o_orderkey % 50 AS chapter_index, 'n|' || o_custkey % 10 AS text, 'regex' AS source, CAST(arg_min(o_orderkey % 4, o_orderkey) / 4.0 AS DOUBLE) AS confidence
FROM orders GROUP BY o_custkey % 25, o_orderkey % 50, o_custkey % 10""")
def mention_files(spark, sf):
    """Mentions written as pipe-separated files, a folder a book and type, and read back; names hold the separator."""
    k = F.col("o_orderkey")
    m = _t(spark, sf, "orders").select((F.col("o_custkey") % 25).alias("book_id"), F.lit("item").alias("type"), (k % 50).cast("int").alias("chapter_index"), F.concat(F.lit("n|"), (F.col("o_custkey") % 10).cast("string")).alias("text"), k.alias("position"), F.lit("regex").alias("source"), ((k % 4) / 4.0).alias("confidence"))
    path = f"{new_folder(spark, 'mentions')}/m"
    text_files.write_mentions(m, path)
    return text_files.read_mentions(spark, path).select("book_id", "type", "chapter_index", "text", "source", "confidence")


@query("""SELECT o_orderpriority AS story_id, o_orderkey AS id, o_orderstatus AS status, CAST(o_totalprice AS DOUBLE) AS total FROM orders""")
def asset_files(spark, sf):
    """Assets written as JSON, a folder a story, and read back."""
    rows = _t(spark, sf, "orders").select(F.col("o_orderpriority").alias("story_id"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("total"))
    path = new_folder(spark, "assets")
    exports.write_assets(rows, path)
    return exports.read_assets(spark, path, "story_id string, id long, status string, total double")


@query("""
SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS book_id FROM orders WHERE o_orderpriority NOT IN (SELECT o_orderpriority FROM orders WHERE o_orderpriority < '3')
UNION ALL SELECT -o_orderkey, 'new', o_orderpriority FROM orders WHERE o_orderpriority < '3' AND o_orderstatus = 'F'""")
def replaced_books(spark, sf):
    """Some books' rows deleted and written anew, the other books' files left as they are."""
    rows = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("book_id"))
    path = new_folder(spark, "books")
    tables.replace_books(rows, path)
    tables.replace_books(rows.filter("book_id < '3' and status = 'F'").select((-F.col("id")).alias("id"), F.lit("new").alias("status"), "book_id"), path)
    return spark.read.schema("id long, status string, book_id string").parquet(path)


@query(f"""WITH {_EDGES} SELECT 'edge' AS part, source AS id, target, type, confidence, CAST(chapter_first AS BIGINT) AS chapter_first FROM e
UNION ALL SELECT 'node', 'c' || c_custkey, c_name, NULL, NULL, NULL FROM customer""")
def graph_files(spark, sf):
    """A graph's edges and nodes written as JSON lines and read back; a node's name stands in ``target``."""
    nodes = _t(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"))
    path = new_folder(spark, "graph")
    relations.write_graph(_edges(spark, sf), nodes, path)
    e, n = relations.read_graph(spark, path, "id string, name string", "source string, target string, type string, confidence double, chapter_first long")
    edges = e.select(F.lit("edge").alias("part"), F.col("source").alias("id"), "target", "type", "confidence", "chapter_first")
    none = lambda t: F.lit(None).cast(t)
    return edges.unionByName(n.select(F.lit("node").alias("part"), "id", F.col("name").alias("target"), none("string").alias("type"), none("double").alias("confidence"), none("long").alias("chapter_first")))
