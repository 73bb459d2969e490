"""Progress of stages as a stream: status events keep, for each book and stage, the last status, and give the book's progress.

Watermarks and windows here are additions; the model itself only has progress events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "book_id string, stage string, status string, ts timestamp"
WEIGHTS = {"extractor": 25, "validator": 10, "resolution": 15, "description": 15, "visual": 15, "prompt": 10, "reviewer": 10}


def stream(spark: SparkSession, path: str, schema: str = EVENTS, files_per_trigger: int = 100) -> DataFrame:
    """Status events from JSON files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def last_status(events: DataFrame) -> DataFrame:
    """``book_id, stage, status, ts``: the latest event of each stage (a stateful aggregate on a stream)."""
    last = events.groupBy("book_id", "stage").agg(F.max(F.struct("ts", "status")).alias("l"))
    return last.select("book_id", "stage", F.col("l.status").alias("status"), F.col("l.ts").alias("ts"))


def progress(events: DataFrame, weights: dict[str, int] = WEIGHTS) -> DataFrame:
    """Progress of each book, in one stateful aggregate: a map with the latest status of each of the (fixed) stages."""
    stages = list(weights)
    last = [F.max(F.when(F.col("stage") == s, F.struct("ts", "status"))).alias(f"l_{s}") for s in stages]
    rows = events.groupBy("book_id").agg(*last)
    status = lambda s: F.coalesce(F.col(f"l_{s}.status"), F.lit("PENDING"))
    total = sum((F.when(status(s) == "COMPLETED", float(w)).when(status(s) == "RUNNING", w / 2).otherwise(0.0) for s, w in weights.items()), F.lit(0.0))
    failed = sum((status(s).isin("FAILED", "DEAD").cast("int") for s in stages), F.lit(0)) > 0
    return rows.select("book_id", total.alias("progress"), failed.alias("failed"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Events by window and status; events later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "complete"):
    """Runs what has arrived into a memory table and stops; a later call goes on from the checkpoint."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
