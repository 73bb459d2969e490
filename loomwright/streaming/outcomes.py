"""Work over a stream with retries and dead letters, each row ending once whatever is killed and run again.

A batch is tried up to ``attempts`` times; each try writes its outcomes into a folder named by batch and attempt, and the
next one reads what is to be tried again from there. After a crash the stream replays the same rows as the same batch: tries that
were written whole are taken as they are, the one that was cut off is done and written anew. So the work may be called twice for
a row, but its outcome is there once.

Defined cases: ``work`` gives each row an ``error`` (null: done) and, where it likes, ``final`` (true: not to be tried
again); other columns are its own. A stream without rows has no outcomes. Outcomes and the stream's checkpoint live in one folder,
to be deleted together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import exists

Work = Callable[[DataFrame, int], DataFrame]


def tried(rows: DataFrame, work: Work, attempt: int, attempts: int) -> DataFrame:
    """One try: ``work``'s rows with ``outcome`` done, retry or dead."""
    out = work(rows, attempt)
    over = F.coalesce(F.col("final"), F.lit(False)) if "final" in out.columns else F.lit(False)
    return out.withColumn("outcome", F.when(F.col("error").isNull(), "done").when(over | F.lit(attempt >= attempts), "dead").otherwise("retry"))


def batches(work: Work, folder: str, attempts: int = 3) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls."""

    def run(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        names = rows.columns
        for attempt in range(1, attempts + 1):
            path = f"{folder}/outcomes/batch={batch}/attempt={attempt}"
            if not exists(spark, f"{path}/_SUCCESS"):
                tried(rows, work, attempt, attempts).write.mode("overwrite").parquet(path)
            rows = spark.read.parquet(path).filter("outcome = 'retry'").select(*names)
            if rows.isEmpty():
                return

    return run


def run_once(stream: DataFrame, work: Work, folder: str, attempts: int = 3) -> DataFrame:
    """Works off what has arrived and stops; a later call goes on. Returns ``outcomes``."""
    query = stream.writeStream.foreachBatch(batches(work, folder, attempts)).option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    empty = tried(stream.sparkSession.createDataFrame([], stream.schema), work, 1, attempts)
    return outcomes(empty, folder)


def outcomes(empty: DataFrame, folder: str) -> DataFrame:
    """Each row's last outcome (done or dead) with ``batch`` and ``attempt``; ``empty`` has the columns of a try."""
    spark: SparkSession = empty.sparkSession
    if not exists(spark, f"{folder}/outcomes"):
        return empty.withColumns({"batch": F.lit(0), "attempt": F.lit(0)})
    return spark.read.parquet(f"{folder}/outcomes").filter("outcome <> 'retry'")
