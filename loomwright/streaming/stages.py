"""Feed of a book's stages: a snapshot first, then changes, heartbeats in silence, and an end after which nothing comes.

Each book's state is the latest status of each of the (fixed) stages; timers are in event time, so a replay of the same
batches gives the same feed.

Defined cases: of a stage's events the latest counts, of equally late ones the greatest status; an event without book,
stage or time is left out, an unknown stage weighs nothing. A book ends when every stage is completed or one is dead; its
state is then one flag, and later events of it are ignored. A batch gives a book at most one row, whatever came in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from .progress import WEIGHTS

FEED = "book_id string, kind string, progress double, failed boolean, ms long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StageFeed(StatefulProcessor):
    """``kind`` is snapshot, change, heartbeat or end; ``ms`` the time of the book's latest event (of a heartbeat: when it was due)."""

    def __init__(self, weights: dict[str, int], heartbeat_ms: int):
        self.weights, self.heartbeat_ms = weights, heartbeat_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "stage string", "ms long, status string")
        self.ended = handle.getValueState("ended", "ended boolean")

    def _row(self, book: str, kind: str, told: dict[str, tuple[int, str]], ms: int) -> Row:
        status = {s: told[s][1] if s in told else "PENDING" for s in self.weights}
        done = sum(w if status[s] == "COMPLETED" else w / 2 if status[s] == "RUNNING" else 0 for s, w in self.weights.items())
        return Row(book_id=book, kind=kind, progress=float(done), failed=any(x in ("FAILED", "DEAD") for x in status.values()), ms=ms)

    def _told(self) -> dict[str, tuple[int, str]]:
        return {k[0]: (v[0], v[1]) for k, v in self.last.iterator()}

    def _beat(self, after: int) -> None:
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.handle.registerTimer(after + self.heartbeat_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        if self.ended.exists():
            return
        before = self._told()
        told = dict(before)
        for r in rows:
            told[r["stage"]] = max(told.get(r["stage"], (r["ms"], r["status"])), (r["ms"], r["status"]))
        for stage in told:
            if told[stage] != before.get(stage):
                self.last.updateValue((stage,), told[stage])
        status = [told[s][1] if s in told else None for s in self.weights]
        ms = max(t for t, _ in told.values())
        if "DEAD" in status or all(x == "COMPLETED" for x in status):
            self.last.clear()
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            self.ended.update((True,))
            yield self._row(key[0], "end", told, ms)
            return
        if told != before:
            self._beat(ms)
            yield self._row(key[0], "change" if before else "snapshot", told, ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.heartbeat_ms)
        yield self._row(key[0], "heartbeat", self._told(), due)

    def close(self) -> None:
        pass


def feed(events: DataFrame, weights: dict[str, int] = WEIGHTS, heartbeat_ms: int = 15_000, late: str = "10 seconds") -> DataFrame:
    """``book_id, kind, progress, failed, ts`` of a stream ``book_id, stage, status, ts``; events later than ``late`` are dropped."""
    rows = events.filter("book_id is not null and stage is not null and ts is not null")
    rows = rows.withWatermark("ts", late).select(F.col("book_id").cast("string").alias("book_id"), "stage", F.coalesce("status", F.lit("PENDING")).alias("status"), F.unix_millis("ts").alias("ms"), "ts")
    out = rows.groupBy("book_id").transformWithState(statefulProcessor=StageFeed(weights, heartbeat_ms), outputStructType=FEED, outputMode="Append", timeMode="EventTime")
    return out.select("book_id", "kind", "progress", "failed", F.timestamp_millis("ms").alias("ts"))


def started(out: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs what has arrived into Parquet files and stops; a later call goes on from the checkpoint. State is kept in RocksDB, as timers ask for."""
    spark: SparkSession = out.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    former = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        return out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, former)

