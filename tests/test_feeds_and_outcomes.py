import json

import pytest
from pyspark.sql import functions as F

from loomwright.streaming import outcomes, progress, stages

W = {"a": 60, "b": 40}


def put(folder, name, *events):
    (folder / name).write_text("\n".join(json.dumps({"book_id": b, "stage": s, "status": x, "ts": f"2024-01-01T00:{m:02}:00Z"}) for b, s, x, m in events))


def test_feed_over_batches_and_a_restart(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    seen = set()

    def more():
        out = stages.feed(progress.stream(spark, str(src)), W, heartbeat_ms=120_000, late="0 seconds")
        stages.started(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        rows = {(r["book_id"], r["kind"], r["progress"], r["failed"], r["ts"].minute) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()}
        new = rows - seen
        seen.update(rows)
        return new

    put(src, "1.json", ("x", "a", "RUNNING", 1), ("x", "b", "FAILED", 1), ("y", "a", "COMPLETED", 1))
    assert more() == {("x", "snapshot", 30.0, True, 1), ("y", "snapshot", 60.0, False, 1)}
    put(src, "2.json", ("x", "b", "RUNNING", 2), ("y", "b", "COMPLETED", 2))  # another query, from the checkpoint
    assert more() == {("x", "change", 50.0, False, 2), ("y", "end", 100.0, False, 2)}
    put(src, "3.json", ("y", "a", "RUNNING", 9), ("z", "b", "DEAD", 9))  # y has ended; x has been silent until its timer
    assert more() == {("x", "heartbeat", 50.0, False, 4), ("z", "end", 0.0, True, 9)}


def test_outcomes_survive_a_kill(spark, tmp_path):
    src, folder = tmp_path / "in", str(tmp_path / "work")
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"id": i}) for i in range(40)))
    stream = lambda: spark.readStream.schema("id long").json(str(src))
    calls = []

    def work(rows, attempt):
        calls.append(attempt)
        return rows.withColumns({"error": F.when(F.col("id") % 4 >= attempt, F.lit("busy")), "final": F.col("id") % 20 == 7})

    def killed(rows, attempt):
        if attempt == 2:
            raise RuntimeError("killed")
        return work(rows, attempt)

    with pytest.raises(Exception, match="killed"):
        outcomes.run_once(stream(), killed, folder)
    assert calls == [1]
    told = {r["id"]: (r["outcome"], r["attempt"]) for r in outcomes.run_once(stream(), work, folder).collect()}
    want = {i: ("dead", 1) if i % 20 == 7 else ("dead", 3) if i % 4 == 3 else ("done", i % 4 + 1) for i in range(40)}
    assert told == want and calls[:3] == [1, 2, 3]  # the first try was not done again
    (src / "2.json").write_text(json.dumps({"id": 100}))
    rows = outcomes.run_once(stream(), work, folder)
    assert rows.count() == 41 and rows.filter("id = 100").first()["batch"] == 1


def test_no_rows_no_outcomes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = outcomes.run_once(spark.readStream.schema("id long").json(str(tmp_path / "in")), lambda rows, attempt: rows.withColumn("error", F.lit(None).cast("string")), str(tmp_path / "w"))
    assert out.count() == 0 and {"outcome", "batch", "attempt"} <= set(out.columns)
