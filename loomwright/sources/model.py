"""A model as a source of candidate rows: pluggable, table-backed by default, with salvage of JSON from its answers."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept


def salvaged(text: str | None) -> str | None:
    """The JSON in an answer: thinking blocks go, a fenced block is preferred, else the first balanced object or array; none where brackets of different kinds meet."""
    if not text:
        return None
    text = re.sub(r"(?s)<think(?:ing)?>.*?</think(?:ing)?>", "", text)
    fenced = re.search(r"(?s)```(?:json)?\s*(.*?)```", text)
    if fenced:
        text = fenced.group(1)
    start = re.search(r"[{\[]", text)
    if not start:
        return None
    open_: list[str] = []
    quoted = escaped = False
    for i in range(start.start(), len(text)):
        c = text[i]
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]":
            if open_.pop() != c:
                return None
            if not open_:
                return text[start.start() : i + 1]
    return None


def salvaged_json(c: Column) -> Column:
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([salvaged(t) for t in b.to_pylist()], pa.string())

    return run(c)


def parsed(answers: DataFrame, schema: str, out: str = "parsed") -> DataFrame:
    """Answers (``answer``) parsed by a schema; what doesn't fit is null."""
    return answers.withColumn(out, F.from_json(salvaged_json(F.col("answer")), schema, {"mode": "PERMISSIVE"}))


class TableModel:
    """Answers by prompt from a fixed table: the default, so that every result can be reproduced."""

    def __init__(self, answers: dict[str, str], otherwise: str = "{}") -> None:
        self.answers, self.otherwise = answers, otherwise

    def __call__(self, system: str, user: str) -> str:
        return self.answers.get(user, self.otherwise)


class Retried:
    """Calls again with growing pauses; errors named as final are raised at once. Keys go round, one that fails thrice rests."""

    def __init__(self, call: Callable[..., str], keys: tuple[str, ...] = ("",), times: int = 3, pause: float = 1.0, longest: float = 30.0, rest: float = 60.0, final: tuple[type, ...] = (ValueError,), sleep: Callable[[float], None] = time.sleep) -> None:
        self.call, self.keys, self.times, self.pause, self.longest, self.rest, self.final, self.sleep = call, keys, times, pause, longest, rest, final, sleep
        self.failures, self.until, self.next = dict.fromkeys(keys, 0), dict.fromkeys(keys, 0.0), 0

    def _key(self) -> str:
        for _ in self.keys:
            key = self.keys[self.next % len(self.keys)]
            self.next += 1
            if self.until[key] <= time.monotonic():
                return key
        return min(self.keys, key=self.until.__getitem__)

    def __call__(self, system: str, user: str) -> str:
        for turn in range(self.times + 1):
            key = self._key()
            try:
                out = self.call(system, user, key) if key else self.call(system, user)
                self.failures[key] = 0
                return out
            except self.final:
                raise
            except Exception:
                self.failures[key] += 1
                if self.failures[key] >= 3:
                    self.failures[key], self.until[key] = 0, time.monotonic() + self.rest
                if turn == self.times:
                    raise
                self.sleep(min(self.longest, self.pause * 2**turn))
        raise AssertionError("unreachable")


def asked(prompts: DataFrame, model: Callable[[str, str], str], parallel: int | None = None) -> DataFrame:
    """``prompts`` (``prompt_id, system, user``) with ``answer`` and ``error``: a failed call is a row, for a second pass."""
    if parallel:
        prompts = prompts.repartition(parallel)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, systems, users = (c.to_pylist() for c in b.columns)
            out = []
            for s, u in zip(systems, users, strict=True):
                try:
                    out.append((model(s or "", u or ""), None))
                except Exception as e:  # noqa: BLE001  the call is external
                    out.append((None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], names=["prompt_id", "answer", "error"])

    return prompts.select(F.col("prompt_id").cast("string"), "system", "user").mapInArrow(run, "prompt_id string, answer string, error string")


def budget_groups(rows: DataFrame, size_col: str, budget: int = 24_000, most: int = 50, keys: tuple[str, ...] = ("book_id",)) -> DataFrame:
    """Adds ``group``: rows in order of ``seq`` (unique within a key) fill a group until the budget of characters or rows is spent; a larger row stands alone.

    Where a group that starts at a row ends, running sums tell for every row at once (nulls count 0): the last row whose sum is
    within the budget, found by sorting sums and bounds together. Starts are then the rows on the way of these jumps from a
    key's first row. The way is walked by doubling: each turn the rows known so far add those a power of two of jumps behind
    them, so there are as many turns as the number of groups of a key has binary digits. Each turn's tables are checkpointed.
    """
    names = list(keys)
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*names).orderBy("seq")).cast("long"))
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    sums = kept(numbered.select(*names, "_n", size.alias("_s"), F.sum(size).over(Window.partitionBy(*names).orderBy("_n")).alias("_c")))
    bounds = sums.select(*names, (F.col("_c") - F.col("_s") + budget).alias("_v"), F.lit(1).alias("_k"), F.col("_n").alias("_from"), F.lit(None).cast("long").alias("_at"))
    places = sums.select(*names, F.col("_c").alias("_v"), F.lit(0).alias("_k"), F.lit(None).cast("long").alias("_from"), F.col("_n").alias("_at"))
    last = F.max("_at").over(Window.partitionBy(*names).orderBy("_v", "_k").rowsBetween(Window.unboundedPreceding, 0))
    found = bounds.unionByName(places).withColumn("_last", last).filter("_k = 1")
    to = F.least(F.greatest(F.coalesce("_last", F.lit(0)) + 1, F.col("_from") + 1), F.col("_from") + most)
    jumps = kept(found.select(*names, F.col("_from").alias("_n"), to.alias("_to")))
    starts = jumps.filter("_n = 1").select(*names, "_n")
    while True:
        ahead = jumps.join(starts, [*names, "_n"]).select(*names, F.col("_to").alias("_n")).join(sums.select(*names, "_n"), [*names, "_n"], "left_semi")
        if ahead.isEmpty():
            break
        starts = kept(starts.unionByName(ahead).distinct())
        onward = jumps.select(*names, F.col("_n").alias("_to"), F.col("_to").alias("_next"))
        jumps = kept(jumps.join(onward, [*names, "_to"]).select(*names, "_n", F.col("_next").alias("_to")))
    marked = numbered.join(starts.withColumn("_start", F.lit(1)), [*names, "_n"], "left")
    group = F.count("_start").over(Window.partitionBy(*names).orderBy("_n")) - 1
    return marked.withColumn("group", group.cast("int")).select(*rows.columns, "group")


def mock_answer() -> str:
    """A fixed answer for tests."""
    return json.dumps({"characters": [{"name": n} for n in ("Ann", "Bob", "Cid", "Dora", "Eve")], "items": [{"name": "lamp"}, {"name": "sword"}]})
