"""Many literal names at once: an automaton of all of them is built once, sent to the tasks, and walked along each text.

The work is that of the text and of its hits, whatever the number of names. What is sent grows with the names, so their
characters are counted first; beyond ``MOST_CHARACTERS`` callers take another way (``fits`` tells).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of all names that one automaton may hold (some 100 bytes each in a worker).
MOST_CHARACTERS = 4_000_000
_ALONE = frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_")
HITS = "array<struct<name: string, n: bigint, first: int>>"


def fits(names: DataFrame, most: int = MOST_CHARACTERS) -> bool:
    """Whether the distinct names (``name``) are few enough for an automaton."""
    return (names.agg(F.sum(F.length("name")).alias("n")).first()["n"] or 0) <= most


def built(names: list[str], fold: bool = False) -> ahocorasick.Automaton:
    """With ``fold`` names are held in small letters; each tells the names that it stands for, by their places in the list."""
    held: dict[str, list[int]] = {}
    for k, n in enumerate(names):
        if n:
            held.setdefault(n.lower() if fold else n, []).append(k)
    out = ahocorasick.Automaton()
    for n, places in held.items():
        out.add_word(n, (len(n), tuple(places)))
    if held:
        out.make_automaton()
    return out


def hits(text: str, machine: ahocorasick.Automaton, alone: set[int] | frozenset[int] = frozenset()) -> dict[int, list[int]]:
    """For each name found (by its place) how often, without overlaps of its own, and where first; those of ``alone`` must stand apart from ASCII word characters."""
    found: dict[int, list[int]] = {}
    if not len(machine):
        return found
    for end, (size, places) in machine.iter(text):
        start = end - size + 1
        apart = not (start and text[start - 1] in _ALONE) and text[end + 1 : end + 2] not in _ALONE
        for k in places:
            if k in alone and not apart:
                continue
            seen = found.get(k)
            if seen is None:
                found[k] = [1, start, end]
            elif start > seen[2]:
                seen[0] += 1
                seen[2] = end
    return found


def with_hits(rows: DataFrame, names: list[str], text_col: str, out: str, fold: bool = False, alone: list[str] | None = None) -> DataFrame:
    """Adds ``out`` (``HITS``), the names of the list that a text holds, in its order. ``fold``: in any case; ``alone``: names that must stand apart."""
    spark: SparkSession = rows.sparkSession
    shipped = spark.sparkContext.broadcast(pickle.dumps(built(names, fold)))
    apart = {k for k, n in enumerate(names) if n in set(alone or ())}

    @F.arrow_udf(HITS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = pickle.loads(shipped.value)
        kind = pa.list_(pa.struct([("name", pa.string()), ("n", pa.int64()), ("first", pa.int32())]))
        for texts in batches:
            told = []
            for t in texts.to_pylist():
                found = hits(t or "", machine, apart)
                told.append([{"name": names[k], "n": found[k][0], "first": found[k][1]} for k in sorted(found)])
            yield pa.array(told, kind)

    text = F.coalesce(F.col(text_col), F.lit(""))
    return rows.withColumn(out, run(F.lower(text) if fold else text))
