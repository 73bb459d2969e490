"""Exact deduplication through content-defined chunk recipes.

A text is cut where a rolling hash of its last bytes has a fixed pattern, so equal stretches give equal chunks wherever
they stand. Every chunk is stored once and named by an identifier; a document becomes a recipe, the ordered list of its
chunks' identifiers. Two documents are equal exactly if their recipes are, so long texts are read once and never move:
what is shuffled is each new chunk (once for each task that met it) and short recipes.

Identifiers are digests, and are verified: the store groups chunks by their bytes, and if one identifier ever stands for
two byte strings, the documents that use it are compared by their chunks' bytes instead. No result rests on the digest.

Defined cases: null counts as empty; empty texts are equal to each other; white space (space, tab, LF, VT, FF, CR) is
deleted before comparing. Of equal texts the row with the most code points in its original text stays, then the smallest
id (null last), then the first row read; of repeated rows one stays. Ids are whole numbers (others
are refused). Extra columns don't matter: only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import enter, prepare, splitmix, utf8, whole_number, written

#: A boundary follows where the low bits of the rolling hash are zero: chunks of 2 KiB on average.
MASK = (1 << 11) - 1
WINDOW = 16
LEAST, MOST = 512, 16_384
ID_BYTES = 16
_SLICE = 1 << 20
_WHITE = b" \t\n\v\f\r"
_VALUES = splitmix(np.arange(256, dtype=np.uint64)).astype(np.uint32)
_FACTOR = 0x2C1B3C6D


def _candidates(data: bytes) -> np.ndarray:
    """Positions after which the hash of the last ``WINDOW`` bytes asks for a boundary."""
    found = []
    for at in range(0, len(data), _SLICE):
        lo = max(0, at - WINDOW + 1)
        h = _VALUES[np.frombuffer(data, np.uint8, min(len(data), at + _SLICE) - lo, lo)]
        span = 1
        while span < WINDOW:  # h[i] covers span bytes: doubles
            h[span:] += h[:-span] * np.uint32(pow(_FACTOR, span, 1 << 32))
            span *= 2
        hit = np.flatnonzero((h >> np.uint32(8)) & np.uint32(MASK) == 0) + lo + 1
        found.append(hit[hit > at])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def cut(data: bytes) -> list[bytes]:
    """Chunks of ``LEAST`` to ``MOST`` bytes (the last may be shorter)."""
    if len(data) <= LEAST:
        return [data] if data else []
    out, start = [], 0
    for p in _candidates(data).tolist():
        while p - start > MOST:
            out.append(data[start : start + MOST])
            start += MOST
        if p - start >= LEAST:
            out.append(data[start:p])
            start = p
    while len(data) - start > MOST:
        out.append(data[start : start + MOST])
        start += MOST
    if start < len(data):
        out.append(data[start:])
    return out


def _digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:ID_BYTES]


_FIELDS = pa.schema([("id", pa.int64()), ("n_cp", pa.int64()), ("sha", pa.string()), ("recipe", pa.binary()), ("fresh", pa.list_(pa.struct([("k", pa.binary()), ("b", pa.binary())])))])


def _recipes(digest: Callable[[bytes], bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("exact")
        seen: set[bytes] = set()  # of this task; only saves repeated storing, so it may start anew
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = utf8(text).translate(None, _WHITE)
                ids, fresh = [], []
                for chunk in cut(data):
                    full = hashlib.sha256(chunk).digest()
                    k = digest(chunk)
                    ids.append(k)
                    if full not in seen:
                        seen.add(full)
                        fresh.append({"k": k, "b": chunk})
                if len(seen) > 200_000:
                    seen.clear()
                rows.append((doc_id, len(text or ""), hashlib.sha256(data).hexdigest(), b"".join(ids), fresh))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            made = [pa.array(c, f.type) for c, f in zip(cols, _FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays([*made, *batch.columns[2:]], names=[*_FIELDS.names, *["uid"][: batch.num_columns - 2]])

    return run


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[bytes], bytes] = _digest, row_col: str | None = None) -> DataFrame:
    """One row a document: ``doc_id, keep_id, group_size, kept, text_sha256`` (``digest`` is for tests of collisions).

    ``row_col``, a unique row number of ``docs``, comes along where it is named; it then stands for the order of reading.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(whole_number(docs, id_col).alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"), *([F.col(f"`{row_col}`").cast("long").alias("uid")] if row_col else []))
    schema = "id long, n_cp long, sha string, recipe binary, fresh array<struct<k: binary, b: binary>>"
    told = rows.mapInArrow(_recipes(digest), f"{schema}, uid long" if row_col else schema)
    stored = written(told if row_col else told.withColumn("uid", F.monotonically_increasing_id()), "recipes")

    chunks = stored.select(F.explode("fresh").alias("c")).select("c.k", "c.b")
    # Chunks of one identifier with other bytes; a digest of 16 bytes has none, and then no further job runs.
    variants = chunks.groupBy("k", "b").agg(F.lit(1).alias("one")).groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k")
    variants = written(variants, "collisions")
    recipes = stored.select("id", "n_cp", "sha", "recipe", "uid").withColumn("proof", F.lit(None).cast("string"))
    if not variants.isEmpty():
        recipes = _by_bytes(rows, stored, variants, digest)
    recipes = recipes.withColumn("rank", F.struct("n_cp", F.when(F.col("id").isNotNull(), -F.col("id")).alias("i"), (-F.col("uid")).alias("u")))
    # Null-safe join on the whole recipe; one row a group on one side, and skewed groups of the other can be split.
    groups = recipes.groupBy("recipe", F.coalesce("proof", F.lit("")).alias("proof")).agg(F.max("rank").alias("best"), F.count("*").alias("group_size"))
    out = recipes.withColumn("proof", F.coalesce("proof", F.lit(""))).join(groups, ["recipe", "proof"])
    return out.select(
        F.col("id").alias("doc_id"), (-F.col("best.i")).alias("keep_id"), "group_size", (-F.col("best.u") == F.col("uid")).alias("kept"), F.col("sha").alias("text_sha256"),
        *([F.col("uid").alias(row_col)] if row_col else []),
    )


def _by_bytes(rows: DataFrame, stored: DataFrame, collisions: DataFrame, digest: Callable[[bytes], bytes]) -> DataFrame:
    """Recipes whose documents with a doubtful identifier carry their normalised text as proof, compared in full."""
    width = len(digest(b""))
    named = stored.select("uid", F.explode(F.expr(f"transform(sequence(0, cast(length(recipe) / {width} as int) - 1), i -> substring(recipe, i * {width} + 1, {width}))")).alias("k")).filter("length(k) > 0")
    doubtful = named.join(collisions, "k", "left_semi").select("uid").distinct()
    # The text comes again from the rows, by id and by the hash of the normalised text.
    plain = rows.select(F.col("id").alias("i"), F.regexp_replace("t", r"[\x20\x09-\x0D]", "").alias("proof"))
    plain = plain.withColumn("s", F.sha2("proof", 256)).distinct()
    marked = stored.select("id", "n_cp", "sha", "recipe", "uid").join(doubtful.withColumn("doubt", F.lit(True)), "uid", "left")
    clear = marked.filter("doubt is null").select("id", "n_cp", "sha", "recipe", "uid", F.lit(None).cast("string").alias("proof"))
    open_ = marked.filter("doubt").join(plain, F.col("id").eqNullSafe(F.col("i")) & (F.col("sha") == F.col("s"))).select("id", "n_cp", "sha", "recipe", "uid", "proof")
    return clear.unionByName(open_)
