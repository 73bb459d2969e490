"""Token ids as Parquet list columns, for selective reads of tokens and metadata.

File format: one row a document in ascending id order, columns ``part int`` (the file's place in that order), ``doc_id
long``, ``first long`` (token ids before the document in its part), ``n_tokens long``, ``ids array<int>``. Metadata
columns are delta-encoded (Parquet format 2), ids are dictionary-encoded (a vocabulary fits a dictionary page), row
groups and pages have fixed sizes, and the writer adds column and offset indexes. So metadata can be read without ids, and
a range of documents without the rest of a file.

Defined cases: a null text is empty and gets the end id alone; a null id sorts first; repeated rows each get their own
entry; of equal ids any order; ids are whole numbers (others are refused). Extra columns are not written.

Parts are ranges of ids of about equal bytes of text: at most ``PART_BYTES``, whatever the number of documents (rows of one
id cannot be parted). As for Spark's own range partitions, a sample finds the bounds: rows drawn by a hash with a chance in
proportion to their bytes, some ``SAMPLED`` a part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, shared_path, whole_number, written
from .encoding import encoder

END_ID = 2
ROW_GROUP_BYTES, PAGE_BYTES, DICTIONARY_BYTES = 16 << 20, 256 << 10, 1 << 20
#: Pieces that a worker remembers.
MEMO = 800_000
BROADCAST_PARTS = 1_000_000
#: Bytes of text of a part at most and, where fewer parts would leave tasks without work, at least; sampled rows a part.
PART_BYTES, LEAST_PART_BYTES, SAMPLED = 512 << 20, 4 << 20, 40
SCHEMA = "part int, doc_id long, first long, n_tokens long, ids array<int>"


def write(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, spaces_matter: bool = True) -> None:
    """Encodes every whole text, appends ``end_id`` and writes the files of ``path``."""
    prepare(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before = encoder(vocabulary, spaces_matter, MEMO), 0
        for b in batches:
            ids = enc.encode_array(b.column(2), end_id)
            counts = ids.value_lengths().to_numpy().astype(np.int64)
            firsts = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(firsts, pa.int64()), pa.array(counts, pa.int64()), ids], names=["part", "doc_id", "first", "n_tokens", "ids"])

    rows = docs.select(whole_number(docs, id_col).alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    cuts = _cuts(rows)
    dealt = _with_part(rows, cuts).repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "doc_id").select("part", "doc_id", "text")
    options = {
        "compression": "snappy",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.dictionary.page.size": DICTIONARY_BYTES,
        "parquet.enable.dictionary": "false",  # delta encodings for the metadata
        "parquet.enable.dictionary#ids.list.element": "true",
    }
    dealt.mapInArrow(encode, SCHEMA).write.options(**options).parquet(path)


def _cuts(rows: DataFrame) -> list[int]:
    """The greatest ids of all parts but the last."""
    spark = rows.sparkSession
    sizes = written(rows.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size")), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    parts = max(math.ceil(total / PART_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / LEAST_PART_BYTES)))
    if parts <= 1:
        return []
    # A row stands for ``step`` bytes, or its own if it has more; so the sample has at most twice SAMPLED rows a part.
    step = max(1, total // (SAMPLED * parts))
    drawn = sizes.filter("doc_id is not null").filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(step)) < F.col("size"))
    told = drawn.select("doc_id", F.greatest("size", F.lit(step)).alias("w")).toArrow()
    ids, weights = told.column(0).to_numpy(), told.column(1).to_numpy()
    order = np.argsort(ids, kind="stable")
    place = np.minimum(np.cumsum(weights[order]) * parts // max(1, int(weights.sum())), parts - 1)
    return np.unique(ids[order][:-1][place[1:] != place[:-1]]).tolist()


def _with_part(rows: DataFrame, cuts: list[int]) -> DataFrame:
    """Adds ``part``: how many of the sorted ``cuts`` are less than the id; 0 for null."""
    if not cuts:
        return rows.withColumn("part", F.lit(0))
    bounds = np.array(cuts, np.int64)

    @F.arrow_udf("int")
    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in batches:
            yield pa.array(np.searchsorted(bounds, ids.fill_null(bounds[0]).to_numpy(zero_copy_only=False)).astype(np.int32))

    return rows.withColumn("part", place("doc_id"))


def read(spark, path: str) -> DataFrame:
    """The rows of the files, with ``start``: the ids of all documents before."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    # A row a part, from the metadata alone; parts number as tasks, so one window over them is small.
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = written(parts.select("part", before.alias("before")), "parts")
    if parts.count() <= BROADCAST_PARTS:  # a row of 12 bytes a task
        parts = F.broadcast(parts)
    return rows.join(parts, "part").withColumn("start", F.col("before") + F.col("first"))


def digest(rows: DataFrame) -> DataFrame:
    """``ids_crc32`` of each row's ids as little-endian unsigned 32-bit integers."""
    prepare(rows.sparkSession)

    @F.arrow_udf("long")
    def crc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in batches:
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            ends = ids.value_lengths().to_numpy(zero_copy_only=False).cumsum().tolist()
            out, at = [], 0
            for e in ends:
                out.append(zlib.crc32(flat[at:e].tobytes()))
                at = e
            yield pa.array(out, pa.int64())

    return rows.withColumn("ids_crc32", crc("ids"))


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write(docs, path, vocabulary)
    return digest(read(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
