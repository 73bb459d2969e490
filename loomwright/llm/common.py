"""What the operators of this subpackage share: tables in the shared folder, Arrow settings, vectorised word hashes."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

#: Bytes of text that a Python worker gets at once; a single longer text still comes whole.
ARROW_BATCH_BYTES = "4m"
ARROW_BATCH_ROWS = "1024"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's source to the Python workers, wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="loomwright-")) / f"{top.name}.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(to))
    _SHIPPED.add(app)


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches: a worker's memory then follows the longest text, not the row count. Ships this package to the workers once."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_BATCH_ROWS)


_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables written inside, but for those to be kept, and lets go of finished shuffles.

    For jobs of several steps: results that are still to be computed inside must be written to be kept first.
    """
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        gc.collect()
        spark._jvm.System.gc()  # shuffle files go when the driver's JVM finds their plans unused


def shared_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``); where it is unset, a folder of our own on a local master, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or None
    if base is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="loomwright-")
        spark.conf.set("spark.checkpoint.dir", base)
    top = f"{base.rstrip('/')}/loomwright-{uuid.uuid4().hex}"
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(top)
    return f"{top}/{name}"


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = shared_path(spark, name, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a variant that no column of ``df`` has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_text_struct(df: DataFrame, text_col: str, out: str, kernel: Callable[[list], pa.Array], schema: str) -> DataFrame:
    """Adds ``out``, a struct that ``kernel`` makes from batches of whole texts; the other columns never leave the JVM."""

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield kernel(texts.to_pylist())

    return df.withColumn(out, run(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))


def whole_number(df: DataFrame, name: str) -> Column:
    """The column as long. Text or fractional ids are refused at once, before any job runs."""
    kind = df.select(F.col(f"`{name}`")).schema[0].dataType
    if not isinstance(kind, (IntegralType, NullType)):
        raise TypeError(f"{name} must hold whole numbers, not {kind.simpleString()}")
    return F.col(f"`{name}`").cast("long")


def columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


# -- memory of the Python workers ----------------------------------------------

#: (operator, what empties its cache); workers live on from stage to stage.
CACHES: list[tuple[str, Callable[[], None]]] = []
_CURRENT = ""


def enter(name: str) -> None:
    """Called by a kernel where a task begins: caches of other operators go, and freed memory returns to the system."""
    global _CURRENT
    if name == _CURRENT:
        return
    _CURRENT = name
    for owner, clear in CACHES:
        if owner != name:
            clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


# -- vectorised hashes of words -------------------------------------------------

_MASK = (1 << 64) - 1
_MULT = 0x9E3779B97F4A7C15
_SLICE = 1 << 19


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(_MULT)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_MULT, -1, 1 << 64)
    up, down = np.full(n + 1, _MULT, np.uint64), np.full(n + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=4)
def _byte_tables(key: int) -> tuple[np.ndarray, np.ndarray]:
    white = np.zeros(256, bool)
    white[[0x20, *range(0x09, 0x0E)]] = True
    return splitmix(splitmix(np.arange(1000, 1256, dtype=np.uint64)) ^ splitmix(np.array([key], np.uint64))), white


#: Bytes of a word from which its hash is a keyed BLAKE2 digest: powers of one odd factor repeat in sums of so many terms.
LONG_WORD = 32


def _slice_hashes(data: np.ndarray, key: int) -> np.ndarray:
    values, white = _byte_tables(key)
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(white[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    size = _SLICE if len(data) <= _SLICE else 1 << len(data).bit_length()
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    out = splitmix((sums[ends] - sums[starts]) * down[starts])
    secret = key.to_bytes(8, "little")
    for k in np.flatnonzero(ends - starts >= LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, key=secret).digest(), "little")
    return out


def word_hashes(text: bytes, key: int = 0) -> np.ndarray:
    """64-bit hashes of the words (runs without space, tab, LF, VT, FF, CR) of a UTF-8 text, in order.

    Polynomial hashes of byte values drawn by ``key``, from prefix sums (keyed digests for words of ``LONG_WORD`` bytes or
    more): who does not know the key can't make words collide. Long texts go slice by slice, cut at white space, so that the
    memory besides the result is bounded by the longest word.
    """
    if len(text) <= _SLICE:
        return _slice_hashes(np.frombuffer(text, np.uint8), key)
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + _SLICE)
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        parts.append(_slice_hashes(np.frombuffer(text, np.uint8, end - at, at), key))
        at = end
    return np.concatenate(parts)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` consecutive words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    factors = splitmix(np.arange(77, 77 + n, dtype=np.uint64)) | np.uint64(1)
    out = words[: len(words) - n + 1] * factors[0]
    for k in range(1, n):
        out += words[k : len(words) - n + 1 + k] * factors[k]
    return splitmix(out)


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")
