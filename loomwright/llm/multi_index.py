"""Approximate nearest neighbours by an inverted multi-index: largest inner products.

Either half of the vectors is quantised by a codebook of its own, so that ``K`` centroids a half make ``K * K`` cells. A query
asks the cells in the order of the sum of its two halves' inner products with the cells' centroids: a heap walks the pairs of
the two sorted lists, without making them all, until the cells it has met hold as many entries as the budget says. These
entries are then ranked by the inner product of the original vectors in double precision.

Budget: what share of its neighbours a query finds depends on the data, so it is measured: for ``PROBES`` queries (those of
the least hashes) the nearest of all rows are found by brute force in one pass, and the budget is the least number of entries
at which the walk has met ``AIMED`` of them on average. ``Index.recall`` tells what was measured.

At scale: the codebooks come from a bounded sample (``SAMPLE`` vectors), the number of cells is bounded (``K`` at most
``MOST_CENTROIDS``), so codebooks and cell sizes can be sent to all tasks. Entries lie in shards, which are runs of cells of at
most ``MOST_SHARD`` entries; a cell of more is split over shards of its own. A query's vector goes once to each shard it asks,
with the cells it asks there, and each shard answers with the best of its entries. Equal vectors are one entry with the
smallest ids, no more than a result can hold (all of them score the same, and ties go to smaller ids, so no result is lost),
and equal queries are one search.

Defined cases: vectors that are null, zero, of another length than the most frequent one (the longer where two are) or that
hold null or non-finite components take no part, as query or candidate; null ids neither; repeated rows (one id twice) are
candidates once where their vectors are equal, and rows of one id never find each other; an empty table gives no rows;
vectors of one component have an empty first half. Extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType

from .common import prepare, whole_number, written

K = 20
SAMPLE = 50_000
#: Entries that a cell holds on average, as far as the bound of the centroids allows.
PER_CELL, MOST_CENTROIDS = 12, 1024
ROUNDS = 8
PROBES, AIMED = 256, 0.95
#: Entries of a shard: an ``EIGHTH`` of all, within these bounds. Few large shards answer a query in few rows, and the upper bound is what a task holds.
LEAST_SHARD, MOST_SHARD, EIGHTH = 2048, 65_536, 8
#: Queries of a shard that are scored at once.
QUERIES = 256


def entries(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, v`` of the rows that take part."""
    kind = vectors.select(F.col(f"`{vector_col}`")).schema[0].dataType
    if not (isinstance(kind, ArrayType) and isinstance(kind.elementType, NumericType)):
        raise TypeError(f"{vector_col} must be an array of numbers, not {kind.simpleString()}")
    rows = vectors.select(whole_number(vectors, id_col).alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.filter(F.col("id").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0]["n"] if sizes else 0))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """``c, v, ids``: equal vectors once, named by their least id, with the ``k + 1`` least ids (which a partial limit keeps small before any shuffle)."""
    few = rows.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("_n") <= k + 1)
    return few.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("c"), "v", "ids")


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centroids.T - 0.5 * (centroids * centroids).sum(1), axis=1)


def centroids(x: np.ndarray, k: int, seed: int = 0, rounds: int = ROUNDS) -> np.ndarray:
    """``k`` means of the rows (fewer rows: fewer means); a mean that loses its rows takes the row that is farthest from its own."""
    r = np.random.default_rng(seed)
    out = x[r.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest_centroid(x, out)
        sums = np.zeros_like(out)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(out))
        out[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        for lost, far in zip(np.flatnonzero(counts == 0), np.argsort(-((x - out[near]) ** 2).sum(1)), strict=False):
            out[lost] = x[far]
    return out


@dataclass
class Index:
    """The two codebooks, and for each cell its entries, its first shard and its number of shards."""

    first: np.ndarray
    second: np.ndarray
    sizes: np.ndarray = None
    shard: np.ndarray = None
    parts: np.ndarray = None
    budget: int = 0
    recall: float | None = None

    @property
    def split(self) -> int:
        return self.first.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest_centroid(x[:, : self.split], self.first) * len(self.second) + nearest_centroid(x[:, self.split :], self.second)

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """All cells by descending sum of the halves' inner products: a heap over the pairs of the two sorted lists."""
        a, b = self.first @ q[: self.split], self.second @ q[self.split :]
        rows, cols = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
        a, b = (-np.sort(-a)).tolist(), (-np.sort(-b)).tolist()
        heap = [(-(a[0] + b[0]), 0, 0)]
        while heap:
            _, i, j = heapq.heappop(heap)
            yield rows[i] * len(cols) + cols[j]
            if j + 1 < len(cols):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(rows):  # each pair is pushed once, from the pair on its left or, in the first column, above
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))

    def asked(self, q: np.ndarray) -> list[int]:
        """The non-empty cells that a query asks: until they hold ``budget`` entries."""
        out, met = [], 0
        for cell in self.walk(q):
            if self.sizes[cell]:
                out.append(cell)
                met += int(self.sizes[cell])
                if met >= self.budget:
                    break
        return out

    def lay_out(self, counted: list[tuple[int, int]], per_shard: int) -> None:
        """Shards of neighbouring cells, from ``(cell, entries)``."""
        n = len(self.first) * len(self.second)
        self.sizes, self.shard, self.parts = np.zeros(n, np.int64), np.zeros(n, np.int32), np.ones(n, np.int32)
        for cell, c in counted:
            self.sizes[cell] = c
        shard, held = 0, 0
        for cell in np.flatnonzero(self.sizes).tolist():
            c = int(self.sizes[cell])
            if held and held + c > per_shard:
                shard, held = shard + 1, 0
            self.shard[cell], held = shard, held + c
            if c > per_shard:
                self.parts[cell] = -(-c // per_shard)
                shard, held = shard + int(self.parts[cell]), 0


def fit(entries_: DataFrame, n: int, sample: int = SAMPLE, per_cell: int = PER_CELL, seed: int = 0) -> Index:
    """Codebooks from about ``sample`` vectors (those of the least hashes) of ``n``."""
    share = min(1.0, sample / max(1, n))
    picked = entries_.filter(F.pmod(F.xxhash64("c", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("c", "v").toArrow().sort_by("c")
    x = matrix(picked.column("v").combine_chunks())
    k = int(min(MOST_CENTROIDS, max(1, round((n / per_cell) ** 0.5))))
    split = x.shape[1] // 2
    halves = [centroids(h, k, seed) for h in (x[:, :split], x[:, split:])]
    return Index(*halves)


def with_cells(rows: DataFrame, index: Index) -> DataFrame:
    """``c, v, ids`` with the entry's ``cell``."""
    first, second = index.first, index.second

    @F.arrow_udf("int")
    def run(v: pa.Array) -> pa.Array:
        return pa.array(Index(first, second).cells(matrix(v)).astype(np.int32), pa.int32())

    return rows.withColumn("cell", run("v"))


def exactly(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products with the rows of ``x``: each the same sum in the same order, wherever the row lies."""
    return (x * q).sum(axis=1)


def best(scores: np.ndarray, q: np.ndarray, x: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and exact scores of the ``k`` greatest, ties to the smaller name. ``scores`` are near the exact ones (-inf: not asked)."""
    asked = np.flatnonzero(scores > -np.inf)
    if len(asked) > k:
        least = np.partition(scores[asked], len(asked) - k)[len(asked) - k]
        slack = 1e-9 * (1 + float(np.abs(q).sum()) * float(np.abs(x).max()))
        asked = asked[scores[asked] >= least - slack]
    exact = exactly(q, x[asked])
    order = np.lexsort((names[asked], -exact))[:k]
    return asked[order], exact[order]


def calibrate(rows: DataFrame, index: Index, probes: list[tuple[int, list[float]]], k: int = K, aimed: float = AIMED) -> None:
    """Sets the budget by the brute-force neighbours of the probes among all entries (``c, v, cell``)."""
    q = np.array([v for _, v in probes])
    own = np.array([c for c, _ in probes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, names, cells = matrix(b.column(1)), b.column(0).to_numpy(), b.column(2).to_numpy()
            out = []
            for p, scores in enumerate(q @ x.T if len(x) else []):
                scores[names == own[p]] = -np.inf
                at, exact = best(scores, q[p], x, names, k)
                out += [(p, s, int(names[i]), int(cells[i])) for i, s in zip(at, exact.tolist(), strict=True)]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.float64(), pa.int64(), pa.int32()), strict=True)], names=["p", "s", "c", "cell"])

    near = rows.select("c", "v", "cell").mapInArrow(run, "p int, s double, c long, cell int")
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("s"), "c"))).filter(F.col("_n") <= k)
    cells: dict[int, list[int]] = {}
    for r in near.select("p", "cell").collect():
        cells.setdefault(r["p"], []).append(r["cell"])
    total = int(index.sizes.sum())
    needed = []
    for p, mine in cells.items():
        walked = np.fromiter(index.walk(q[p]), np.int64)
        met = np.zeros(len(index.sizes), np.int64)
        met[walked] = np.cumsum(index.sizes[walked])
        needed += met[mine].tolist()
    least = 4 * (k + 1)
    needed = np.sort(np.array(needed or [total]))
    index.budget = int(min(total, max(least, needed[min(len(needed) - 1, int(np.ceil(aimed * len(needed))) - 1)])))
    index.recall = float((needed <= index.budget).mean())


def _asking(index: Index):
    """Rows of queries ``c, v`` to a row for each shard asked: ``shard, c, v, cells``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shards, rows, cells = [], [], []
            for k, q in enumerate(matrix(b.column(1))):
                by: dict[int, list[int]] = {}
                for cell in index.asked(q):
                    for part in range(index.parts[cell]):
                        by.setdefault(int(index.shard[cell]) + part, []).append(cell)
                shards += by
                cells += by.values()
                rows += [k] * len(by)
            told = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), told.column(0), told.column(1), pa.array(cells, pa.list_(pa.int32()))], names=["shard", "c", "v", "cells"])

    return run


def answered(k: int):
    """The best of a shard for each of its queries. Its rows come sorted: first its entries (``cells`` null), then the queries."""

    def solve(asked: list[tuple], x: np.ndarray, names: np.ndarray, cells: np.ndarray, ids: list) -> pa.RecordBatch:
        out = []
        q = np.array([v for _, v, _ in asked])
        scores = q @ x.T
        for i, (c, _, mine) in enumerate(asked):
            mask = np.zeros(int(cells.max()) + 1, bool)
            mask[[m for m in mine if m < len(mask)]] = True
            scores[i, ~mask[cells]] = -np.inf
            at, exact = best(scores[i], q[i], x, names, k + 1)
            out += [(c, s, ids[j]) for j, s in zip(at.tolist(), exact.tolist(), strict=True)]
        cols = list(zip(*out, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.float64(), pa.list_(pa.int64())), strict=True)], names=["c", "score", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, waiting, table = None, [], [], None
        for b in batches:
            numbers, is_query = b.column(0).to_numpy(), b.column(5).is_valid().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((numbers[1:] != numbers[:-1]) | (is_query[1:] != is_query[:-1])) + 1).tolist(), len(numbers)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if numbers[lo] != shard:
                    if waiting:
                        yield solve(waiting, *table)
                    shard, held, waiting, table = numbers[lo], [], [], None
                part = b.slice(lo, hi - lo)
                if not is_query[lo]:
                    held.append(part)
                    continue
                if not held:  # no entry of these cells lies here
                    continue
                if table is None:
                    mine = pa.Table.from_batches(held).combine_chunks()
                    table = (matrix(mine.column(2).chunk(0)), mine.column(1).to_numpy(), mine.column(4).to_numpy(), mine.column(3).to_pylist())
                    held = held[:1]
                for row in zip(part.column(1).to_pylist(), matrix(part.column(2)), part.column(5).to_pylist(), strict=True):
                    waiting.append(row)
                    if len(waiting) >= QUERIES:
                        yield solve(waiting, *table)
                        waiting = []
        if waiting:
            yield solve(waiting, *table)

    return run


def search(
    vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, probes: int = PROBES, aimed: float = AIMED, per_shard: int | None = None, per_cell: int = PER_CELL, told: list[Index] | None = None
) -> DataFrame:
    """The ``k`` nearest found of each query: ``query_id, rank, vec_id, score``. ``is_query`` is a condition on the id, named ``id``; ``told`` gets the index."""
    prepare(vectors.sparkSession)
    rows = written(entries(vectors, id_col, vector_col), "vectors")
    known = written(classes(rows, k), "classes")
    n = known.count()
    if not n:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    index = fit(known, n, sample, per_cell)
    celled = written(with_cells(known, index), "cells")
    index.lay_out([(r["cell"], r["n"]) for r in celled.groupBy("cell").agg(F.count("*").alias("n")).collect()], per_shard or min(MOST_SHARD, max(LEAST_SHARD, n // EIGHTH)))
    # Queries by the least id of their vector; equal ones are searched for once.
    queries = written(rows.filter(is_query).select("id", "v").distinct().join(known.select("v", "c"), "v").select("id", "c"), "queries")
    wanted = written(queries.select("c").distinct().join(known.select("c", "v"), "c").select("c", "v"), "wanted")
    some = [(r["c"], r["v"]) for r in wanted.orderBy(F.xxhash64("c", F.lit(7)), "c").limit(probes).collect()]
    calibrate(celled, index, some, k, aimed)
    if told is not None:
        told.append(index)

    placed = _placed(celled, index)
    asking = wanted.mapInArrow(_asking(index), "shard int, c long, v array<double>, cells array<int>")
    both = placed.select("shard", "c", "v", "ids", "cell", F.lit(None).cast("array<int>").alias("cells")).unionByName(asking.select("shard", "c", "v", F.lit(None).cast("array<bigint>").alias("ids"), F.lit(None).cast("int").alias("cell"), "cells"))
    dealt = both.repartition("shard").sortWithinPartitions("shard", F.col("cells").isNotNull(), "c")
    found = dealt.mapInArrow(answered(k), "c long, score double, ids array<bigint>")
    # Of each search the best k + 1 ids, one more than asked, as the query's own goes.
    each = found.select("c", "score", F.explode("ids").alias("vec_id"))
    ranked = each.withColumn("_n", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("score"), "vec_id"))).filter(F.col("_n") <= k + 1)
    lists = ranked.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("near"))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("id")), 1, k)
    out = queries.join(lists, "c").select(F.col("id").alias("query_id"), F.posexplode(others).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), "x.vec_id", "x.score")


def _placed(celled: DataFrame, index: Index) -> DataFrame:
    """Entries with their shard; those of a large cell by a hash of their name."""
    shard, parts = index.shard, index.parts

    @F.arrow_udf("int")
    def run(cell: pa.Array, spread: pa.Array) -> pa.Array:
        at = cell.to_numpy()
        return pa.array((shard[at] + spread.to_numpy() % parts[at]).astype(np.int32), pa.int32())

    return celled.withColumn("shard", run("cell", F.pmod(F.xxhash64("c"), F.lit(1 << 30))))
