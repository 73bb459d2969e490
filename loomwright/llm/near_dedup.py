"""Near-duplicate detection with SetSketch registers.

A document is the set of its distinct word shingles. Its sketch holds, for each register, the least of exponentially
distributed hash values over the set, stored on an exponentially spaced, truncated scale (``1 - log_b`` of the minimum,
rounded down, 0 to ``Q + 1``). Registers of a union are the maxima of the parts' registers, and two sketches agree in a
register with about the probability of the sets' Jaccard similarity, so bands of registers serve as bucket keys.

Steps: (1) documents with equal sets form one class, and only classes go on; (2) classes that share a band are candidates;
(3) candidates are compared through the joint likelihood of their registers, given both exact set sizes, and a pair is left
out only where the likelihood excludes the threshold; (4) the rest is verified on the full sets; (5) connected components.

No group is expanded into its pairs: each class is first compared with the most central class of each of its buckets, and
members that are in one component by then need no further comparison. Classes that are still apart go to the tasks of their
buckets' blocks twice. First with their registers alone: a task tells which of its classes have a partner that neither the
elements that no other class has nor the likelihood exclude. Only those get their full sets, in blocks of bounded bytes,
where a pair is verified unless it is in one component already. Only joins of components leave such a task.

Buckets of more than ``BLOCK`` classes (pages of one template that are not near-duplicates share most of their bands) are not
compared all with all. Their classes are keyed anew by the elements of their prefixes: with the elements in one order, rarest
first, two sets of similarity ``t`` share one of the first ``n - ceil(t * n) + 1`` elements of either. So pages meet by what is
rare in them and not by their template, and no link is lost. Elements that the same classes have in their prefixes count once.

Elements are 64-bit hashes under a key that each run draws anew (long words go through BLAKE2), so that nobody can write
texts that collide in it; that two shingles of a pair of documents collide by chance has a probability of about the product of
their sizes over 2^64. A class is named by a 128-bit BLAKE2 digest of its set.

Bands: 40 bands of 5 registers miss a pair of similarity 0.85 with probability 2e-10, of 0.8 with 1e-7 (all kept pairs are exact).

Defined cases: null counts as empty; A-Z only is lower-cased; with fewer words than a shingle has, the whole sequence is
the one element; a document without words is linked with nothing. Repeated rows are documents of their own with equal
sets. Texts of any length are read whole. Ids are whole numbers (others are refused). Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import enter, prepare, splitmix, utf8, whole_number, window_hashes, word_hashes, written

SHINGLE = 5
BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
BASE, RATE, Q = 1.001, 20.0, (1 << 16) - 2
#: Log-likelihood by which the threshold must lose against the best similarity for a pair to be left out unverified.
EXCLUDE = 20.0
#: Classes up to which their ids are broadcast to find their texts (24 bytes a row); beyond, a shuffle join.
BROADCAST_ROWS = 1_000_000
#: Members of a bucket that one task compares by registers; larger buckets are compared block by block, in a task a pair of blocks.
BLOCK = 256
#: Standard deviations by which the equal registers of a pair may fall short of the threshold before its likelihood need not be asked.
FEW_EQUAL = 8
#: Elements (8 bytes each) of the full sets of one block.
ELEMENTS = 4 << 20


def shingles(text: str | None, n: int = SHINGLE, key: int = 0) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = word_hashes(utf8(text).lower(), key)
    if not len(words):
        return words
    return np.unique(window_hashes(words, n) if len(words) >= n else window_hashes(words, len(words)) + np.uint64(len(words)))


@lru_cache(maxsize=1)
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    seeds = splitmix(np.arange(2 * REGISTERS, dtype=np.uint64)).astype(np.uint32)
    return (seeds[:REGISTERS] | np.uint32(1))[:, None], seeds[REGISTERS:][:, None]


def sketch(elements: np.ndarray) -> np.ndarray:
    """Registers of a non-empty set of 64-bit hashes."""
    factors, shifts = _seeds()
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    low = (elements >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), 1024):
        values = low[None, at : at + 1024] * factors
        values += shifts
        np.minimum(least, values.min(axis=1), out=least)
    exponential = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, Q + 1).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


_GRID = np.linspace(0.0, 1.0, 101)


def _log_likelihood(j: np.ndarray, more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    u = n_a / (n_a + n_b)
    v = 1 - u

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
    same = np.maximum(1 - up - down, 1e-12)
    return more * np.log(up) + less * np.log(down) + (REGISTERS - more - less) * np.log(same)


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows of registers: the maximum-likelihood similarity, and whether ``threshold`` can't be excluded."""
    more, less = (a > b).sum(axis=1)[:, None].astype(float), (a < b).sum(axis=1)[:, None].astype(float)
    n_a, n_b = n_a[:, None].astype(float), n_b[:, None].astype(float)
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    grid = np.minimum(_GRID[None, :], most)
    told = _log_likelihood(grid, more, less, n_a, n_b)
    best = told.argmax(axis=1)
    estimate = grid[np.arange(len(grid)), best]
    at = _log_likelihood(np.minimum(threshold, most), more, less, n_a, n_b)[:, 0]
    possible = (most[:, 0] >= threshold - 1e-9) & ((estimate >= threshold) | (told.max(axis=1) - at <= EXCLUDE))
    return estimate, possible


def _sketches(key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near")
        for batch in batches:
            n, fp, regs = [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text, key=key)
                n.append(len(s))
                fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                regs.append(sketch(s).tobytes() if len(s) else None)
            made = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays([*made, *batch.columns[3:]], names=["id", "th", "n", "fp", "regs", *["uid"][: batch.num_columns - 3]])

    return run


def _sets(key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, key=key).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["node", "s"])

    return run


def _estimated(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ra, rb = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u2").reshape(b.num_rows, REGISTERS) for k in (2, 3))
                na, nb = b.column(4).to_numpy(), b.column(5).to_numpy()
                _, possible = similarity(ra, rb, na, nb, percent / 100)
                yield b.select(["a", "b"]).filter(pa.array(possible))

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for sa, sb in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(sa.as_buffer(), np.uint64), np.frombuffer(sb.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)), kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(100 * inter >= percent * (len(x) + len(y) - inter))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(edges: DataFrame, turns: list[int] | None = None) -> DataFrame:
    """``(v, c)``: each vertex that has an edge ``(a, b)``, with the least vertex of its component.

    Each turn orders the edges at random, hooks every vertex along its first edge, follows the hooks to their ends by
    doubling, and contracts the edges. Hooks make no cycle but that of the two ends of an edge that is first for both, of
    which the lesser vertex becomes the root. So a turn leaves at most half of the vertices, whatever the graph or the order
    of its numbers; hooks go along ever earlier edges, so their paths are short. A turn's tables are written to the shared
    folder; ``turns`` gets each turn's number of doublings.
    """
    labels: DataFrame | None = None
    edges = written(edges.filter("a <> b").select("a", "b"), "edges")
    turn = 0
    while not edges.isEmpty():
        turn += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = F.struct(F.xxhash64(F.least("a", "b"), F.greatest("a", "b"), F.lit(turn)).alias("r"), F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        hooks, steps = written(both.groupBy("a").agg(F.min_by("b", order).alias("p")).withColumnRenamed("a", "v"), "hooks"), 0
        while True:
            steps += 1
            up = hooks.select(F.col("v").alias("p"), F.col("p").alias("q"))
            to = F.when((F.col("q") == F.col("v")) & (F.col("p") != F.col("v")), F.least("v", "p")).otherwise(F.col("q"))
            hooks = written(hooks.join(up, "p").select("v", to.alias("p"), (F.col("p") != to).alias("moved")), "hooks")
            if hooks.filter("moved").isEmpty():
                break
        ends = hooks.select("v", F.col("p").alias("c"))
        if labels is None:
            labels = ends
        else:
            step = ends.select(F.col("v").alias("c"), F.col("c").alias("cc"))
            labels = written(labels.join(step, "c", "left").select("v", F.coalesce("cc", "c").alias("c")), "labels")
        a, b = ends.withColumnsRenamed({"v": "a", "c": "ca"}), ends.withColumnsRenamed({"v": "b", "c": "cb"})
        edges = written(edges.join(a, "a").join(b, "b").filter("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "edges")
        if turns is not None:
            turns.append(steps)
    if labels is None:
        return edges.selectExpr("a as v", "b as c")
    least = labels.groupBy("c").agg(F.min("v").alias("least"))
    return written(labels.join(least, "c").select("v", F.col("least").alias("c")), "components")


def _relabelled(labels: DataFrame, found: DataFrame) -> DataFrame:
    merged = found.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    names = components(merged.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    return written(labels.join(names.select(F.col("v").alias("label"), "c"), "label", "left").select("node", F.coalesce("c", "label").alias("label")), "labels")


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of the buckets with more than one label, and the bucket's size ``c``."""
    tally = rows.groupBy("band", "key").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("band", "key", "c")
    return rows.join(tally, ["band", "key"])


def _dealt(rows: DataFrame, blocks: Column, columns: list[str]) -> DataFrame:
    """Rows of buckets in ``blocks`` blocks, each block with every other one of its bucket: ``band, key, lo, hi, block`` and ``columns``, a pair of blocks in one task, in order."""
    rows = rows.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("band", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", *columns)
    return rows.repartition("band", "key", "lo", "hi").sortWithinPartitions("band", "key", "lo", "hi", "node")


def _unshared(sets: DataFrame) -> DataFrame:
    """``node, u``: how many elements of a set no other of these sets has. They can be in no intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, s in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                e = np.frombuffer(s.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), node, np.int64)), pa.array(e)], names=["node", "e"])

    elements = sets.select("node", "s").mapInArrow(run, "node long, e long")
    alone = elements.groupBy("e").agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1")
    return alone.groupBy("node").agg(F.count("*").alias("u"))


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``node, key``: the elements by which classes are to be compared that may be linked (their prefixes), without those that one class alone has there.

    Of elements that the same classes have, one stands for all: told by their number and two sums of hashes of their names.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, s in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                e = np.frombuffer(s.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), node, np.int64)), pa.array(e)], names=["node", "e"])

    elements = sets.select("node", "s").mapInArrow(explode, "node long, e long")
    often = elements.groupBy("e").agg(F.count("*").alias("df"))
    ranked = elements.join(often, "e").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("x"))
    n = F.size("x")
    length = n - F.ceil(percent * n / F.lit(100)).cast("int") + 1
    first = written(ranked.select("node", F.explode(F.filter(F.slice("x", F.lit(1), length), lambda x: x["df"] > 1)).alias("x")).select("node", F.col("x.e").alias("e")), "prefixes")
    half = [F.xxhash64(F.lit(seed), "node").bitwiseAND(0xFFFFFFFF) for seed in (5, 6)]
    lists = first.groupBy("e").agg(F.count("*").alias("n"), *[F.sum(h).alias(f"h{k}") for k, h in enumerate(half)]).filter("n > 1")
    one = lists.groupBy("n", "h0", "h1").agg(F.min("e").alias("e")).select("e")
    return first.join(one, "e").select("node", F.col("e").alias("key"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each pair of blocks, from rows in the order of ``band, key, lo, hi``."""
    group: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(k).to_numpy() for k in range(4)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            key = tuple(keys[:, lo].tolist())
            if group and key != last:
                yield pa.Table.from_batches(group)
                group = []
            last = key
            group.append(b.slice(lo, hi - lo))
    if group:
        yield pa.Table.from_batches(group)


class _Block:
    """Classes of a pair of blocks (``band, key, lo, hi, block, node, label, n, f, regs``), and what may still link them."""

    def __init__(self, rows: pa.Table, percent: int) -> None:
        self.percent, self.band = percent, rows.column(0)[0].as_py()
        self.across = rows.column(2)[0].as_py() != rows.column(3)[0].as_py()
        self.block, self.node, self.label, self.n, self.f = (rows.column(k).to_numpy() for k in (4, 5, 6, 7, 8))
        self.registers = np.frombuffer(b"".join(rows.column(9).to_pylist()), "<u2").reshape(len(rows), REGISTERS)
        self.bands = self.registers.view(f"V{2 * ROWS}").reshape(len(rows), BANDS)

    def partners(self, i: int, roots: np.ndarray) -> np.ndarray:
        """Earlier rows that row ``i`` may be linked with and is not by ``roots``, likeliest first.

        A pair that shares a band before this one is left to that band's task; one is passed over if the elements that each
        shares with anyone cannot make the similarity, or if the likelihood excludes it.
        """
        n, f, percent = self.n, self.f, self.percent
        least = np.minimum(f[:i], f[i])
        ok = (roots[:i] != roots[i]) & (100 * least >= percent * (n[:i] + n[i] - least))
        if self.across:
            ok &= self.block[:i] != self.block[i]
        at = np.flatnonzero(ok)
        share = percent / 100
        equal = REGISTERS * share - FEW_EQUAL * np.sqrt(REGISTERS * share * (1 - share))
        at = at[(self.registers[at] == self.registers[i]).sum(axis=1) >= equal]
        if self.band:
            at = at[~(self.bands[at, : self.band] == self.bands[i, : self.band]).any(axis=1)]
        if not len(at):
            return at
        estimate, possible = similarity(self.registers[at], np.repeat(self.registers[i][None], len(at), 0), n[at], np.repeat(n[i], len(at)), percent / 100)
        return at[possible][np.argsort(-estimate[possible], kind="stable")]


def _alive(percent: int):
    """Of each pair of blocks the classes that may be linked with another, by registers alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near")
        for rows in _groups(batches):
            block = _Block(rows, percent)
            alive = np.zeros(len(rows), bool)
            for i in range(1, len(rows)):
                at = block.partners(i, block.label)
                if len(at):
                    alive[at] = alive[i] = True
            if alive.any():
                keep = pa.array(alive)
                yield pa.RecordBatch.from_arrays([rows.column(k).filter(keep).combine_chunks() for k in (0, 1, 5, 6, 7, 8)], names=["band", "key", "node", "label", "n", "f"])

    return run


def _merged(percent: int):
    """Within each pair of blocks, links between components, verified on the full sets until all its pairs are decided.

    What comes out joins components, so it is less than the members.
    """

    def solve(rows: pa.Table) -> list[tuple[int, int]]:
        block = _Block(rows, percent)
        n, roots, out = block.n, block.label.copy(), []
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column(10)]
        for i in range(1, len(rows)):
            for j in block.partners(i, roots).tolist():
                if roots[j] == roots[i]:
                    continue
                both = np.sort(np.concatenate((sets[i], sets[j])), kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                if 100 * inter >= percent * (n[i] + n[j] - inter):
                    a, b = sorted((int(roots[i]), int(roots[j])))
                    roots[roots == b] = a
                    out.append((a, b))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near")
        for rows in _groups(batches):
            if found := solve(rows):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return run


def _band_key(registers: Column, band: int) -> Column:
    return F.xxhash64(registers)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, row_col: str | None = None, band_key: Callable[[Column, int], Column] = _band_key, key: int | None = None
) -> DataFrame:
    """One row a document: ``doc_id, n_shingles, component_id, kept``; links are pairs with ``100 * intersection >= percent * union``.

    ``band_key`` (a band's registers to a whole number) and ``key`` (of the hashes, drawn anew by default) are for tests.

    ``row_col``, a unique row number of ``docs``, comes along where it is named; then one row of each component is kept, that
    with the least id (null last) and row number, where otherwise all rows of the least id are.
    """
    spark = docs.sparkSession
    prepare(spark)
    hash_key = secrets.randbits(63) if key is None else key
    numbers = [F.col(f"`{row_col}`").cast("long").alias("uid")] if row_col else []
    rows = docs.select(whole_number(docs, id_col).alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"), *numbers).withColumn("th", F.xxhash64("t"))
    sketched = rows.select("id", "th", "t", *["uid"][: len(numbers)]).mapInArrow(_sketches(hash_key), "id long, th long, n long, fp binary, regs binary" + ", uid long" * len(numbers))
    sketched = written(sketched if row_col else sketched.withColumn("uid", F.monotonically_increasing_id()), "sketches")

    # Classes of equal sets; a class is named by the least row number, and its least id is that of the component at first.
    classes = written(sketched.filter("n > 0").groupBy("fp").agg(F.min("uid").alias("node"), F.min("id").alias("least"), *([F.min(F.struct(F.col("id").isNull().alias("x"), "id", "uid")).alias("best")] if row_col else [])), "classes")
    nodes = written(sketched.join(classes, F.col("uid") == F.col("node")).select("node", "id", "th", "n", "regs"), "nodes")
    keys = F.array(*[band_key(F.expr(f"substring(regs, {2 * ROWS * k + 1}, {2 * ROWS})"), k) for k in range(BANDS)])
    bands = nodes.select("node", F.posexplode(keys).alias("band", "key"))
    shared = bands.groupBy("band", "key").agg(F.count("*").alias("c")).filter("c > 1")
    members = written(bands.join(shared, ["band", "key"]).select("band", "key", "node", "c"), "members")
    # A class that shares its bands with the most others is the most central one of its buckets.
    weights = written(members.groupBy("node").agg(F.sum("c").alias("w")), "weights")

    active = weights.join(nodes.select("node", "id", "th"), "node").select("node", F.col("id").alias("i"), F.col("th").alias("h"))
    if weights.count() <= BROADCAST_ROWS:
        active = F.broadcast(active)
    texts = rows.join(active, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h"))).select("node", "t")
    sets = written(texts.mapInArrow(_sets(hash_key), "node long, s binary"), "sets").dropDuplicates(["node"]) if _repeats(rows) else written(texts.mapInArrow(_sets(hash_key), "node long, s binary"), "sets")
    regs = nodes.select("node", "regs", "n")

    def links(pairs: DataFrame) -> DataFrame:
        """The pairs that hold; each side's rows come by a join on unique nodes, the side with hot nodes first."""
        a, b = regs.select(F.col("node").alias("a"), F.col("regs").alias("ra"), F.col("n").alias("na")), regs.select(F.col("node").alias("b"), F.col("regs").alias("rb"), F.col("n").alias("nb"))
        likely = pairs.join(a, "a").join(b, "b").select("a", "b", "ra", "rb", "na", "nb").mapInArrow(_estimated(percent), "a long, b long")
        likely = written(likely, "likely")
        sa, sb = sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
        return written(likely.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb").mapInArrow(_verified(percent), "a long, b long"), "links")

    # First every class is compared with the most central class of each of its buckets.
    labels = weights.select("node", F.col("node").alias("label"), "w")
    central = members.join(weights, "node").groupBy("band", "key").agg(F.max(F.struct("w", (-F.col("node")).alias("x"))).alias("p")).select("band", "key", (-F.col("p.x")).alias("a"))
    found = links(members.join(central, ["band", "key"]).filter("node <> a").select("a", F.col("node").alias("b")).distinct())
    labels = _relabelled(labels, found)

    # Then what the buckets still hold of several components, without the classes that their own elements rule out.
    open_ = written(_mixed(members.select("band", "key", "node").join(labels.select("node", "label"), "node")), "open")
    if not open_.isEmpty():
        lonely = _unshared(sets.join(open_.select("node").distinct(), "node", "left_semi"))
        known = regs.join(lonely, "node", "left").withColumn("f", F.col("n") - F.coalesce("u", F.lit(0))).filter(100 * F.col("f") >= percent * F.col("n"))
        rows = written(_mixed(open_.drop("c").join(known.select("node", "n", "f", "regs"), "node")), "buckets")
        told = ["node", "label", "n", "f", "regs"]
        hot = rows.filter(F.col("c") > BLOCK)
        if not hot.isEmpty():
            hot = written(hot.select(*told).dropDuplicates(["node"]), "hot")
            again = _prefixes(sets.join(hot.select("node"), "node", "left_semi"), percent).join(hot, "node").select(F.lit(0).alias("band"), "key", *told)
            rows = rows.filter(F.col("c") <= BLOCK).unionByName(_mixed(again).select(*rows.columns))
        alive = _dealt(rows, F.ceil(F.col("c") / BLOCK), told).mapInArrow(_alive(percent), "band int, key long, node long, label long, n long, f long")
        alive = written(alive.distinct(), "alive")
        if not alive.isEmpty():
            size = alive.groupBy("band", "key").agg(F.sum("n").alias("size"))
            rows = alive.join(size, ["band", "key"]).join(nodes.select("node", "regs"), "node").join(sets, "node")
            merged = written(_dealt(rows, F.ceil(F.col("size") / ELEMENTS), [*told, "s"]).mapInArrow(_merged(percent), "a long, b long"), "merged")
            names = components(merged.distinct())
            labels = written(labels.join(names.select(F.col("v").alias("label"), "c"), "label", "left").select("node", F.coalesce("c", "label").alias("label")), "labels")

    named = classes.join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least").alias("component"), *([F.min("best").alias("chosen")] if row_col else []))
    names = named.join(least, "label").select("fp", "component", *(["chosen.uid"] if row_col else []))
    if row_col:
        names = names.withColumnRenamed("uid", "chosen")
    out = sketched.select("id", "n", "fp", *["uid"][: len(numbers)]).join(names, "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("component"))
    kept = F.col("fp").isNull() | (F.col("uid") == F.col("chosen")) if row_col else F.col("id").eqNullSafe(component)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), *([F.col("uid").alias(row_col)] if row_col else []))


def _repeats(rows: DataFrame) -> bool:
    """Whether some row occurs twice with one id: then a class may find its text twice."""
    return not rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
