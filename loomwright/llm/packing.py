"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

A document's ids (plus one end id) are cut into pieces only if they exceed a sequence; full pieces are sequences already.
The other pieces are dealt at random into groups of bounded size. A group is packed by several islands, each a population
of packings that evolves in a task of its own. People start as best fits of random orders, and on one island as the best fit
by decreasing length too, below which a group so never ends. Crossover injects whole well-filled bins of one parent into the
other, removes the bins that hold duplicates, and puts displaced pieces back by best fit; mutation empties the least filled
bins. Fewer bins count first and then fuller ones, so all generations are run, also where the least number of bins is met:
what they gain then is room left in fewer bins. After each epoch an island's elite migrates to the next island. Pieces of the
bins that a level leaves unfilled are dealt again into fewer groups, level by level, so the groups' remainders do not add up.

Defined cases: null text is empty and gives the end id alone; repeated rows are packed one by one; a piece never exceeds
a sequence; ids are whole numbers (others are refused). Extra columns are not read.
"""

from __future__ import annotations

import math
import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import enter, prepare, whole_number, written
from .encoding import MEMO, encoder

CAPACITY, END_ID = 4096, 1
GROUP, ISLANDS, POPULATION, GENERATIONS, EPOCHS = 2048, 3, 4, 12, 2
#: Bins filled to at least this share keep their pieces; those of the others go to the next level.
FILLED = 0.985

Bins = list[list[int]]


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, spaces_matter: bool = False, memo: int = MEMO) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary, spaces_matter, memo), end_id.to_bytes(4, "little")
        for b in batches:
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode_many(b.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(whole_number(docs, id_col).alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], items: list[int], bins: Bins, capacity: int) -> None:
    """Puts each item, in the order given, into the fullest bin that has room, else into a new one."""
    free = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in items:
        at = bisect_left(free, (sizes[i], -1))
        if at < len(free):
            room, k = free.pop(at)
            bins[k].append(i)
            insort(free, (room - sizes[i], k))
        else:
            bins.append([i])
            insort(free, (capacity - sizes[i], len(bins) - 1))


def fitness(sizes: list[int], bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (the mean square fill, negated); less is better."""
    return len(bins), -sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(sizes: list[int], a: Bins, b: Bins, capacity: int, rng: random.Random) -> Bins:
    """Well-filled bins of ``b`` go whole into ``a``; pieces displaced by them return by best fit, largest first."""
    order = sorted(range(len(b)), key=lambda k: -sum(sizes[i] for i in b[k]))
    pool = order[: max(1, len(b) // 2)]
    chosen = [b[k] for k in rng.sample(pool, rng.randint(1, max(1, len(pool) // 2)))]
    injected = {i for x in chosen for i in x}
    kept, displaced = [], []
    for x in a:
        if injected.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [i for i in x if i not in injected]
    child = [list(x) for x in chosen] + kept
    best_fit(sizes, sorted(displaced, key=lambda i: -sizes[i]), child, capacity)
    return child


def mutate(sizes: list[int], a: Bins, capacity: int, rng: random.Random) -> Bins:
    """Empties the least filled bins and a few others."""
    order = sorted(range(len(a)), key=lambda k: sum(sizes[i] for i in a[k]))
    gone = set(order[: max(1, len(a) // 50)]) | {k for k in range(len(a)) if rng.random() < 0.03}
    child = [list(x) for k, x in enumerate(a) if k not in gone]
    displaced = [i for k in gone for i in a[k]]
    rng.shuffle(displaced)
    best_fit(sizes, sorted(displaced, key=lambda i: -sizes[i] * rng.uniform(0.9, 1)), child, capacity)
    return child


@dataclass
class Evolution:
    """An island's elite, and how it came about: fitness of the best seed, children made, and children that became the elite."""

    elite: Bins
    seed: tuple[int, float]
    children: int
    gains: int


def decreasing(sizes: list[int], capacity: int) -> Bins:
    """Best fit by decreasing size."""
    bins: Bins = []
    best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), bins, capacity)
    return bins


def evolve(sizes: list[int], seed: int, immigrants: list[Bins], capacity: int = CAPACITY, population: int = POPULATION, generations: int = GENERATIONS) -> Evolution:
    """An island after some generations, each of one child, which takes the place of the worst unless it is alike or worse."""
    rng = random.Random(seed)
    people = [list(map(list, x)) for x in immigrants]
    while len(people) < population:
        order = list(range(len(sizes)))
        rng.shuffle(order)
        bins: Bins = []
        best_fit(sizes, order, bins, capacity)
        people.append(bins)
    ranked = sorted(((fitness(sizes, x, capacity), k, x) for k, x in enumerate(people)), key=lambda t: t[:2])
    first, gains = ranked[0][0], 0
    for turn in range(generations):
        a, b = rng.sample(ranked, 2)
        child = crossover(sizes, a[2], b[2], capacity, rng) if rng.random() < 0.75 else mutate(sizes, min(a, b, key=lambda t: t[:2])[2], capacity, rng)
        fit = fitness(sizes, child, capacity)
        gains += fit < ranked[0][0]
        if fit < ranked[-1][0] and all(fit != r[0] for r in ranked):
            ranked[-1] = (fit, len(people) + turn, child)
            ranked.sort(key=lambda t: t[:2])
    return Evolution(ranked[0][2], first, generations, gains)


def _island(capacity: int, epoch: int):
    """Rows ``g, island, pids, sizes, elites``; ``elites`` are bin numbers of the pieces, one array an immigrant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("packing")
        for batch in batches:
            for row in batch.to_pylist():
                sizes = row["sizes"]
                immigrants = [decreasing(sizes, capacity)] if epoch == 0 and row["island"] == 0 else []
                for places in row["elites"] or []:
                    bins: Bins = [[] for _ in range(max(places) + 1)]
                    for i, k in enumerate(places):
                        bins[k].append(i)
                    immigrants.append(bins)
                told = evolve(sizes, (row["g"] * 31 + row["island"]) * 31 + epoch, immigrants, capacity)
                places = [0] * len(sizes)
                for k, b in enumerate(told.elite):
                    for i in b:
                        places[i] = k
                n, fill = fitness(sizes, told.elite, capacity)
                made = {"g": row["g"], "island": row["island"], "pids": row["pids"], "sizes": sizes, "places": places, "n": n, "fill": fill}
                yield pa.RecordBatch.from_pylist([made | {"seed_n": told.seed[0], "seed_fill": told.seed[1], "children": told.children, "gains": told.gains}], schema=_STATE)

    return run


_STATE = pa.schema(
    [("g", pa.int64()), ("island", pa.int32()), ("pids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("n", pa.int64()), ("fill", pa.float64())]
    + [("seed_n", pa.int64()), ("seed_fill", pa.float64()), ("children", pa.int64()), ("gains", pa.int64())]
)
_STATE_SQL = "g long, island int, pids array<long>, sizes array<int>, places array<int>, n long, fill double, seed_n long, seed_fill double, children long, gains long"


def _packed(items: DataFrame, groups: int, capacity: int, level: int, report: list[DataFrame] | None) -> DataFrame:
    """``pid, length, g, bin`` of the best packing of each group; ``report`` gets a table of the islands' evolutions an epoch."""
    dealt = items.withColumn("g", F.pmod(F.xxhash64("pid", F.lit(level)), F.lit(groups)))
    whole = dealt.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("pid", F.col("length").cast("int").alias("length")))).alias("x"))
    state = whole.select("g", F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])).alias("island"), F.col("x.pid").alias("pids"), F.col("x.length").alias("sizes"))
    state = state.withColumn("elites", F.lit(None).cast("array<array<int>>"))
    for epoch in range(EPOCHS):
        # One row an island, dealt over the tasks whatever group it belongs to.
        spread = state.repartition(F.col("g"), F.col("island"))
        evolved = written(spread.mapInArrow(_island(capacity, epoch), _STATE_SQL), f"epoch{epoch}")
        if report is not None:
            report.append(evolved.select(F.lit(level).alias("level"), F.lit(epoch).alias("epoch"), "g", "island", "seed_n", "seed_fill", "n", "fill", "children", "gains"))
        if epoch + 1 < EPOCHS:
            elite = evolved.select("g", ((F.col("island") + 1) % ISLANDS).cast("int").alias("island"), F.col("places").alias("guest"))
            state = evolved.join(elite, ["g", "island"]).select("g", "island", "pids", "sizes", F.array("places", "guest").alias("elites"))
    best = evolved.groupBy("g").agg(F.min(F.struct("n", "fill", "island")).alias("m")).select("g", F.col("m.island").alias("island"))
    chosen = evolved.join(best, ["g", "island"])
    return chosen.select("g", F.explode(F.arrays_zip("pids", "sizes", "places")).alias("z")).select(F.col("z.pids").alias("pid"), F.col("z.sizes").alias("length"), "g", F.col("z.places").alias("bin"))


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP, report: list[DataFrame] | None = None) -> DataFrame:
    """``pid, sequence_id, offset`` for rows ``pid, length`` with unique ``pid`` and lengths of 1 to ``capacity``.

    ``report`` gets tables ``level, epoch, g, island, seed_n, seed_fill, n, fill, children, gains``: bins and mean square fill
    (negated) of each island's best seed and of its elite, children made, and children that became the elite.
    """
    full = items.filter(F.col("length") >= capacity).select("pid", (-F.col("pid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, level, done = items.filter(F.col("length") < capacity).select("pid", "length"), 0, []
    left = rest.count()
    while left:
        groups = max(1, math.ceil(left / group))
        packed = written(_packed(rest, groups, capacity, level, report), f"level{level}")
        fills = packed.groupBy("g", "bin").agg(F.sum("length").alias("fill"))
        packed = packed.join(fills, ["g", "bin"])
        if groups > 1:
            again = packed.filter(F.col("fill") < FILLED * capacity).select("pid", F.col("length").cast("long").alias("length"))
            n = again.count()
            if n <= left // 2:
                done.append((level, packed.filter(F.col("fill") >= FILLED * capacity)))
                rest, left, level = again, n, level + 1
                continue
        done.append((level, packed))
        break
    order = Window.partitionBy("sequence_id").orderBy("pid")
    out = full
    for k, packed in done:
        named = packed.select("pid", "length", (F.lit(k << 58) + F.shiftleft("g", 20) + F.col("bin")).alias("sequence_id"))
        out = out.unionByName(named.select("pid", "sequence_id", (F.sum("length").over(order) - F.col("length")).alias("offset")))
    return out


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, memo: int = MEMO, report: list[DataFrame] | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece (``report``: as for ``pack``)."""
    prepare(docs.sparkSession)
    made = written(pieces(docs, vocabulary, capacity=capacity, memo=memo).withColumn("pid", F.monotonically_increasing_id()), "pieces")
    return made.join(pack(made, capacity, report=report), "pid").drop("pid")
