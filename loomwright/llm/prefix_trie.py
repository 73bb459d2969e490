"""The prefix trie of conversations, as the Cartesian tree over the sorted conversations' common prefixes.

A conversation is a row of 16-byte digests of its turns, so that the order of rows is an order of sequences. Sorted by it, the
LCP (turns that a row shares with the row before) tells the trie: a node of depth ``d`` begins at a row ``a`` with
``LCP[a] < d <= length[a]`` and ends before the next row whose LCP is below ``d``. All-nearest-smaller-values give these ends:

* Within a block (a range partition of the sorted rows) a stack finds them in one pass. A stack's entry is a run of depths
  with one interval: equal LCPs are merged into it, the depths between it and its parent are the missing ones, and they are
  only written out at the very end. What a row of smaller LCP closes gets its sums there, as differences of running sums.
* Depths that are open where a block ends look for the first later block whose minimum of LCPs is smaller, by the nearest
  smaller values of the block minima. The blocks in between add their whole, the last one what stands before its first
  smaller LCP. Nodes of one depth are disjoint, so all this is at most a row for each block and depth.

Saved tokens of a subtree are ``(n - 1) * code points`` summed over its nodes: the code points of all members' turns from its
depth on, less those of the turns that some member is the first to have. Both are running sums over the sorted rows.

Only digests, lengths and ids move; no task holds more than a conversation's digests (16 bytes a turn), a stack, and a bounded
piece of a class of equal conversations, whose ids reach the hash of their list piece by piece.

Defined cases: turns are ordered by ``turn`` (null first), ties by the digest of role and text; null role or text is empty;
rows without ``conv_id`` are in no conversation; repeated rows are turns of their own; ``%`` keeps the sign of ``conv_id``; an
empty table has no node. Turns are equal if the first 128 bits of the SHA-256 of role and text are. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, whole_number, written

WIDTH = 16
#: Ids of a class that are held at once; what is beyond goes to the hash in pieces.
IDS = 8192
#: Conversations whose ids share all but the remainder by this borrow the first one's beginning; of less than so many turns.
SHARED, BORROWED = 100, 6
#: Bits of a row's place that count rows within a block (those of Spark's increasing ids).
IN_BLOCK = 33
EMPTY = hashlib.sha256(b"").hexdigest()

_SUMS = ("n", "least", "t", "u", "leaves", "children")
_PIECE = "kind int, block int, a long, lo int, hi int, up long, n long, least long, t long, u long, leaves long, children long, own long, before array<long>, chunked boolean, sha string, ids string, place long"
_NAMES = [x.split()[0] for x in _PIECE.split(", ")]
_TYPES = [{"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "boolean": pa.bool_(), "string": pa.string()}[x.split()[1]] for x in _PIECE.split(", ")]
#: Kinds of rows: a run of depths that is closed or still open where its block ends, what a block adds to a depth that was open before it (closed or not), ids of a class.
CLOSED, OPEN, ENDED, PASSED, CHUNK = range(5)


def borrowed(conv: Column) -> Column:
    """How many first turns a conversation takes from the one it shares them with."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(BORROWED)).cast("int")


def rebuilt(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, key, lens``: the digests of a conversation's turns in one binary, and their code points."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, WIDTH)
    turns = conversations.select(whole_number(conversations, conv_col).alias("conv"), F.struct(F.col(f"`{turn_col}`").isNotNull().alias("k"), F.col(f"`{turn_col}`").alias("turn"), digest.alias("d"), F.length(text).cast("long").alias("n")).alias("x"))
    own = turns.filter("conv is not null").groupBy("conv").agg(F.array_sort(F.collect_list("x")).alias("x")).select("conv", F.transform("x", lambda x: F.struct(x["d"].alias("d"), x["n"].alias("n"))).alias("x"))
    own = written(own, "turns")
    first = own.filter(F.col("conv") % SHARED == 0).select(F.col("conv").alias("base"), F.slice("x", 1, BORROWED - 1).alias("y"))
    rows = own.withColumns({"base": F.col("conv") - F.col("conv") % SHARED, "h": borrowed(F.col("conv"))}).join(first, "base", "left")
    whole = F.concat(F.coalesce(F.slice("y", F.lit(1), F.col("h")), F.array().cast("array<struct<d:binary,n:bigint>>")), F.slice("x", F.col("h") + 1, F.greatest(F.size("x"), F.lit(1))))
    rows = rows.select("conv", whole.alias("z"))
    return rows.select("conv", F.unhex(F.array_join(F.transform("z", lambda z: F.hex(z["d"])), "")).alias("key"), F.col("z.n").alias("lens"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two sequences share from the first on."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int((x != y).argmax()) // WIDTH


@dataclass
class _Run:
    """Depths ``lo`` to ``hi`` that begin at the row ``a``; the sums of the rows before it (of ``u``, up to it)."""

    a: int
    lo: int
    hi: int
    up: int | None
    n: int
    t: int
    u: int
    leaves: int
    least: int
    own: int
    before: list[int]
    children: int = 0
    ends: bool = True
    chunked: bool = False
    sha: str | None = None


@dataclass
class _Block:
    """One pass over the sorted rows of a block."""

    number: int
    head: int  # LCP of the first row with the last of the block before, -1 for none
    tail: int  # that of the next block's first row
    out: list[tuple] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.stack: list[_Run] = []
        self.n = self.t = self.u = self.leaves = 0
        self.least = math.inf
        self.low, self.records = None, []  # least LCP so far, and where it fell: (LCP, sums before, children at that depth)
        self.key, self.ids, self.owner, self.place = b"", [], None, 0

    def emit(self, kind: int, r: _Run, lo: int, hi: int, up: int | None, ends: bool) -> None:
        cut = r.before[lo - r.lo : hi - r.lo + 1]
        self.out.append((kind, self.number, r.a, lo, hi, up, self.n - r.n, r.least, self.t - r.t, self.u - r.u, self.leaves - r.leaves, r.children, r.own, cut, ends and r.chunked, r.sha if ends else None, None, None))

    def flush(self, last: bool) -> None:
        """Ids of the class at hand: into its digest if they are all there, else out as a piece."""
        if not self.ids:
            return
        told = ",".join(map(str, self.ids))
        if last and self.owner is not None and not self.owner.chunked:
            self.owner.sha = hashlib.sha256(told.encode()).hexdigest()
        else:
            a = None if self.owner is None else self.owner.a
            depth = len(self.key) // WIDTH
            if self.owner is not None:
                self.owner.chunked = True
            self.out.append((CHUNK, self.number, a, depth, depth, *[None] * 11, told, self.place))
        self.ids = []

    def close(self, x: int) -> None:
        """Closes the depths above ``x``."""
        least = math.inf
        while self.stack and self.stack[-1].hi > x:
            r = self.stack[-1]
            r.least = min(r.least, least)
            if r.lo > x:
                self.stack.pop()
                self.emit(CLOSED, r, r.lo, r.hi, r.up, r.ends)
                least = r.least
                continue
            self.emit(CLOSED, r, x + 1, r.hi, r.a, r.ends)
            r.before, r.hi, r.children, r.ends, r.chunked, r.sha = r.before[: x - r.lo + 1], x, 1, False, False, None
            return
        if self.stack:
            self.stack[-1].least = min(self.stack[-1].least, least)

    def row(self, at: int, conv: int, key: bytes, lens: list[int]) -> None:
        x = self.head if self.low is None else common(self.key, key)
        size = len(key) // WIDTH
        same = x == size and (self.low is not None or x >= 0)
        if self.low is not None:
            self.leaves += x < len(self.key) // WIDTH
            if not same:
                self.flush(True)
            self.close(x)
        if self.low is None or x < self.low:
            self.low = x
            self.records.append([x, self.n, self.least, self.t, self.u, self.leaves, 0])
        total = sum(lens)
        shared = sum(lens[:x]) if x > 0 else 0
        if same:
            if self.stack and self.stack[-1].hi == x:
                self.stack[-1].least = min(self.stack[-1].least, conv)
        else:
            up = self.stack[-1] if self.stack else None
            if up:
                up.children += 1
            else:
                self.records[-1][-1] += 1
            before, so_far = [], shared
            for d in range(x + 1, size + 1):  # code points up to the depth above d
                before.append(so_far)
                so_far += lens[d - 1] if d > 0 else 0
            self.owner = _Run(at, x + 1, size, up.a if up else None, self.n, self.t, self.u + total - shared, self.leaves, conv, total, before)
            self.stack.append(self.owner)
        if not self.ids:
            self.place = at
        self.ids.append(conv)
        self.key = key
        if len(self.ids) >= IDS:
            self.flush(False)
        self.n, self.t, self.u = self.n + 1, self.t + total, self.u + total - shared
        self.least = min(self.least, conv)

    def end(self) -> list[tuple]:
        self.leaves += self.tail < len(self.key) // WIDTH
        self.flush(False)
        least = math.inf
        for r in reversed(self.stack):
            r.least = min(r.least, least)
            least = r.least
            self.emit(OPEN, r, r.lo, r.hi, r.up, r.ends)
        k = 0
        for d in range(self.head, -1, -1):  # what this block adds to the depths that were open before it
            while k < len(self.records) and self.records[k][0] > d:
                k += 1
            children = self.records[k][-1] if k < len(self.records) and self.records[k][0] == d else 0
            shut = k + (k < len(self.records) and self.records[k][0] == d)
            ended = shut < len(self.records)
            sums = self.records[shut][1:6] if ended else [self.n, self.least, self.t, self.u, self.leaves]
            self.out.append((ENDED if ended else PASSED, self.number, None, d, d, None, sums[0], None if sums[1] == math.inf else sums[1], *sums[2:], children, *[None] * 6))
        return self.out


def _blocks(heads: dict[int, tuple[int, int, int]]):
    """``heads``: for each block its number, the LCP before its first row and that behind its last."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pid = None, None
        for b in batches:
            for at, conv, key, lens in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at >> IN_BLOCK != pid:
                    if block:
                        yield batch(block.end())
                    pid = at >> IN_BLOCK
                    block = _Block(*heads[pid])
                block.row(at, conv, key, lens)
            if block and block.out:
                yield batch(block.out)
                block.out = []
        if block:
            yield batch(block.end())

    return run


def smaller(minima: list[int]) -> list[int]:
    """For each block the next one of a smaller minimum; their number where there is none."""
    out, stack = [len(minima)] * len(minima), []
    for k, m in enumerate(minima):
        while stack and minima[stack[-1]] > m:
            out[stack.pop()] = k
        stack.append(k)
    return out


def _spans(minima: list[int]):
    """The blocks behind its own that an open depth reaches, up to that which ends it."""
    jump = smaller(minima)

    @F.arrow_udf("array<int>")
    def run(block: pa.Array, depth: pa.Array) -> pa.Array:
        out = []
        for b, d in zip(block.to_pylist(), depth.to_pylist(), strict=True):
            t = b + 1
            while t < len(minima) and minima[t] >= d:
                t = jump[t]
            out.append(list(range(b + 1, min(t, len(minima) - 1) + 1)))
        return pa.array(out, pa.list_(pa.int32()))

    return run


def _heads(rows: DataFrame) -> tuple[dict[int, tuple[int, int, int]], int]:
    """For each block that has rows: number, LCP before and behind. Two keys a block meet in a window over the blocks; numbers come to the driver."""

    @F.arrow_udf("int")
    def lcp(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([-1 if x is None else common(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())

    ends = rows.groupBy(F.shiftright("at", IN_BLOCK).cast("int").alias("pid")).agg(F.min_by("key", "at").alias("first"), F.max_by("key", "at").alias("last"))
    told = ends.select("pid", lcp(F.lag("last").over(Window.orderBy("pid")), "first").alias("x")).orderBy("pid").collect()
    heads = [r["x"] for r in told]
    return {r["pid"]: (k, heads[k], heads[k + 1] if k + 1 < len(heads) else -1) for k, r in enumerate(told)}, len(told)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes the pieces of each class in their order."""
    last, sha = None, hashlib.sha256()
    for b in batches:
        for a, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if a != last:
                if last is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([sha.hexdigest()])], names=["a", "sha"])
                last, sha = a, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([sha.hexdigest()])], names=["a", "sha"])


def runs(rows: DataFrame) -> DataFrame:
    """Runs of depths with one interval each: ``a, lo, hi, up, n, least, t, u, leaves, children, own, before, sha``; ``rows`` are those of ``rebuilt``."""
    place = F.monotonically_increasing_id()
    rows = written(rows.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").select(place.alias("at"), "conv", "key", "lens"), "sorted")
    heads, n_blocks = _heads(rows.select("at", "key"))
    dealt = rows.repartition(F.shiftright("at", IN_BLOCK)).sortWithinPartitions("at").select("at", "conv", "key", "lens")
    told = written(dealt.mapInArrow(_blocks(heads), _PIECE), "pieces")

    # Depths that stay open, with what the blocks behind add to them.
    low = {r["block"]: r["d"] for r in told.filter(F.col("kind") == ENDED).groupBy("block").agg(F.min("lo").alias("d")).collect()}
    by_number = {k: x for k, x, _ in heads.values()}
    minima = [low[k] - 1 if k in low else by_number[k] for k in range(n_blocks)]
    each = F.posexplode(F.sequence("lo", "hi")).alias("i", "d")
    sums = [c for c in _SUMS if c != "children"]
    apart = told.filter(F.col("kind") == OPEN).select("*", each)
    top = F.col("d") == F.col("hi")
    apart = apart.select(
        "block", "a", "d", F.when(F.col("i") > 0, F.col("a")).otherwise(F.col("up")).alias("up"), (F.col("up").isNull() & (F.col("i") == 0)).alias("inherits"), *sums,
        F.when(top, F.col("children")).otherwise(1).alias("children"), "own", F.get("before", F.col("i")).alias("b"), (top & F.col("chunked")).alias("chunked"),
        F.when(top, F.col("sha")).alias("sha"),
    )
    reach = written(apart.select("a", "d", F.explode(_spans(minima)("block", "d")).alias("block")), "reach")
    entries = told.filter(F.col("kind").isin(ENDED, PASSED)).select("block", F.col("lo").alias("d"), *[F.col(c).alias(f"{c}_") for c in _SUMS])
    added = reach.join(entries, ["block", "d"]).groupBy("a", "d").agg(*[(F.min if c == "least" else F.sum)(f"{c}_").alias(f"{c}_") for c in _SUMS])
    plus = lambda c: F.least(c, f"{c}_").alias(c) if c == "least" else (F.col(c) + F.coalesce(f"{c}_", F.lit(0))).alias(c)
    opened = apart.join(added, ["a", "d"], "left").select("block", "a", F.col("d").alias("lo"), F.col("d").alias("hi"), "up", "inherits", *[plus(c) for c in _SUMS], "own", F.array("b").alias("before"), "chunked", "sha")
    closed = told.filter(F.col("kind") == CLOSED).select("block", "a", "lo", "hi", "up", F.col("up").isNull().alias("inherits"), *_SUMS, "own", "before", "chunked", "sha")
    every = closed.unionByName(opened)

    # The owners of the depths that a block found open: parents of what begins in it, and of the classes that go on in it.
    owners = reach.select(F.col("block").alias("b_"), F.col("d").alias("d_"), F.col("a").alias("a_"))
    found = every.filter("inherits").join(owners, (F.col("block") == F.col("b_")) & (F.col("lo") - 1 == F.col("d_")), "left").withColumn("up", F.col("a_"))
    every = every.filter("not inherits").unionByName(found.select(*every.columns))
    chunks = told.filter(F.col("kind") == CHUNK).select("block", "a", F.col("hi").alias("d"), "ids", "place")
    joined = chunks.join(owners, (F.col("block") == F.col("b_")) & (F.col("d") == F.col("d_")) & F.col("a").isNull(), "left").select(F.coalesce("a", "a_").alias("a"), "ids", "place")
    shas = joined.repartition("a").sortWithinPartitions("a", "place").select("a", "ids").mapInArrow(_hashed, "a long, sha string").withColumnsRenamed({"sha": "s_", "a": "a_"})
    late = every.filter("chunked").join(shas, F.col("a") == F.col("a_"), "left").withColumn("sha", F.col("s_"))
    return every.filter("not chunked").unionByName(late.select(*every.columns)).drop("block", "inherits", "chunked")


def trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    prepare(conversations.sparkSession)
    every = written(runs(rebuilt(conversations, conv_col, turn_col, role_col, text_col)), "runs")
    parents = every.select(F.col("a").alias("a_"), F.col("hi").alias("d_"), F.col("least").alias("parent"))
    rows = every.join(parents, (F.col("up") == F.col("a_")) & (F.col("lo") - 1 == F.col("d_")), "left").select("*", F.posexplode(F.sequence("lo", "hi")).alias("i", "d"))
    before = F.get("before", F.col("i"))
    saved = (F.col("t") - F.col("n") * before) - (F.col("u") + F.col("own") - before)
    last = F.col("d") == F.col("hi")
    return rows.select(
        F.col("least").alias("conv_id"), F.col("d").cast("long").alias("depth"), F.when(F.col("i") > 0, F.col("least")).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"),
        F.coalesce(F.when(last, F.col("sha")), F.lit(EMPTY)).alias("ends_sha256"),
    )
