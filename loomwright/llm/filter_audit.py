"""Audit of how filters overlap, by inclusion and exclusion.

For each part of a table and each of the 32 subsets ``S`` of the five filters, ``N(S)`` counts the documents that fail every
filter of ``S`` (the sum of the product of their flags). All that an audit asks follows from these 32 numbers:

* a set of filters removes ``V(S)``, the sum of the Harsanyi dividends ``(-1)^(|T|+1) N(T)`` of its non-empty subsets ``T``
  (the Moebius inversion), so what survives is ``N({}) - V(S)``, and a step removes ``V(before + f) - V(before)``;
* a filter is redundant on ``N({f})`` less what it removes, and alone on ``V(all) - V(all but f)``;
* its Shapley value is the sum of its dividends ``/ |T|``; over all 120 orders that is a sum of whole numbers.

So the work over the documents does not depend on the number of orders. Flags come from the texts in one pass, and only
``(part, id, flags, digest of the text)`` moves on. The flag of a repeated text (E) needs no window over a group of copies: its
rows are told by their number less those whose id is the least of the group, which come from a plain minimum for each digest.

Filters: A under 50 words; B ``100 * distinct words < 65 * words``; C ``100 * [A-Z] > 5 * code points``; D any of ``#$%&*|``;
E equal to the text of a smaller id, anywhere in the table.

Defined cases: null text is empty (so it fails A only, and E where a smaller id is empty too); a null part is the empty
string; a null id is neither smaller nor larger than another, so it never fails E and has no labels; repeated rows count each;
of several labels of one id the positive one counts, null labels do not; an empty table has no parts and no rows. Texts are
compared by SHA-256 over the whole. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_number, written

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 50, 65, 5, r"[#$%&*|]"
_WHITE = " \t\n\x0b\x0c\r"
#: Orders in which a filter can stand, over which the Shapley value is summed.
ORDERS = 120


def flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, id, digest, bits, n``: the failures of A to D as bits, with how often such a row stands there."""
    rows = docs.select(F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), whole_number(docs, id_col).alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("w", F.split(F.translate(F.col("t"), _WHITE, " " * len(_WHITE)), " "))
    rows = rows.withColumns({"words": F.size(F.array_remove("w", "")), "distinct": F.size(F.array_remove(F.array_distinct("w"), ""))})
    told = (
        F.col("words") < LEAST_WORDS,
        100 * F.col("distinct") < LEAST_DISTINCT * F.col("words"),
        100 * F.regexp_count("t", F.lit("[A-Z]")) > MOST_CAPITALS * F.length("t"),
        F.col("t").rlike(MARKS),
    )
    bits = reduce(lambda a, b: a + b, [F.when(x, 1 << k).otherwise(0) for k, x in enumerate(told)])
    rows = rows.select("part", "id", F.unhex(F.sha2("t", 256)).alias("digest"), bits.alias("bits"))
    return rows.groupBy("part", "id", "digest", "bits").agg(F.count("*").alias("n"))


def labelled(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, good, toxic`` as 0 or 1, a row an id."""
    rows = labels.select(whole_number(labels, id_col).alias("id"), *[F.coalesce((F.col(c) == v).cast("int"), F.lit(0)).alias(x) for x, c, v in (("good", "quality", 1), ("toxic", "toxic", 1))])
    return rows.filter("id is not null").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))


def joint_failures(told: DataFrame, labels: DataFrame) -> DataFrame:
    """``part`` and ``n``, for each of the 32 subsets (by its bits) the documents that fail all its filters: all, good and toxic ones.

    ``told`` is that of ``flags``, ``labels`` that of ``labelled``.
    """
    told = told.join(labels, "id", "left").select("part", "id", "digest", "bits", *[(F.col("n") * c).alias(x) for x, c in (("n", F.lit(1)), ("g", F.coalesce("good", F.lit(0))), ("x", F.coalesce("toxic", F.lit(0))))])
    told = written(told, "flags")
    first = told.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    # Failing E is one bit more; an id meets the least of its text in a join on both, so a large group of copies is no hot key.
    patterns = told.join(first, ["digest", "id"], "left").withColumn("bits", F.col("bits") + F.when(F.col("first") | F.col("id").isNull(), 0).otherwise(1 << FILTERS.index("E")))
    patterns = patterns.groupBy("part", "bits").agg(*[F.sum(c).alias(c) for c in "ngx"])
    subset = F.col("s")
    product = reduce(lambda a, b: a * b, [F.when((subset.bitwiseAND(1 << k) == 0) | (F.col("bits").bitwiseAND(1 << k) != 0), 1).otherwise(0) for k in range(len(FILTERS))])
    sums = patterns.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(ALL)))).withColumn("f", product)
    sums = sums.groupBy("part", "s").agg(*[F.sum(F.col(c) * F.col("f")).alias(c) for c in "ngx"])
    return sums.groupBy("part").agg(*[F.array_sort(F.collect_list(F.struct("s", c))).getField(c).alias(c) for c in "ngx"])


def _removed(joint: str) -> Column:
    """``V(S)`` for each subset: the sum of the dividends of its non-empty subsets."""
    whole = F.sequence(F.lit(0), F.lit(ALL))
    sign = lambda t: F.when(F.bit_count(t) % 2 == 1, 1).otherwise(-1)
    return F.transform(whole, lambda s: F.aggregate(whole, F.lit(0).cast("long"), lambda acc, t: acc + F.when((t > 0) & (t.bitwiseAND(s) == t), sign(t) * F.get(F.col(joint), t)).otherwise(F.lit(0).cast("long"))))


def _shapley() -> Column:
    """For each filter 120 times its Shapley value: its dividends, each shared by the filters of its subset."""
    out = []
    for k in range(len(FILTERS)):
        terms = [(-1) ** (s.bit_count() + 1) * (ORDERS // s.bit_count()) * F.col("n")[s] for s in range(1, ALL + 1) if s >> k & 1]
        out.append(reduce(lambda a, b: a + b, terms))
    return F.array(*out)


def orders() -> list[tuple[str, int, int, int]]:
    """``(order, step, bit of its filter, bits of the filters before it)`` for all orders and steps."""
    out = []
    for p in permutations(FILTERS):
        before = 0
        for step, f in enumerate(p, 1):
            bit = 1 << FILTERS.index(f)
            out.append(("".join(p), step, bit, before))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step: ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``."""
    joint = joint_failures(flags(docs, id_col, text_col, part_col), labelled(labels))
    parts = joint.select("part", "n", _shapley().alias("shares"), *[_removed(c).alias(f"v{c}") for c in "ngx"])
    names, steps, bits, before = (F.lit(list(x)) for x in zip(*orders(), strict=True))
    rows = parts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(ORDERS * len(FILTERS) - 1))))  # 600 rows a part are the result
    rows = rows.withColumns({"filter_order": F.get(names, F.col("i")), "step": F.get(steps, F.col("i")), "bit": F.get(bits, F.col("i")), "before": F.get(before, F.col("i"))})
    upto = F.col("before").bitwiseOR(F.col("bit"))
    gained = lambda c: F.get(F.col(c), upto) - F.get(F.col(c), F.col("before"))
    own, others = F.get(F.col("n"), F.col("bit")), F.lit(ALL).bitwiseXOR(F.col("bit"))
    return rows.select(
        "part", "filter_order", "step",
        (F.col("n")[0] - F.get(F.col("vn"), upto)).alias("kept"),
        gained("vn").alias("removed"),
        (own - gained("vn")).alias("redundant"),
        (F.col("vn")[ALL] - F.get(F.col("vn"), others)).alias("unique_fails"),
        gained("vg").alias("good_lost"),
        gained("vx").alias("toxic_lost"),
        F.get(F.col("shares"), F.bit_count(F.col("bit") - 1)).alias("shapley"),
    )
