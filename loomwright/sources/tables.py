"""Tables of entities, tasks, reviews and overrides: reads in their orders, replacement by book, last-wins upserts, migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import kept


def by_book(rows: DataFrame, book=None, order: list[Column] | None = None, **equal) -> DataFrame:
    """Rows of a book with equal columns (status, tier, ...), in the order asked for."""
    if book is not None:
        rows = rows.filter(F.col("book_id") == book)
    for c, v in equal.items():
        if v is not None:
            rows = rows.filter(F.col(c) == v)
    return rows.orderBy(*order) if order else rows


def oldest_pending(tasks: DataFrame) -> DataFrame:
    return tasks.filter("status = 'PENDING'").orderBy("created_at", "id").limit(1)


def stuck(tasks: DataFrame, now: Column, seconds: int) -> DataFrame:
    return tasks.filter((F.col("status") == "RUNNING") & (F.col("updated_at") < now - F.make_dt_interval(secs=F.lit(seconds))))


def review(rows: DataFrame, ids: DataFrame, action: str, status: str, user: str) -> tuple[DataFrame, DataFrame]:
    """The rows with the new status, and the log of transitions."""
    hit = rows.join(ids.select("id").distinct(), "id", "left_semi")
    log = hit.select(F.col("id").alias("entity_id"), F.lit(user).alias("user_id"), F.lit(action).alias("action"), F.col("status").alias("previous_value"), F.lit(status).alias("new_value"))
    marked = rows.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    return marked.withColumn("status", F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status"))).drop("_hit"), log


def upserted(rows: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; ``deleted`` rows go."""
    both = rows.withColumn("_side", F.lit(0)).unionByName(changes.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_side"), F.desc(order)))
    out = both.withColumn("_n", last).filter("_n = 1").drop("_n", "_side")
    return out.filter(~F.coalesce("deleted", F.lit(False))).drop("deleted") if "deleted" in out.columns else out


def replace_books(rows: DataFrame, path: str) -> None:
    """Writes the books in ``rows`` anew and leaves all others alone."""
    rows.write.partitionBy("book_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def parity(a: DataFrame, b: DataFrame) -> dict[str, int]:
    """Row counts, and rows that only one side has."""
    return {"left": a.count(), "right": b.count(), "only_left": a.exceptAll(b).count(), "only_right": b.exceptAll(a).count()}


def fingerprints(rows: DataFrame, key: str, width: int = 1000, columns: list[str] | None = None) -> DataFrame:
    """``range, n, h0 .. h3``: for each range of ``width`` keys the number of its rows and the sums of their hashes.

    Sums hang neither on the order nor on the partitions of the rows, and those of a coarser range are sums of finer ones, so a
    table's fingerprint is made by one aggregation that combines before its shuffle. Repeated rows count each, and nulls are
    values of their own. Two 64-bit hashes under different seeds are summed by halves, which cannot overflow. The rows of a null
    key are a range of their own (null).
    """
    told = F.to_json(F.struct(*(columns or sorted(rows.columns))), {"ignoreNullFields": "false"})
    hashes = [F.xxhash64(F.lit(seed), told) for seed in (17, 71)]
    halves = [x for h in hashes for x in (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))]
    keyed = rows.select(F.floor(F.col(key) / width).cast("long").alias("range"), *[x.alias(f"h{k}") for k, x in enumerate(halves)])
    return keyed.groupBy("range").agg(F.count("*").alias("n"), *[F.sum(f"h{k}").alias(f"h{k}") for k in range(len(halves))])


def coarser(prints: DataFrame, times: int) -> DataFrame:
    """Fingerprints of ranges ``times`` as wide."""
    sums = [c for c in prints.columns if c != "range"]
    return prints.groupBy(F.floor(F.col("range") / times).cast("long").alias("range")).agg(*[F.sum(c).alias(c) for c in sums])


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """``range, left, right``: the ranges whose fingerprints differ, with the rows of either side."""
    sums = [c for c in a.columns if c.startswith("h")]
    right = b.select(F.col("range").alias("_r"), F.col("n").alias("_n"), *[F.col(c).alias(f"_{c}") for c in sums])
    both = a.join(right, F.col("range").eqNullSafe(F.col("_r")), "full")
    same = F.lit(True)
    for c in ("n", *sums):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    zero = F.lit(0).cast("long")
    return both.filter(~same).select(F.coalesce("range", "_r").alias("range"), F.coalesce("n", zero).alias("left"), F.coalesce("_n", zero).alias("right"))


def differing_ranges(a: DataFrame, b: DataFrame, key: str, width: int = 1000, times: int = 16) -> DataFrame:
    """``differing`` of two tables, from coarse to fine: fine ranges are compared only inside coarse ones that differ. Each table is read once."""
    fine = [kept(fingerprints(t, key, width, sorted(a.columns))) for t in (a, b)]
    top = differing(*[coarser(x, times) for x in fine]).select(F.col("range").alias("_top"))
    inside = [x.join(top, F.floor(F.col("range") / times).cast("long").eqNullSafe(F.col("_top")), "left_semi") for x in fine]
    return differing(*inside)


def numbered(rows: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """Rows with their place in a global order, from 1: sorted by ranges, and the partitions' sizes added up; no task sees all rows."""
    in_part = (1 << 33) - 1  # the bits in which Spark's increasing ids count the rows of a partition
    at = kept(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    sizes = at.groupBy(F.shiftright("_at", 33).alias("_p")).agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row a partition
    places = at.withColumn("_p", F.shiftright("_at", 33)).join(F.broadcast(before), "_p")
    return places.withColumn(out, F.col("_before") + F.col("_at").bitwiseAND(in_part) + 1).drop("_p", "_at", "_before")


def count_report(rows: DataFrame, keys: list[str], distinct: str) -> DataFrame:
    """Rows of each key, and how many different values of ``distinct`` they have."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(distinct).alias(f"n_{distinct}"))


def top(rows: DataFrame, by: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group, numbered."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(out) <= n)


def migrate(spark: SparkSession, source: dict[str, str], target: dict[str, str], table: str, keys: list[str] | None = None) -> None:
    """Copies a table between JDBC databases (options of the readers are parameters).

    With ``keys`` rows that the target has already are replaced: what is to stay is written to a staging table of its name and
    ``_migrated``, which the caller swaps in.
    """
    rows = spark.read.format("jdbc").options(**source, dbtable=table).load()
    if keys is None:
        rows.write.format("jdbc").options(**target, dbtable=table).mode("append").save()
        return
    old = spark.read.format("jdbc").options(**target, dbtable=table).load()
    replaced(old, rows, keys).write.format("jdbc").options(**target, dbtable=f"{table}_migrated").mode("overwrite").save()


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``old`` without those whose keys ``new`` has, and ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*new.columns).unionByName(new)


def searched(rows: DataFrame, text: str, order: str = "confidence") -> DataFrame:
    """Rows whose name or aliases hold ``text`` (any case), by confidence, mentions, first chapter (nulls last) or name (Chinese order)."""
    low = F.lit(text.lower())
    hit = F.contains(F.lower("name"), low) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.contains(F.lower(a), low))
    return rows.filter(hit).orderBy(*search_order(order))


def search_order(order: str) -> list[Column]:
    by = {"confidence": F.desc("confidence"), "mentions": F.desc("mention_count"), "first_chapter": F.asc_nulls_last("first_chapter"), "name": F.collate("name", "zh")}[order]
    return [by, F.col("id")]


def stage_progress(tasks: DataFrame, weights: dict[str, int]) -> DataFrame:
    """Progress of each book: the weights of completed stages and half of running ones; dead-lettered counts as failed."""
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    part = F.when(F.col("status") == "COMPLETED", 1.0).when(F.col("status") == "RUNNING", 0.5).otherwise(0.0)
    failed = (F.col("status") == "FAILED") | F.coalesce("dead_lettered", F.lit(False))
    return tasks.groupBy("book_id").agg(F.sum(F.coalesce(F.element_at(w, F.col("stage")), F.lit(0)) * part).alias("progress"), F.max(failed).alias("failed"), F.min(F.col("status") == "COMPLETED").alias("completed"))
