"""Registered queries against SQL where one book holds tens of thousands of entities: what grows with the square of a group ends by time."""

from __future__ import annotations

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from loomwright.operators import assembly, resolution
from loomwright.plans import catalog_books  # noqa: F401  registers its queries
from loomwright.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def one_book(spark, tmp_path_factory):
    """The folder of customers and suppliers of a single nation."""
    at = str(tmp_path_factory.mktemp("one"))
    k = F.col("id")
    spark.range(30_000).select(k.alias("c_custkey"), F.lit(3).alias("c_nationkey")).write.parquet(f"{at}/customer.parquet")
    spark.range(30_000).select(k.alias("s_suppkey"), F.lit(3).alias("s_nationkey")).write.parquet(f"{at}/supplier.parquet")
    return at


@pytest.mark.parametrize("name", ["asset_warnings", "asset_prompts", "story_assets", "fused_characters", "packs_by_names"])
def test_one_book(spark, one_book, name):
    began = time.time()
    df = QUERIES[name](spark, one_book)
    got = sorted(repr(tuple(r)) for r in df.collect())
    assert time.time() - began < 90
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{one_book}/{t}.parquet/*.parquet'")
    rel = con.sql(ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in df.columns]
    want = sorted(repr(tuple(r[k] for k in at)) for r in rel.fetchall())
    assert len(want) > 0 and got == want


def test_fused_rows_of_one_name(spark):
    """Every row of the model meets the least of all scanned rows of its name, and no other."""
    k, none = F.col("id"), F.array().cast("array<string>")
    rows = spark.range(100_000).select(F.lit("b").alias("book_id"), k.alias("seq"), F.lit("萧炎").alias("name"), none.alias("aliases"), F.lit(0).cast("long").alias("mention_count"))
    scanned = spark.range(100_000).select(F.lit("b").alias("book_id"), (k + 7).alias("seq"), F.lit("萧炎哥").alias("name"), none.alias("aliases"), (k + 5).alias("total_count"), F.array(k.cast("int")).alias("all_chapters"))
    began = time.time()
    got = resolution.fused(rows, scanned).groupBy("aliases", "mention_count", "chapters").count().collect()
    assert [tuple(r) for r in got] == [(["萧炎哥"], 5, [0], 100_000)]
    assert time.time() - began < 60


def test_packs_of_any_names(spark):
    """Against all pairs of entities and packs, names and aliases being null or equal in other cases too."""
    rng = random.Random(6)
    some = lambda: rng.choice(["a", "A ", "b", "B", "c", "d", "", None])
    make = lambda: [(rng.choice(["x", "y", None]), some(), rng.choice([None, [some() for _ in range(rng.randint(0, 3))]])) for _ in range(14)]
    low = lambda s: None if s is None else s.strip(" ").lower()
    for _ in range(4):
        ents, described = make(), make()
        told = set()
        for book, name, aliases in ents:
            for other, pack, more in described:
                shared = {low(x) for x in [name, *(aliases or [])]} & {low(x) for x in [pack, *(more or [])]} - {None}
                foreign = None not in (name, pack) and low(pack) != low(name) and any(b == book and low(n) == low(pack) for b, n, _ in ents if n is not None)
                if book is not None and book == other and shared and not foreign:
                    told.add((book, name, pack))
        schema = "book_id string, name string, aliases array<string>"
        got = [tuple(r) for r in assembly.packs_of(spark.createDataFrame(ents, schema), spark.createDataFrame(described, schema)).collect()]
        assert len(got) == len(set(got)) and set(got) == told


def test_many_books_share_a_task(spark):
    """Books of a partition are told apart and in the order of ``seq``, nulls included; none costs a table of its own."""
    rng, strings = random.Random(7), "array<string>"
    names = ["萧炎", "萧炎哥", "药老", "张三", "张三丰", "几名护卫", "李伟", "老李伟"]
    rows = [(rng.choice(["a", "b", "c", None, "d"]), s if s % 9 else None, rng.choice(names), rng.choice([None, [], ["炎儿", "他"], ["药尘"]]), rng.choice([0.2, 0.5, float("nan")]) if s < 1 else 0.5, rng.choice([None, 3])) for s in range(60)]
    rows = list({(r[0], r[1]): r for r in rows}.values())  # one null of seq a book, which comes last
    df = spark.createDataFrame(rows, f"book_id string, seq long, name string, aliases {strings}, confidence double, first_chapter int").repartition(5)
    rest = {"description": F.lit(None).cast("string"), "last_chapter": F.lit(None).cast("int"), "chapter_appearances": F.array(F.lit(1)), "mention_count": F.lit(1).cast("long"), "dialogue_count": F.lit(0).cast("long"), "co_characters": F.lit(None).cast(strings), "outfits": F.array(F.struct(F.col("name").alias("description"), F.lit("s").alias("scene"), F.lit(1).alias("first_chapter"), F.lit(2).alias("last_chapter")))}
    out = resolution.resolve(df.withColumns(rest))
    want = []
    for book in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == book), key=lambda r: (r[1] is None, r[1]))
        told = [{"book_id": book, "seq": s, "name": n, "aliases": a or [], "description": None, "confidence": None if c != c else c, "first_chapter": f, "last_chapter": None, "chapter_appearances": [1], "mention_count": 1, "dialogue_count": 0, "co_characters": [], "outfits": [{"description": n, "scene": "s", "first_chapter": 1, "last_chapter": 2}]} for _, s, n, a, c, f in mine]
        want += [repr([e[k] for k in out.columns]) for e in resolution.resolve_fold(told)]
    assert sorted(repr([r[k] for k in out.columns]) for r in (x.asDict(recursive=True) for x in out.collect())) == sorted(want)
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
