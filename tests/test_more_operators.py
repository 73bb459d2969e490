from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import assembly as M, scoring as C, segmentation as S


def test_cleaned_descriptions(spark):
    cases = {"身材高大，他被": "身材高大", "身材高大，反将一": "身材高大", "冷笑冷笑，穿黑衣": "冷笑，穿黑衣", "被": None, "  a   b ": "a b", "高大，他被，她把": "高大", "": None, "完整。": "完整。"}
    df = spark.createDataFrame(list(cases.items()), "d string, want string")
    assert all(r["x"] == r["want"] for r in df.select("want", T.cleaned_description(F.col("d")).alias("x")).collect()), df.select("d", T.cleaned_description(F.col("d"))).collect()


def test_one_chapter(spark):
    docs = spark.createDataFrame([(1, "第一章 a\nx\n第一章 a\ny")], "doc_id int, text string")
    r = S.chapter_text(docs, S.chapters(docs), 1).first()
    assert (r["start_line"], r["content"]) == (3, "第一章 a\ny")


def test_model_entities(spark):
    seen = spark.createDataFrame([("b", "item", "Lamp", 9, [1, 2], ["light"])], "book_id string, type string, text string, total_count long, all_chapters array<int>, aliases array<string>")
    told = spark.createDataFrame([("b", "item", "LIGHT", [], None, None, [5]), ("b", "item", "new", [], 0.4, 3, None)], "book_id string, type string, name string, aliases array<string>, confidence double, first_chapter int, chapter_appearances array<int>")
    got = {r["text"]: (r["confidence"], r["total_count"], r["all_chapters"], r["chapter_index"]) for r in C.model_entities(told, seen).collect()}
    assert got == {"LIGHT": (0.7, 9, [1, 2, 5], 1), "new": (0.4, 1, [], 3)}


def test_packs_by_overlap(spark):
    ents = spark.createDataFrame([("b", "Ann", ["A", "Bob"]), ("b", "Bob", [])], "book_id string, name string, aliases array<string>")
    packs = spark.createDataFrame([("b", "a", []), ("b", "BOB", [])], "book_id string, name string, aliases array<string>")
    assert {(r["name"], r["pack_name"]) for r in M.packs_of(ents, packs).collect()} == {("Ann", "a"), ("Bob", "BOB")}


def test_visual_fields(spark):
    order = ("hair", "eyes", "robe")
    df = spark.createDataFrame([({"hair": "black", "robe": "r" * 200}, {"hair": "white hair", "eyes": "blue", "robe": "red robe"}, "with White Hair")], "s map<string, string>, t map<string, string>, d string")
    r = df.select(*[c.alias(k) for k, c in M.visual_fields(F.col("s"), F.col("t"), order).items()], M.protected_conflict(F.col("s"), F.col("t"), F.col("d"), order).alias("x")).first()
    assert (r["fields"], r["inferred"], r["summarized"], r["x"]) == ({"hair": "black", "eyes": "blue", "robe": "red robe"}, ["eyes"], ["robe"], True)


def test_asset_prompts(spark):
    a = spark.createDataFrame([("s", "character", "Ann", None, "missing")], "story_id string, asset_type string, name string, description string, quality string")
    p = M.asset_prompts(a).first()["prompt"]
    assert p.startswith("Ann，四视图") and "未描述" in p and "⚠" in p
