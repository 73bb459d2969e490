import random
import time

from pyspark.sql import functions as F

from loomwright.functions.text import description_sentences
from loomwright.operators import assembly as M, narrative as L

TITLED = "book_id string, chapter_index int, title string, content string"
EVENT = "book_id string, chapter_index int, position int, text string, source string, confidence double"


def five(spark):
    ch = spark.createDataFrame([("b", 5, "五", "葛叶提出解除婚约。众人哗然不已。"), ("b", 6, "六", "萧炎写下休书一封。"), ("b", 9, "九", "药老从戒指里现身了。")], TITLED)
    ev = spark.createDataFrame([("b", 5, 10, "葛叶拿出聚气散", "regex", 0.8), ("b", 5, 1, "葛叶请求解除婚约", "regex", 0.9), ("b", 6, 3, "萧炎写下休书", "regex", 0.8), ("b", 6, 9, "萧炎立下三年之约", "regex", 0.7), ("b", 9, 2, "药老现身", "llm", 0.9)], EVENT)
    return ch, ev


def test_events_and_arcs(spark):
    ch, ev = five(spark)
    people = spark.createDataFrame([("b", 5, "葛叶"), ("b", 6, "萧炎"), ("b", 9, "药老")], "book_id string, chapter_index int, text string")
    rows = L.events(ev, ch, people).orderBy("ordinal").collect()
    assert [(r["text"], r["event_type"], r["function"]) for r in rows] == [("葛叶请求解除婚约", "conflict", "inciting"), ("葛叶拿出聚气散", "resource", "escalation"), ("萧炎写下休书", "conflict", "turning_point"), ("萧炎立下三年之约", "turning_point", "turning_point"), ("药老现身", "reveal", "inciting")]
    assert rows[0]["evidence"] == "葛叶提出解除婚约" and rows[0]["participants"] == ["葛叶"] and rows[0]["trigger"] == "解除婚约"
    arcs = L.arcs(L.events(ev, ch)).orderBy("arc").collect()
    assert [(r["start_chapter"], r["end_chapter"], r["title"], r["arc_type"], r["n_events"]) for r in arcs] == [(5, 6, "退婚冲突", "conflict", 4), (9, 9, "戒指秘密", "reveal", 1)]
    assert arcs[0]["confidence"] == 0.84 and arcs[0]["core_conflict"] == "葛叶请求解除婚约"
    spots = spark.createDataFrame([("b", 5, "大厅", 0.9)], "book_id string, chapter_index int, text string, confidence double")
    named = people.withColumn("confidence", F.lit(0.9))
    seg = L.arc_segments(L.arcs(L.events(ev, ch)), ch, named, spots).orderBy("arc").collect()
    assert seg[0]["main"] in ("葛叶", "萧炎") and seg[0]["locations"] == ["大厅"] and seg[0]["turning_points"][0] == "葛叶请求解除婚约"


def test_fallback_segments(spark):
    rows = [("b", 0, "书名：某某", "x" * 50)] + [("b", i, f"第{i}章", "正文" * 30) for i in range(1, 14)] + [("b", 14, "末", "短")]
    ch = L.narrative_chapters(spark.createDataFrame(rows, TITLED))
    seg = L.chunk_segments(ch).orderBy("segment").collect()
    assert [(r["start_chapter"], r["end_chapter"], r["boundary_confidence"]) for r in seg] == [(1, 12, 0.78), (13, 13, 0.68)]
    assert seg[0]["title"] == "第1章 - 第12章"


def test_reviews_and_merge(spark):
    seg = spark.createDataFrame([("b", "s1", 1, 3, 0.9, ["A"], ["t1"]), ("b", "s2", 4, 6, 0.7, ["A", "B"], ["t2"]), ("b", "s3", 7, 9, 0.8, ["C"], ["t3"])], "book_id string, segment_id string, start_chapter int, end_chapter int, boundary_confidence double, main_characters array<string>, turning_points array<string>")
    got = {r["segment_id"]: (r["suggestion"], r["left_chapter"], r["right_chapter"], r["n_shared"]) for r in L.boundary_reviews(seg).collect()}
    assert got == {"s2": ("merge_with_previous", 3, 4, 1), "s3": ("confirm", 6, 7, 0)}
    merged = L.merged_with_previous(seg, spark.createDataFrame([("b", "s2")], "book_id string, segment_id string")).orderBy("start_chapter").collect()
    assert [(r["segment_id"], r["end_chapter"], r["main_characters"], r["approved"]) for r in merged] == [("s1", 6, ["A", "B"], False), ("s3", 9, ["C"], True)]


def test_acts(spark):
    ch = spark.createDataFrame([("b", i, "", "突然" if i == 2 else "终于" if i == 14 else "") for i in range(20)], TITLED)
    t = L.turning_points(ch)
    assert {(r["i"], r["type"]) for r in t.collect()} == {(2, "INCITING"), (14, "CLIMAX")}
    acts = {r["i"]: r["act_type"] for r in L.acts(ch, t).collect()}
    assert acts[0] == "ACT_1_SETUP" and acts[3] == "ACT_1_INCITING" and acts[14] == "ACT_3_CLIMAX" and acts[19] == "ACT_3_RESOLUTION"
    assert L.act_summary(L.acts(ch, t), t).first()["turning_points"] == 2


def test_evidence_packs(spark):
    ch = spark.createDataFrame([("b", 1, "", "萧炎身穿黑袍，面容清秀。药老看着萧炎，目光平静。"), ("b", 2, "", "药老身材高大，萧炎在旁。萧炎手持长剑，气息翻涌。")], TITLED)
    who = spark.createDataFrame([("b", "萧炎", []), ("b", "药老", [])], "book_id string, name string, aliases array<string>")
    got = {r["name"]: r for r in M.packs(who, ch, "character").collect()}
    assert got["萧炎"]["source_coverage"] == "strong" and "body" in got["萧炎"]["missing_fields"] and got["萧炎"]["fields"]["clothing"] == "萧炎身穿黑袍"
    assert got["药老"]["fields"] == {"body": "药老身材高大"} and got["药老"]["needs_review"]


def test_prompts_and_boards(spark):
    assert [r[0] for r in spark.createDataFrame([("a；b",), ("一句话",), ("x" * 221,), (None,)], "d string").select(M.needs_fusion(F.col("d"))).collect()] == [True, False, True, False]
    outfits = [("常服", "日常", 1, 5), ("礼服", "宴会", 2, 6), ("甲", None, 3, None)]
    df = spark.createDataFrame([(outfits,)], "o array<struct<description: string, scene: string, first_chapter: int, last_chapter: int>>")
    assert df.select(M.primary_outfit(F.col("o")).alias("x")).first()["x"] == "常服"
    rows = spark.createDataFrame([("b", "萧炎", {"appearance": "面容清秀；看着远方的山"}, "core", "一个少年")], "book_id string, name string, fields map<string, string>, tier string, description string")
    p = M.prompts(rows, "character").first()
    assert "面容清秀" in p["prompt"] and "看着" not in p["prompt"] and "少年（约14-16岁）" in p["prompt"] and p["quality"] == "high"
    assert M.prompt_summary(M.prompts(rows, "character")).count() == 1
    scenes = spark.createDataFrame([("s", k, f"act{k}", None, None) for k in range(1, 4)], "story_id string, scene_no int, action string, line string, emotion string")
    frames = M.storyboard(scenes).orderBy("frame_no").collect()
    assert [r["shot_type"] for r in frames] == list(M.SHOTS) and frames[1]["beat"] == "act1"
    assert {r["duration_s"] for r in M.clips(M.storyboard(scenes)).collect()} == {15}


def test_assets_and_gate(spark):
    st = spark.createDataFrame([("s1", True, "Ann 站在大厅里看着远方的群山和河流。剑。", ["Ann"], [], ["大厅"], ["剑"], "T", "C conflict", "hook", ["t1", "t2"]), ("s2", False, "", ["X"], [], [], [], "", "", "", [])], "story_id string, approved boolean, source_text string, main_characters array<string>, supporting_characters array<string>, locations array<string>, props array<string>, title string, core_conflict string, trigger string, turning_points array<string>")
    a = {(r["asset_type"], r["name"]): (r["quality"], r["status"]) for r in M.story_assets(st).collect()}
    assert a == {("character", "Ann"): ("good", "confirmed"), ("scene", "大厅"): ("good", "confirmed"), ("prop", "剑"): ("thin", "candidate")}
    assert {r["issue"] for r in M.asset_warnings(M.story_assets(st)).collect()} == {"thin_description", "low_confidence"}
    plan = M.episode_plan(st).first()
    assert (plan["turning_point"], plan["ending"], plan["duration_s"]) == ("t1", "t2", 90)
    ep = spark.createDataFrame([("s1", 1, "h", "e", "C conflict", "C conflict", 2), ("s2", 1, "", "e", "x", "C conflict", 0)], "story_id string, episode_no int, hook string, ending string, conflict string, story_conflict string, n_scenes int")
    rev = M.script_review(ep)
    assert {r["story_id"]: (r["accepted"], len(r["warnings"])) for r in rev.collect()} == {"s1": (True, 0), "s2": (False, 1)}
    assert [r["story_id"] for r in M.gated(st, rev).collect()] == ["s1"]


def test_descriptions_of_many_names(spark):
    """The first sentence that holds a name, as each name tried on each sentence tells; thousands of names and sentences of one story take no time."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab甲𠀀 ") for _ in range(n))
    texts = ["".join(word(rng.randint(0, 9)) + rng.choice(("!", "。", "\n", "?")) for _ in range(rng.randint(0, 12))) for _ in range(60)] + ["x" * 1020 + "ann" + "x" * 3000 + "bob", None, None]
    names = [[word(rng.randint(0, 3)) for _ in range(5)] + ["", None] for _ in texts[:-3]] + [["ann", "bob", "x" * 1500, "nobody"], [""], None]
    st = spark.createDataFrame([(None if k == 3 else f"s{k % 40}", True, t, n, ["a"], [], n) for k, (t, n) in enumerate(zip(texts, names))], "story_id string, approved boolean, source_text string, main_characters array<string>, supporting_characters array<string>, locations array<string>, props array<string>")
    split = [r["s"] for r in st.select(description_sentences(F.coalesce("source_text", F.lit(""))).alias("s")).collect()]
    want = []
    for k, (sentences, mine) in enumerate(zip(split, names)):
        for kind, role, group in (("character", "main_characters", mine), ("character", "supporting_characters", ["a"]), ("prop", "props", mine)):
            want += [repr((None if k == 3 else f"s{k % 40}", kind, role, n, next((s for s in sentences if n is not None and n in s), None))) for n in group or []]
    got = [repr(tuple(r)) for r in M.story_assets(st).select("story_id", "asset_type", "role", "name", "description").collect()]
    assert sorted(got) == sorted(want) and any("ann" in w and w.endswith("bob')") for w in want)
    many = spark.range(25_000).select(F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("n")).groupBy().agg(F.collect_list("n").alias("main_characters"))
    none = F.array().cast("array<string>")
    many = many.select(F.lit("s").alias("story_id"), F.lit(True).alias("approved"), F.array_join("main_characters", " walks over the long road!").alias("source_text"), "main_characters", none.alias("supporting_characters"), none.alias("locations"), none.alias("props"))
    began = time.time()
    assert M.story_assets(many).filter("contains(description, name)").count() == 25_000
    assert time.time() - began < 60
