import random
import re
import time

from pyspark.sql import functions as F

from loomwright.operators import coreference as K, relations as J, resolution as H, validation as V


def character(name, aliases=(), confidence=0.5, seq=0, **more):
    return {"book_id": "b", "seq": seq, "name": name, "aliases": list(aliases), "description": more.pop("description", None), "confidence": confidence, "first_chapter": 1, "last_chapter": 2, "chapter_appearances": [1], "mention_count": 1, "dialogue_count": 0, "co_characters": [], "outfits": [], **more}


def test_same_name_is_one_row_with_the_best_confidence():
    out = H.resolve_fold([character("Ann", confidence=0.4), character("ann", confidence=0.9)])
    assert [(r["name"], r["confidence"], r["merged"]) for r in out] == [("Ann", 0.9, 1)]


def test_alias_and_address_forms():
    assert [r["name"] for r in H.resolve_fold([character("Ann", ["Annie"]), character("Annie")])] == ["Ann"]
    assert [r["name"] for r in H.resolve_fold([character("萧炎哥"), character("萧炎")])] == ["萧炎"]
    assert len(H.resolve_fold([character("张三"), character("张三丰")])) == 2


def test_distinct_proper_names_stay_apart_despite_a_stray_alias():
    assert {r["name"] for r in H.resolve_fold([character("萧炎", ["李伟"]), character("李伟")])} == {"萧炎", "李伟"}


def test_collectives_and_generic_aliases():
    assert H.is_collective("三位长老") and H.is_collective("他们") and not H.is_collective("萧炎")
    assert H.is_generic("那位少年") and H.is_generic("大长老") and H.is_generic("绿衣少女") and not H.is_generic("萧炎")
    assert H.resolve_fold([character("几名护卫")]) == []
    assert H.clean_aliases("萧炎", ["萧炎", "他", "萧炎哥", "萧炎哥", "李伟"]) == ["萧炎哥"]


def test_nickname_promoted_to_the_full_name():
    (r,) = H.resolve_fold([character("炎儿", ["萧炎"]), character("萧炎")])
    assert r["name"] == "萧炎" and "炎儿" in r["aliases"]


def test_walk_is_no_connected_component(spark):
    # the third row links the first two, but they are clusters of their own by then
    rows = [character("Ann", ["x"], seq=1), character("Bob", ["y"], seq=2), character("Cid", ["x", "y"], seq=3)]
    assert [(r["name"], r["merged"]) for r in H.resolve_fold(rows)] == [("Ann", 1), ("Bob", 0)]
    df = spark.createDataFrame([{k: r[k] for k in ("book_id", "seq", "name", "aliases")} for r in rows], "book_id string, seq long, name string, aliases array<string>")
    assert {r["cluster"] for r in H.connected(df).collect()} == {1}


def test_resolve_on_a_frame(spark):
    rows = [character("Ann", seq=2, confidence=0.3), character("ANN", seq=1, confidence=0.8, description="tall"), character("Bob", seq=3)]
    out = H.resolve(spark.createDataFrame(rows, H.CHARACTER)).orderBy("name").collect()
    assert [(r["name"], r["confidence"], r["merged"], r["mention_count"]) for r in out] == [("ANN", 0.8, 1, 2), ("Bob", 0.5, 0, 1)]
    assert H.extracted(spark.createDataFrame(rows, H.CHARACTER)).count() == 2


def test_outfits():
    a = [{"description": "red robe", "scene": "court", "first_chapter": 1, "last_chapter": 40}]
    b = [{"description": "a long red robe", "scene": "Court ", "first_chapter": 30, "last_chapter": 100}, {"description": "armour", "scene": None, "first_chapter": 5, "last_chapter": 5}]
    out = H.merge_outfits(a, b)
    assert out[0] == {"description": "a long red robe", "scene": "court", "first_chapter": 1, "last_chapter": 100} and len(out) == 2


def test_other_dedupes(spark):
    assert [r["name"] for r in H.generic_dedupe([character("Ann", ["A"]), character("a", confidence=0.9)])] == ["Ann"]
    moved = H.rekeyed_duplicates([character("Ann", confidence=0.3), character("Bob"), character("ann", confidence=0.9)])
    assert [r["name"] for r in moved] == ["Bob", "ann"]
    rows = spark.createDataFrame([("b", 1, "Lamp", ["x", "Sword", "他"]), ("b", 2, "Sword", [])], "book_id string, seq int, name string, aliases array<string>")
    assert H.without_collisions(rows).count() == 0  # too short, another's name, generic
    items = spark.createDataFrame([("b", "lamp", [("Ann", 1, 3), ("ann", 2, 9)])], "book_id string, item string, owners array<struct<name: string, first_chapter: int, last_chapter: int>>")
    assert H.merged_owners(items).first().asDict() == {"book_id": "b", "item": "lamp", "owner": "Ann", "first_chapter": 1, "last_chapter": 9}


def test_fusion(spark):
    llm = spark.createDataFrame([("b", 1, "萧炎", ["炎"], 2), ("b", 2, "药老", [], 0)], "book_id string, seq int, name string, aliases array<string>, mention_count int")
    scan = spark.createDataFrame([("b", 7, "萧炎哥", [], 30, [1, 2]), ("b", 8, "无关", [], 9, [3])], "book_id string, seq int, name string, aliases array<string>, total_count int, all_chapters array<int>")
    got = {r["name"]: (r["aliases"], r["mention_count"], r["chapters"]) for r in H.fused(llm, scan).collect()}
    assert got == {"萧炎": (["炎", "萧炎哥"], 30, [1, 2]), "药老": ([], 0, [])}


def test_address_free_column(spark):
    df = spark.createDataFrame([("萧炎哥",), ("小医仙",), ("张三",), ("林大人",), ("老张",)], "n string")
    assert [r[0] for r in df.select(H.address_free_column(F.col("n"))).collect()] == [H.address_free(r["n"]) for r in df.collect()]


def test_validation(spark):
    rows = spark.createDataFrame([("Ann", ["ann"], 0.2, None, [1]), ("Bob", [], 0.9, "x", [2])], "name string, aliases array<string>, confidence double, description string, chapter_appearances array<int>")
    out = {r["name"]: (r["errors"], r["warnings"], r["valid"]) for r in V.validate(rows).collect()}
    assert out["Ann"] == ("confidence below 0.30; description is missing", "an alias equals the name", False) and out["Bob"] == ("", "", True)
    ents = spark.createDataFrame([("剑", 0.9), ("的剑9", 0.9), ("青锋剑", 0.3)], "name string, confidence double")
    got = {r["name"]: (r["valid"], r["warnings"] != "") for r in V.validate(ents, V.ENTITY_ERRORS, V.ENTITY_WARNINGS).collect()}
    assert got == {"剑": (False, False), "的剑9": (True, True), "青锋剑": (False, False)}
    assert V.all_empty(rows.filter("false")) and not V.all_empty(rows, rows.filter("false"))


def test_edges(spark):
    ch = spark.createDataFrame([("b", 0, "张三和李四是朋友。张三见李四。"), ("b", 2, "李四追杀张三！王五")], "book_id string, chapter_index int, content string")
    e = J.edges(J.evidence(J.sentence_mentions(ch, ["张三", "李四", "王五"]))).filter("source = '张三'")
    got = {r["type"]: (round(r["confidence"], 2), r["chapter_first"], r["chapter_last"], r["n"]) for r in e.collect()}
    assert got["friendship"] == (0.99, 0, 2, 3) and got["antagonistic"] == (0.5, 0, 2, 3)
    assert J.both_ways(e).count() == 2 * e.count() and J.confident(e, 0.9).count() == 1


def test_graph(spark):
    e = spark.createDataFrame([("b", "1", "2", "friendship", 0.8, 1, 5), ("b", "2", "9", "friendship", 0.6, None, None), ("b", "1", "3", "family", 0.5, 7, 9)], "book_id string, source string, target string, type string, confidence double, chapter_first int, chapter_last int")
    nodes = spark.createDataFrame([("b", "1", "Ann", ["A"], 1), ("b", "2", "Bob", [], 2), ("b", "3", "A", [], 3)], "book_id string, id string, name string, aliases array<string>, seq int")
    assert J.query(e, node="2", chapters=(6, 9)).count() == 1 and J.query(e, kind="family", least=0.6).count() == 0
    assert [(r["id"], r["target"], r["confidence"]) for r in J.friends_of_friends(e, nodes).collect()] == [("1", "9", 0.4)]
    s = J.stats(e, nodes).first()
    assert (s["nodes"], s["edges"], s["n_friendship"], s["n_unknown"]) == (3, 3, 2, 0)
    assert {r["key"]: r["id"] for r in J.name_index(nodes).collect()} == {"ann": "1", "a": "3", "bob": "2"}
    named = J.with_ids(spark.createDataFrame([("b", "Ann", "Nobody")], "book_id string, source string, target string"), nodes).first()
    assert (named["source"], named["target"]) == ("1", "Nobody")


def test_antecedents_equal_a_scan(spark):
    text = "Ann walked. Bob ran " + "x" * 60 + " he said. Ann! She it " + "y" * 600 + " his"
    ch = spark.createDataFrame([("b", 0, text)], "book_id string, chapter_index int, content string")
    got = {(r["position"]): (r["name"], r["confidence"]) for r in K.antecedents(K.pronouns(ch), K.names_found(ch, ["Ann", "Bob"]), ["Ann", "Bob"]).collect()}
    want = {}
    for at in got:
        best = (None, 0.0)
        for n in ("Ann", "Bob"):
            k = text.rfind(n, 0, at)
            if k >= 0:
                d = at - k
                c = 0.5 if d > 500 else 0.7 if d > 200 else 0.85 if d > 100 else 0.95 if d > 50 else 1.0
                if c > best[1]:
                    best = (n, c)
        want[at] = best
    assert got == want and len(got) == 4


def test_coreference_patterns(spark):
    ch = spark.createDataFrame([("b", 0, 'The old man met Mr. Smith. Ann, known as "Queen" aka. 那个黑人，此人。')], "book_id string, chapter_index int, content string")
    assert {r["text"] for r in K.descriptors(ch).collect()} == {"old", "黑", "此人"}
    assert ("mr", "Smith") in {(r["kind"], r["text"]) for r in K.honorifics(ch).collect()}
    pairs = K.alias_pairs(ch)
    assert ("Ann", "Queen") in {(r["name"], r["alias"]) for r in pairs.collect()}
    rows = spark.createDataFrame([("b", "Ann", ["A"])], "book_id string, name string, aliases array<string>")
    assert K.extended(rows, pairs).first()["aliases"] == ["A", "Queen"]
    d = spark.createDataFrame([("the tall ann",), ("old smith",), ("nobody",)], "d string").select(K.descriptor_match(F.col("d"), ["Ann", "John Smith"]).alias("m")).collect()
    assert [(r["m"] or {"name": None})["name"] for r in d] == ["Ann", "John Smith", None]


def test_alias_patterns_read_a_text_once(spark):
    """Against each pattern of ``ALIASES`` as it stands, over made-up texts; a long line without a match takes no time."""
    rng, bits = random.Random(4), ['"', '""', "，又名\"", "，人称\"", "，绰号\"", "\"常被称为", "称", "为", "之", "甲", "乙", " ", "  ", "\n", "\r\n", "\u2028", "\x85", "\t", "ann", "Bob_1", ",", " Known as \"", " nicknamed \"", " also calls herself \"", " also call themselves \"", " or \"", " AKA \"", " also  known as \"", " for short", " for shortened", "é", "K", "İ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(6000)] + ["x for shorty for short", None]
    ch = spark.createDataFrame([("b", k, t) for k, t in enumerate(texts)], "book_id string, chapter_index int, content string").repartition(4)
    got = {tuple(r) for r in K.alias_pairs(ch).select("chapter_index", "name", "alias").collect()}
    want = set()
    for p in K.ALIASES:
        two = re.compile(p).groups > 1
        first, last = (F.regexp_extract_all("content", F.lit(p), F.lit(k)) for k in (1, 2 if two else 1))
        rows = ch.filter("content is not null").select("chapter_index", F.explode(F.arrays_zip((first if two else F.transform(first, lambda x: F.lit(""))).alias("n"), last.alias("a"))).alias("p"))
        found = {tuple(r) for r in rows.select("chapter_index", F.trim("p.n"), F.trim("p.a")).collect()}
        assert found, p
        want |= found
    assert got == want
    long = spark.createDataFrame([("b", 0, w * 100_000) for w in ("甲", "称", "w", "a b", " ", '"')] + [("b", 1, "之" + "，又名\"\"" * 50_000)], "book_id string, chapter_index int, content string")
    began = time.time()
    K.alias_pairs(long).count()
    assert time.time() - began < 60
