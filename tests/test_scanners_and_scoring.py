import math

from pyspark.sql import functions as F

from loomwright.operators import events, scanners as S, scoring as C
from loomwright.plans import prescan


def chapters(spark, *texts, book="b"):
    return spark.createDataFrame([(book, i, None, t) for i, t in enumerate(texts)], "book_id string, chapter_index int, title string, content string")


def test_characters(spark):
    found = S.scan_characters(chapters(spark, "欧阳锋走来。，李伟说：好。我是张三，慕容燕大人")).collect()
    got = {(r["text"], r["confidence"]) for r in found}
    assert ("欧阳锋", 0.9) in got and ("张三", 0.85) in got and ("慕容燕", 0.9) in got
    place = next(r for r in found if r["text"] == "张三")
    assert place["position"] == 15 and place["source"] == "regex"


def test_locations_items_events(spark):
    ch = chapters(spark, "他到京城去。，青云山，紫金丹在手。李伟下令攻打王府。", None, "")
    assert {r["text"] for r in S.scan_locations(ch).collect()} >= {"京城", "青云山"}
    items = {(r["text"], r["confidence"]) for r in S.scan_items(ch).collect()}
    assert ("紫金丹", 0.8) in items
    assert S.scan_events(ch).count() == 0


def test_event_summaries(spark):
    told = {
        "魏渊派遣许七安前往云州调查案情": ("魏渊派遣许七安前往云州", 0.85), "许七安派出许七安": None, "许七安破获税银案，大喜": ("许七安破获税银案", 0.85), "许七安揭开锅": None, "许七安调查黄山": ("许七安调查黄山", 0.85), "许七安调查衣袖": None,
        "许七安审问周立": ("许七安审问周立", 0.85), "许七安审问那人": None, "李玉春死亡，原因不明": ("李玉春死亡", 0.85), "李玉春死亡原因是中毒。": ("李玉春死亡原因是中毒", 0.85), "宋廷风失踪了": ("宋廷风失踪", 0.85),
        "圣上下令，周立于菜市口斩首": ("圣上下令斩首周立", 0.85), "许七安说：追杀魏渊": None, "许七安救下苏苏": ("许七安救下苏苏", 0.85), "许七安救下自己的人": None, "无名之人追杀他": None,
        "葛叶想要退婚": ("葛叶请求解除婚约", 0.86), "纳兰嫣然来解除婚约": ("纳兰嫣然要求解除婚约", 0.86), "萧炎愤怒，不许退婚": ("萧炎拒绝解除婚约", 0.86), "萧战取出聚气散": ("萧战拿出聚气散", 0.84), "聚气散很好": None,
        "而萧炎哥哥写下休书": ("萧炎写下休书", 0.86), "少年约定三年": ("萧炎立下三年之约", 0.88), "三年": None, "少年与她有三年之约": ("萧炎立下三年之约", 0.88), "药老苏醒": ("药老从戒指中现身", 0.84), "萧炎知道戒指的秘密": None, "萧炎，戒指的秘密": ("萧炎发现戒指秘密", 0.84),
        "萧炎，为了炼药去借钱": ("萧炎为炼药筹钱", 0.78), "萧炎，准备炼药": ("萧炎开启炼药目标", 0.78), "萧炎，修炼有了突破": ("萧炎推进修炼目标", 0.78),
    }
    rows = spark.createDataFrame([(s,) for s in told], "s string").select("s", events.of_sentence(F.col("s")).alias("e")).collect()
    assert {r["s"]: r["e"] and tuple(r["e"]) for r in rows} == told


def test_events_of_chapters(spark):
    ch = spark.createDataFrame([("b", 1, "聚气散", "葛叶道：我有事相求。云岚宗的宗主。古玉盒里是聚气散。"), ("b", 2, None, "三年之后，萧炎要挑战云岚宗！"), ("b", 3, None, None), ("b", 4, None, "。".join(f"许七安救下苏苏{'甲' * k}" for k in range(20)) + "。".join(f"许七安打伤{c}三甲" for c in "甲乙丙丁戊己庚辛壬癸"))], "book_id string, chapter_index int, title string, content string")
    got = [(r["chapter_index"], r["text"], r["position"], r["confidence"]) for r in S.scan_events(ch).orderBy("chapter_index", "position").collect()]
    assert [g for g in got if g[0] < 4] == [(1, "葛叶提出退婚请求", 5, 0.84), (1, "葛叶拿出聚气散", 17, 0.84), (2, "萧炎立下三年之约", 0, 0.88)]
    assert len([g for g in got if g[0] == 4]) == 8 and len({g[1] for g in got}) == len(got)


def test_frequent_names_and_suppression(spark):
    ch = chapters(spark, "李伟说好。" * 4, "李伟道走。" * 3, "许多人说。" * 9)
    rows = {r["text"]: r for r in S.frequent_names(ch).collect()}
    assert rows["李伟"]["n"] == 7 and rows["李伟"]["all_chapters"] == [0, 1] and "许多" not in rows
    names = [("b", "王小", 10, 1), ("b", "王小明", 9, 2), ("b", "张飞云", 10, 3), ("b", "张飞云天", 11, 4), ("b", "赵云", 5, 5), ("b", "赵云天", 2, 6)]
    df = spark.createDataFrame(names, "book_id string, text string, n int, first int")
    left = {r["text"] for r in S.suppressed(df).collect()}
    # 王小 is a prefix of an almost as frequent name; 张飞云 strikes its extension; 赵云 and its rare extension both stay
    assert left == {"王小明", "张飞云", "赵云", "赵云天"}


def walk(names):
    order = sorted(names, key=lambda x: (-x[1], -len(x[0]), x[2]))
    gone = set()
    for a, n, _ in order:
        for b, m, _ in order:
            if a == b or a not in b:
                continue
            if len(a) == 2 and len(b) == 3 and b.startswith(a) and m >= 0.8 * n:
                gone.add(a)
                break
            if len(a) >= 3 and len(a) < len(b) and n >= 0.8 * m:
                gone.add(b)
                continue
            if len(a) < len(b) and m > 1.2 * n:
                gone.add(a)
                break
    return {a for a, *_ in names} - gone


def test_suppression_equals_the_walk(spark):
    import random

    rng = random.Random(7)
    rows, want = [], {}
    for book in range(30):
        names = {}
        while len(names) < 14:
            names["".join(rng.choice("甲乙丙") for _ in range(rng.randint(2, 4)))] = rng.randint(5, 15)
        named = [(t, n, i) for i, (t, n) in enumerate(names.items())]
        want[book] = walk(named)
        rows += [(book, *x) for x in named]
    df = spark.createDataFrame(rows, "book_id int, text string, n int, first int")
    got = {}
    for r in S.suppressed(df).collect():
        got.setdefault(r["book_id"], set()).add(r["text"])
    assert got == want


def test_aliases(spark):
    ch = chapters(spark, "许七安来了，许宁宴走了。许宁宴笑", "许七安")
    names = spark.createDataFrame([("许七安",), ("许宁宴",), ("无人",)], "name string")
    found = S.exact_mentions(ch, names)
    pairs = spark.createDataFrame([("许七安", "许宁宴")], "primary string, alias string")
    (row,) = S.roll_up_aliases(found, pairs).collect()
    assert (row["text"], row["n"], row["all_chapters"], row["aliases"]) == ("许七安", 4, [0, 1], ["许宁宴"])
    m = spark.createDataFrame([("b", "许宁宴")], "book_id string, text string")
    assert S.canonical(m, pairs).first().asDict() == {"book_id": "b", "text": "许七安", "aliases": ["许宁宴"]}


def test_signals_of_the_latin_sample(spark):
    ch = chapters(spark, "Ann met Bob. “Hi,” said Ann.", "Bob left. bob slept.")
    got = {r["name"]: (r["mention_count"], r["dialogue_count"], r["co_characters"]) for r in C.signals(ch, ["Ann", "Bob", "Eve"]).collect()}
    assert got == {"Ann": (2, 1, ["Bob"]), "Bob": (3, 1, ["Ann"]), "Eve": (0, 0, [])}
    dotted = C.signals(chapters(spark, "A.B. met A.B. and AxBx"), ["A.B"]).first()
    assert dotted["mention_count"] == 2
    pairs = spark.createDataFrame([("Ann", "Bob")], "canonical string, alias string")
    rolled = {r["name"]: (r["mention_count"], r["co_characters"]) for r in C.rolled_up(C.signals(ch, ["Ann", "Bob"]), pairs).collect()}
    assert rolled == {"Ann": (5, [])}


def test_grouping_keeps_the_last_of_equals(spark):
    rows = [("b", "item", "x", 0, 1, 0.8, 1), ("b", "item", "x", 2, 5, 0.8, 2), ("b", "item", "y", 1, 1, 0.5, 3)]
    m = spark.createDataFrame(rows, "book_id string, type string, text string, chapter_index int, position int, confidence double, seq long")
    (r,) = C.grouped(m).collect()
    assert (r["text"], r["chapter_index"], r["position"], r["total_count"], r["all_chapters"]) == ("x", 2, 5, 2, [0, 2])


def test_formulas(spark):
    df = spark.createDataFrame([(0,), (3,), (6,)], "s int")
    assert [r[0] for r in df.select(C.story_value(F.col("s"))).collect()] == [0.0, 0.5, 1.0]
    # p = 1/4 of 4 chapters
    ent = spark.createDataFrame([("b", "item", "x", 0, 1, [1], [])], "book_id string, type string, text string, position int, total_count long, all_chapters array<int>, aliases array<string>")
    ch = chapters(spark, "a", "甲乙丙丁", "c", "d")
    stats = C.basic_stats(ent, ch).first()
    assert math.isclose(stats["std"], math.sqrt(3) / 4) and math.isclose(stats["skewness"], 1.1547005, rel_tol=1e-6)
    conf = C.confidence(ent, ch).first()
    # mention .333, position max(.3, .5*(1-|1/3-.5|)), distribution .6*min(1,1.25)+0, semantic max(.3, .5*.3+0)
    raw = 0.3 / 3 + 0.2 * 0.5 * (1 - abs(1 / 3 - 0.5)) + 0.3 * 0.6 + 0.2 * 0.3
    assert math.isclose(conf["overall"], raw * 0.7, rel_tol=1e-9)


def test_whole_scan(spark):
    ch = chapters(spark, "李伟说好。京城很大。" * 5, "李伟道走，笑着来。" * 4)
    out = prescan.scan(ch)
    assert "李伟" in {r["text"] for r in out["entities"].collect()}
    imp = out["importance"].collect()
    assert imp and all(0 <= r["importance"] <= 1 and 0 <= r["story_score"] <= 6 for r in imp)
    assert out["selected"].count() <= out["entities"].count()


def test_whole_scan_against_its_steps(spark):
    ch = chapters(spark, "欧阳锋走来。李伟说好，" * 3, "李伟道走，张三笑着来。" * 4, None, "")
    names = spark.createDataFrame([("王五",), ("张三",)], "name string")
    pairs = spark.createDataFrame([("李伟", "张三")], "primary string, alias string")
    answers = spark.createDataFrame([("b", 0, "item", "古玉盒", 0.8), ("b", 0, "character", "欧阳锋", 0.9)], "book_id string, batch int, type string, text string, confidence double")
    out = prescan.scan(ch, pairs, least=2, names=names, answers=answers)
    key = lambda d, *c: sorted(map(repr, d.select("book_id", "type", "text", *c).collect()))
    assert key(out["entities"], "total_count") == key(C.grouped(out["mentions"]), "total_count")
    assert key(out["confidence"], "overall") == key(C.confidence(out["entities"], ch), "overall")
    assert key(out["importance"], "importance") == key(C.importance(out["entities"], out["entities"], ch), "importance")
    found = {r["text"]: (r["total_count"], r["all_chapters"]) for r in out["entities"].collect()}
    assert found["李伟"] == (11, [0, 1]) and "张三" not in found and found["古玉盒"] == (1, [0]) and "王五" not in found
    stats = {r["type"]: (r["n_mentions"], r["n_entities"]) for r in out["statistics"].collect()}
    assert stats["item"] == (1, 1) and stats["character"][1] == sum(r["type"] == "character" for r in out["entities"].select("type").collect())


def test_names_meet_chapters_by_pairs(spark):
    ch = chapters(spark, "许七安来了，许宁宴走了。许宁宴笑", "许七安", "a", "", None)
    names = spark.createDataFrame([("许七安",), ("许宁宴",), ("许",), ("a",), ("安来",), ("无人",)], "name string")
    rows = lambda d: sorted(map(repr, d.collect()))
    assert rows(S.exact_mentions(ch, names)) == rows(S.exact_mentions(ch, names, most=0)) and S.exact_mentions(ch, names, most=0).count() == 5


def test_uniqueness_against_sets(spark):
    ch = chapters(spark, "甲乙丙丁戊", "甲乙己庚", "辛壬")
    m = spark.createDataFrame([("b", "item", "x", 0, 2)], "book_id string, type string, text string, chapter_index int, position int")
    # own pairs 甲乙 乙丙 丙丁 丁戊; 甲乙 is elsewhere too
    r = C.information_uniqueness(m, ch).first()
    assert math.isclose(r["information_uniqueness"], 0.85 * 3 / 4 + 0.15 * 4 / 80)
