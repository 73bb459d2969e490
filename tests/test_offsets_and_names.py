"""Offsets, automaton, indexed resolution, fingerprints and orders, each against a plain computation."""

import copy
import random
import re
import time

from pyspark.sql import functions as F

from loomwright.operators import assembly, automaton, offsets, resolution as R, scanners as S
from loomwright.sources import tables


def texts(seed, n, alphabet, most):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_offsets_against_re(spark):
    patterns = ["(ab+)", "a(b)c?", "[，。](王.)", "(?i)x(y+)z|q", "(?<![a-z])(b)", r"(\s)a", "(?:a|b)(c*)", "(?:^|(?<=c))(a)", "(b)(?=c|$)"]
    rows = [(str(k), k, t) for k, t in enumerate([*texts(1, 150, "abcxyzXYZq 王三，。\n　é", 40), "", None, "ab" * 3000, "王" + "，王三" * 500])]
    df = spark.createDataFrame(rows, "book_id string, chapter_index int, content string")
    got = [(r["chapter_index"], r["seq"] % 1_000_000, r["text"], r["position"], r["kind"]) for r in S.regex_scan(df, [offsets.Pattern(p, 1, 1.0, p) for p in patterns]).collect()]
    want = []
    for _, k, t in rows:
        n = 0
        for p in patterns:
            for m in re.finditer(p, t or ""):
                if m[1]:
                    want.append((k, n, m[1], m.start(1), p))
                    n += 1
    assert sorted(got) == sorted(want) and len(want) > 3000
    plan = S.scan_characters(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow", plan)


def test_offsets_of_overlapping_matches(spark):
    rows = [(str(k), k, t) for k, t in enumerate([*texts(2, 100, "王李三。ab", 30), "王" * 200])]
    df = spark.createDataFrame(rows, "book_id string, chapter_index int, content string")
    found = S.regex_scan(df, [offsets.Pattern("([王李][王李三]{0,3})", 1, 0.0, ahead=4)], reach=6).collect()
    want = [(k, m[1], m.start(1), t[max(0, m.start(1) - 6) : m.start(1)], t[m.end(1) : m.end(1) + 6]) for _, k, t in rows for m in re.finditer("(?=([王李][王李三]{0,3}))", t)]
    assert sorted((r["chapter_index"], r["text"], r["position"], r["before"], r["after"]) for r in found) == sorted(want)


def test_automaton_against_nested_tests(spark):
    names = ["a", "ab", "bab", "aba", "王三", "三", "B", "b", ""]
    rows = [("b", k, t) for k, t in enumerate([*texts(3, 200, "abB王三 ", 30), None])]
    df = spark.createDataFrame(rows, "book_id string, chapter_index int, content string")
    got = {(r["chapter_index"], h["name"]): (h["n"], h["first"]) for r in automaton.with_hits(df, names, "content", "h").collect() for h in r["h"]}
    assert got == {(k, n): (t.count(n), t.index(n)) for _, k, t in rows for n in names if n and n in (t or "")}
    folded = {(r["chapter_index"], h["name"]): h["n"] for r in automaton.with_hits(df, names, "content", "h", fold=True, alone=["a", "ab", "B", "b"]).collect() for h in r["h"]}
    want = {}
    for _, k, t in rows:
        for n in filter(None, names):
            p = f"(?i)(?<![0-9A-Za-z_]){n}(?![0-9A-Za-z_])" if n in ("a", "ab", "B", "b") else f"(?i){n}"
            if c := len(re.findall(p, t or "")):
                want[k, n] = c
    assert folded == want


def test_a_hundred_thousand_names(spark):
    r = random.Random(5)
    names = {"".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 9))) for _ in range(100_000)}
    listed = sorted(names)
    rows = [("b", k, " ".join(r.choice(listed) for _ in range(200))) for k in range(300)]
    df = spark.createDataFrame(rows, "book_id string, chapter_index int, content string")
    began = time.time()
    found = {x["text"]: x["n"] for x in S.exact_mentions(df, spark.createDataFrame([(n,) for n in listed], "name string")).collect()}
    assert time.time() - began < 60
    for n in r.sample(listed, 300):
        assert found.get(n, 0) == sum(t.count(n) for _, _, t in rows)


class Everyone(R.Owners):
    def near(self, alias):
        return self.known.items()


def walk(rows, pairs):
    """Every entity is tried for every row, and every entity's aliases for every alias."""
    made = {}
    for row in rows:
        if R.is_collective(row["name"]):
            continue
        key = row["name"].lower()
        to = next((k for k, e in made.items() if k == key or R.linked(e, row, pairs) or R.same_person(e["name"], row["name"])), None)
        made[to or key] = (R.merge_characters(made[to], row) | {"merged": made[to]["merged"] + 1}) if to is not None else row | {"merged": 0}
    owners = Everyone({e["name"]: e["aliases"] for e in made.values()}, pairs)
    out = []
    for e in made.values():
        name = R.canonical_name(e["name"], e["aliases"], pairs=pairs)
        out.append(e | {"name": name, "aliases": R.clean_aliases(name, e["aliases"] if name == e["name"] else [*e["aliases"], e["name"]], owners, pairs=pairs)})
    return out


POOL = "萧炎 萧炎哥 炎儿 老萧 小医仙 药老 药尘 张三 张三丰 张三哥 几名护卫 他 那位少年 大长老 Ann ann BOB Bob大人 欧阳锋 欧阳锋叔叔 李伟 老李伟 李伟儿 阿伟 魏公 魏渊 族长 萧族长 萧薰儿 薰儿 熏儿 纳兰嫣然 嫣然 绿裙女子 白痴 Lee".split()


def people(r, n, pool):
    return [
        {"book_id": "b", "seq": k, "name": r.choice(pool), "aliases": [r.choice(pool) for _ in range(r.randint(0, 3))], "description": r.choice([None, "x"]), "confidence": r.random(), "first_chapter": r.choice([None, 1]), "last_chapter": r.choice([None, 5]), "chapter_appearances": [r.randint(1, 9)],
         "mention_count": r.choice([None, 1]), "dialogue_count": 0, "co_characters": [r.choice(pool)], "outfits": [{"description": "robe" + "x" * r.randint(0, 2), "scene": r.choice([None, "s"]), "first_chapter": 1, "last_chapter": 2}]}
        for k in range(n)
    ]


def test_indexed_resolution_against_the_walk():
    for seed in range(150):
        r = random.Random(seed)
        rows, pairs = people(r, r.randint(1, 40), r.sample(POOL, r.randint(3, len(POOL)))), r.choice([(), (("魏公", "魏渊"),), (("药老", "药尘"), ("炎儿", "萧炎"))])
        assert R.resolve_fold(copy.deepcopy(rows), pairs) == walk(copy.deepcopy(rows), pairs), seed


def test_suppliers_against_the_walk(spark, sf):
    from loomwright.plans import catalog

    got = sorted(map(str, catalog.QUERIES["resolve_suppliers"](spark, sf).collect()))
    kept, R.resolve_fold = R.resolve_fold, walk
    try:
        assert got == sorted(map(str, catalog.QUERIES["resolve_suppliers"](spark, sf).collect())) and got
    finally:
        R.resolve_fold = kept


def test_a_large_book():
    r = random.Random(1)
    letters = [chr(0x5000 + k) for k in range(3000)]
    pool = [r.choice("赵钱孙李周吴郑王") + r.choice(letters) + r.choice(letters) for _ in range(6000)] + ["赵一一"] * 3000
    began = time.time()
    assert 5000 < len(R.resolve_fold(people(r, 20_000, pool))) < 7000 and time.time() - began < 60


def test_fingerprints(spark):
    r = random.Random(2)
    rows = [(k, r.choice(["x", "y", None]), r.random()) for k in range(5000) for _ in range(r.choice([1, 1, 2]))]
    other = [x for x in rows if x[0] != 1234] + [(77, "x", 0.5), rows[0]]
    r.shuffle(other)
    schema = "id long, t string, v double"
    a, b = spark.createDataFrame(rows + [(None, "n", 1.0)], schema), spark.createDataFrame(other, schema).repartition(7)
    got = {x["range"]: (x["left"], x["right"]) for x in tables.differing_ranges(a, b, "id", 100).collect()}
    count = lambda rs, k: sum(x[0] is not None and x[0] // 100 == k for x in rs)
    assert got == {k: (count(rows, k), count(other, k)) for k in (0, 12)} | {None: (1, 0)}
    assert tables.differing_ranges(a, a.repartition(5), "id", 100).isEmpty()
    placed = tables.numbered(a, [F.desc_nulls_last("v"), F.col("id")]).orderBy("place").collect()
    assert [x["place"] for x in placed] == list(range(1, len(rows) + 2)) and all(p["v"] >= q["v"] for p, q in zip(placed, placed[1:]))


def test_clause_owners(spark):
    told = {
        ("甲甲身穿黑袍，面容清秀", ""): "TT", ("乙乙看着甲甲，目光平静", "乙乙"): "TT", ("甲甲盯着乙乙，神色冷漠", "乙乙"): "OO", ("乙乙一身白衣，对着甲甲怒意翻涌，剑光闪烁", "乙乙"): "OOO", ("甲甲看到少女，容貌清秀", ""): "OO",
        ("他背影高大，甲甲拔出长剑", ""): "UT", ("面具之下，乙乙与甲甲并肩", "乙乙"): "UU", ("对着甲甲的长老，神情从容", ""): "TT", ("a.b甲甲看着乙乙", "乙乙"): "O", ("", ""): "",
    }
    df = spark.createDataFrame([(s, ["甲甲"], [o] if o else []) for s, o in told], "s string, m array<string>, o array<string>")
    rows = df.select("s", assembly.clause_owners(assembly.clauses(F.col("s")), F.col("m"), F.col("o")).alias("w")).collect()
    assert {r["s"]: "".join(r["w"]) for r in rows} == {s: w for (s, _), w in told.items()}
