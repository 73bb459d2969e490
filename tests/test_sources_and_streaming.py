import json

import pytest

from loomwright.sources import exports, model, tables, text_files
from loomwright.streaming import progress


def test_decoding(spark, tmp_path):
    texts = {"gbk": "第一章 起点，他来了", "utf8": "第一章 𠮷", "bom": "abc"}
    (tmp_path / "a_gbk").write_bytes(texts["gbk"].encode("gb18030"))
    (tmp_path / "b_utf8").write_bytes(texts["utf8"].encode())
    (tmp_path / "c_bom").write_bytes(b"\xef\xbb\xbf" + texts["bom"].encode())
    (tmp_path / "d_empty").write_bytes(b"")
    rows = text_files.decoded(text_files.binary_files(spark, str(tmp_path))).orderBy("path").collect()
    assert [(r["encoding"], r["text"]) for r in rows] == [("gb18030", texts["gbk"]), ("utf-8", texts["utf8"]), ("utf-8", "abc")]  # the scan has no row for an empty file


def test_mention_files(spark, tmp_path):
    m = spark.createDataFrame([("b", "character", "萧炎", 1, 5, "regex", 0.8, ["炎"]), ("b", "character", "萧炎", 1, 9, "regex", 0.8, ["炎"]), ("b", "event", "a|b", 0, 2, "llm", 0.756, [])], "book_id string, type string, text string, chapter_index int, position int, source string, confidence double, aliases array<string>")
    text_files.write_mentions(m, str(tmp_path / "m"))
    got = {(r["chapter_index"], r["text"], r["source"], r["confidence"]) for r in text_files.read_mentions(spark, str(tmp_path / "m")).collect()}
    assert got == {(1, "萧炎（别名：炎）", "regex", 0.8), (0, "a|b", "llm", 0.76)}


def test_report(spark):
    cols = ["x"] + ["1"] * 12
    lines = spark.createDataFrame([("d", 1, "## character"), ("d", 2, "|".join(cols)), ("d", 3, "core: 1"), ("d", 4, "## item"), ("d", 5, "|".join(["y"] + ["2"] * 12))], "doc string, n int, line string")
    assert {(r["type"], r["text"]) for r in text_files.parsed_report(lines).collect()} == {("character", "x"), ("item", "y")}


def entities(spark):
    return spark.createDataFrame([("b", 1, 'Ann, "A"', ["x", "y"], None, 0.5, "OK", 3, 1, None, 2, ["Bob"])], "book_id string, seq int, name string, aliases array<string>, description string, confidence double, status string, mention_count int, first_chapter int, last_chapter int, dialogue_count int, co_characters array<string>")


def test_exports(spark, tmp_path):
    books = spark.createDataFrame([("b", "Title"), ("c", "Empty")], "book_id string, title string")
    e = entities(spark)
    assert exports.csv_lines(e, "character").first()["line"] == '"Ann, ""A""",x; y,,0.500,OK,3,1,,2,Bob'
    doc = json.loads(exports.export(e, "character", "json", books).filter("book_id = 'b'").first()["value"])
    assert doc["book"]["title"] == "Title" and doc["characters"][0]["name"] == 'Ann, "A"' and doc["kindLabel"] == "Characters"
    md = exports.export(e, "character", "markdown", books).filter("book_id = 'b'").first()["value"]
    assert md.startswith("# Title\n\n## Characters (1)") and "| Confidence | 50.0% |" in md and "| Co-Characters | Bob |" in md and "Last Chapter" not in md
    with pytest.raises(ValueError, match="unknown format"):
        exports.export(e, "character", "pdf", books)
    exports.write_documents(exports.export(e, "character", "csv", books), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, "PENDING", "b"), (2, "PENDING", "b"), (3, "OK", "c")], "id int, status string, book_id string")
    new, log = tables.review(rows, spark.createDataFrame([(1,)], "id int"), "confirm", "CONFIRMED", "u")
    assert {r["id"]: r["status"] for r in new.collect()} == {1: "CONFIRMED", 2: "PENDING", 3: "OK"}
    assert log.first().asDict() == {"entity_id": 1, "user_id": "u", "action": "confirm", "previous_value": "PENDING", "new_value": "CONFIRMED"}
    base = spark.createDataFrame([("b", 1, 1, False), ("b", 2, 1, False)], "book_id string, line_num int, t int, deleted boolean")
    change = spark.createDataFrame([("b", 1, 2, True), ("b", 3, 2, False)], "book_id string, line_num int, t int, deleted boolean")
    assert {r["line_num"] for r in tables.upserted(base, change, ["book_id", "line_num"], "t").collect()} == {2, 3}
    path = str(tmp_path / "t")
    tables.replace_books(rows, path)
    tables.replace_books(spark.createDataFrame([(9, "NEW", "b")], "id int, status string, book_id string"), path)
    assert {(r["id"], r["book_id"]) for r in spark.read.parquet(path).collect()} == {(9, "b"), (3, "c")}
    assert tables.parity(rows, rows.filter("id < 3")) == {"left": 3, "right": 2, "only_left": 1, "only_right": 0}


def test_model(spark):
    assert model.salvaged('x <think>{"a": 1}</think> {"b": "}"} tail') == '{"b": "}"}'
    assert model.salvaged("```json\n[1, 2]\n```") == "[1, 2]" and model.salvaged("none") is None and model.salvaged('{"open": 1') is None and model.salvaged(None) is None
    prompts = spark.createDataFrame([("1", "s", "q1"), ("2", "s", "q2")], "prompt_id string, system string, user string")
    answers = model.asked(prompts, model.TableModel({"q1": 'sure: {"n": 5}'}))
    assert {r["prompt_id"]: r["parsed"]["n"] for r in model.parsed(answers, "n int").collect()} == {"1": 5, "2": None}

    calls = []

    def flaky(system, user, key=None):
        calls.append(key)
        if len(calls) < 3:
            raise RuntimeError("busy")
        return "ok"

    assert model.Retried(flaky, keys=("k1", "k2"), sleep=lambda s: None)("s", "u") == "ok" and calls == ["k1", "k2", "k1"]
    rows = spark.createDataFrame([("b", i, 10) for i in range(5)], "book_id string, seq int, n int")
    assert [r["group"] for r in model.budget_groups(rows, "n", 25).orderBy("seq").collect()] == [0, 0, 1, 1, 2]
    assert json.loads(model.mock_answer())["characters"]


def test_progress_stream(spark, tmp_path):
    src, cp = tmp_path / "in", str(tmp_path / "cp")
    src.mkdir()
    event = lambda stage, status, s: json.dumps({"book_id": "b", "stage": stage, "status": status, "ts": f"2024-01-01T00:00:{s:02}Z"})
    (src / "1.json").write_text("\n".join([event("extractor", "RUNNING", 1), event("validator", "RUNNING", 2)]))
    out = progress.run_once(progress.progress(progress.stream(spark, str(src))), "p1", cp).collect()
    assert [(r["progress"], r["failed"]) for r in out] == [(17.5, False)]
    (src / "2.json").write_text("\n".join([event("extractor", "COMPLETED", 5), event("extractor", "RUNNING", 3), event("validator", "FAILED", 6)]))
    out = progress.run_once(progress.progress(progress.stream(spark, str(src))), "p2", cp).collect()
    assert [(r["progress"], r["failed"]) for r in out] == [(25.0, True)]
    win = progress.run_once(progress.windowed_counts(progress.stream(spark, str(src))), "p3", str(tmp_path / "cp3")).collect()
    assert sum(r["n"] for r in win) == 5


def test_queries_have_rows(spark, sf):
    from loomwright.plans import catalog

    for name in ("clean_stats", "mention_counts", "arc_sessions", "stage_progress", "graph_stats"):
        assert catalog.QUERIES[name](spark, sf).count() > 0, name


def test_budget_groups_against_the_fold(spark):
    import random

    r = random.Random(4)
    rows = [(b, k, r.choice([None, 0, 3, 5, 9, 30])) for b in "abc" for k in range({"a": 200, "b": 1, "c": 37}[b])]
    want = {}
    for b in "abc":
        used = n = g = 0
        for _, k, size in [x for x in rows if x[0] == b]:
            if n and (used + (size or 0) > 25 or n >= 6):
                used, n, g = 0, 0, g + 1
            want[b, k] = g
            used, n = used + (size or 0), n + 1
    df = spark.createDataFrame(rows, "book_id string, seq int, n int").repartition(5)
    assert {(x["book_id"], x["seq"]): x["group"] for x in model.budget_groups(df, "n", 25, 6).collect()} == want
    assert model.budget_groups(df.filter("false"), "n", 25, 6).count() == 0
