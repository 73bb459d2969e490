import re

from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import noise


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_normalization(spark):
    assert one(spark, "\n\na\r\nb\rc​ Ａ１．　x  \n\n\n\ny\n", T.normalized) == "a\nb\nc A1. x\n\ny"
    rep = spark.createDataFrame([("a\r\nb​Ａ　\n\n\n\nc",)], "t string").select(*[c.alias(k) for k, c in T.normalization_report(F.col("t")).items()]).first().asDict()
    assert rep == {"crlf_fixed": 1, "invisible_removed": 1, "whitespace_fixed": 1, "fullwidth_fixed": 1, "blank_compressed": 2}


def test_small_functions(spark):
    assert one(spark, " a 　b\n", T.word_count) == 2
    assert one(spark, "a/b: c  d-", T.book_slug) == "ab-c-d"
    assert one(spark, "Hello, World", T.slug_part) == "hello-world"
    assert one(spark, "书", T.slug_part) == "e4b9a6"
    assert one(spark, "他走了。她来了！\n好", T.description_sentences) == ["他走了。", "她来了！", "好"]
    assert one(spark, "红衣，“黑发”；高大", T.clauses) == ["红衣，", "黑发”；", "高大"]
    assert one(spark, "冷笑冷笑冷笑冷笑", T.without_repeats) == "冷笑"
    df = spark.createDataFrame([(["身材高大", "高大", None, "黑衣，身材高大。"],)], "p array<string>")
    assert df.select(T.merged_descriptions(F.col("p")).alias("x")).first()["x"] == "黑衣，身材高大。"


def test_each_detector(spark):
    text = "\n".join(["www.abc.com", "关注公众号某某", "本书由某某整理完毕", "=======", "正文在这里说话", "12 / 30", "字", "下一章", "§§§§§§§§§§§§§", ""])
    rows = noise.detect(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    got = {r["line_num"]: (r["category"], r["confidence"]) for r in rows}
    assert got == {1: ("url", 0.9), 2: ("promo", 0.85), 3: ("template", 0.8), 4: ("decoration", 0.9), 6: ("meta", 0.95), 7: ("meta", 0.6), 8: ("meta", 0.95), 9: ("garbled", 0.85)}


def test_ties_go_to_the_earlier_detector(spark):
    # promo (.85) and garbled (.85)
    text = "微信§§§§§§§§§§§§§§§§§§"
    r = noise.detect(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert (r["category"], r["confidence"]) == ("promo", 0.85)


def test_clean_and_keep(spark):
    docs = spark.createDataFrame([(1, "正文\n公众号\n字\n完"), (2, None), (3, "")], "doc_id int, text string")
    out = {r["doc_id"]: (r["text"], r["n_removed"]) for r in noise.cleaned(docs).collect()}
    assert out == {1: ("正文\n字\n完", 1), 2: ("", 0), 3: ("", 0)}
    keep = spark.createDataFrame([(1, 2)], "doc_id int, line_num int")
    out = {r["doc_id"]: r["text"] for r in noise.cleaned(docs, aggressive=True, keep=keep).collect()}
    assert out[1] == "正文\n公众号"


def test_author_note_ends_after_limit():
    start, end = re.compile(noise.DEFAULT.note_start), re.compile(noise.DEFAULT.note_end)
    text = "\n".join(["作者的话"] + ["说明"] * 40)
    conf = noise.note_fold(text, start, end)
    assert conf[0] == 0.9 and conf[1:31] == [0.7] * 30 and conf[31:] == [None] * 10
    assert noise.note_fold("作者的话\n啊\n完毕\n正文", start, end) == [0.9, 0.7, 0.7, None]


def test_repeated_tails(spark):
    book = "\n\n\n".join(f"第{i}段正文\n咱们下回再见吧" for i in range(5))
    docs = spark.createDataFrame([(1, book), (2, "a\n\n\nb")], "doc_id int, text string")
    assert [(r["doc_id"], r["tail"], r["n"]) for r in noise.repeated_tails(docs).collect()] == [(1, "咱们下回再见吧", 5)]
    found = noise.detect(docs, notes=False).filter("category = 'repeated'")
    assert found.count() == 5
    assert noise.counts(noise.detect(docs)).filter("doc_id = 1").first()["n_repeated"] == 5
