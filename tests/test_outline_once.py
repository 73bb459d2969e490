"""The outline of documents: cleaned once, and what is no heading stays in its row."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import noise, segmentation
from loomwright.plans import prescan

BITS = ["第一章 风起\n", "第三卷 山河\n", "楔子\n", "Chapter 4: x\n", "12. list item\n", "a body line of some length\n", "正文在此，天色已晚。\n", "\n", "\r\n", "\r", "\x85", " ", " ", "　", "​", "Ａ１．", "作者的话\n", "扫码加群 QQ群\n", "上一章\n", "中\n", "\x7f" * 12 + "\n", "é" * 12 + "\n", "é" * 4 + "abcdef\n", "trailing \t \n", "\x1c第九章\n", "\x0b第8章\n"]


def test_texts_are_cleaned_once_and_plain_ones_stay(spark):
    rows = [("plain", "no heading here.\nnor here."), ("headed", "前言\n第三卷 山河\n第一章 风起\n正文在此。\n第二章 云涌\n正文又来。"), ("one", "第一章 风起\n正文在此。"), ("none", None)]
    out = prescan.outline(spark.createDataFrame(rows, "doc_id string, text string"))
    got = {(r["doc_id"], r["chapter_index"]): (r["mode"], r["volume_idx"], r["number"]) for r in out.collect()}
    assert got == {("plain", 0): ("fixed", None, 1), ("one", 0): ("fixed", None, 1), ("headed", 0): ("first", None, 1), ("headed", 1): ("chapter_zh", 0, 2), ("headed", 2): ("chapter_zh", 0, 3)}
    assert "https?" not in out._jdf.queryExecution().optimizedPlan().toString()  # the pattern of the cleaning, which each way of splitting repeated


def test_shortcuts_change_nothing(spark):
    """Against the steps one by one, the detectors without shortcuts, and the headings of each line."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(k, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 12)))) for k in range(1500)], "doc_id int, text string")
    c = F.col("text")
    for step in (T.unix_lines, T.visible, T.regular_spaces, T.narrow, lambda x: F.regexp_replace(x, r"(?m)[ \t]+$", ""), T.few_blank_lines):
        c = step(c)
    assert docs.filter(~T.normalized(F.col("text")).eqNullSafe(c)).count() == 0
    slow = noise.Lexicon()
    assert slow.marked is None and not slow.ascii_good
    found = [sorted(map(tuple, noise.cleaned(docs, lex=lex).collect())) for lex in (noise.DEFAULT, slow)]
    assert found[0] == found[1] and any(r[3] for r in found[0])
    more = segmentation.boundaries(noise.lines(docs)).filter("line_num > 1 and mode is not null").select("doc_id").distinct()
    assert more.count() > 100 and docs.filter(~F.col("text").rlike(segmentation.HEADED)).join(more, "doc_id").count() == 0
