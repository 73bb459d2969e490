"""Line-level noise: detectors, the choice among them, and cleaning.

A line's best suspicion is an expression over the line alone, so detecting and cleaning run inside one row a document,
without a shuffle. Two detectors look beyond the line: author notes (a fold over a document's lines) and repeated section
tails (counts within a document).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TRIMMED, trimmed


@dataclass(frozen=True)
class Lexicon:
    """Patterns of the detectors; the defaults are the fixed values for Chinese web novels."""

    # Patterns and word lists.
    url: str = r"(?i)(?:https?://|www\.)\S+|\S+\.(?:com|cn|net|org|cc|me|io|xyz|top|vip|club)(?![0-9A-Za-z_])"
    #: What every url has; a cheap test before the pattern, which backtracks in each word.
    url_hint: str = r"(?i)https?://|www\.|\.(?:com|cn|net|org|cc|me|io|xyz|top|vip|club)"
    promo: tuple[str, ...] = ("公众号", "微信", "QQ群", "qq群", "QQ 群", "书友群", "读者群", "订阅", "下载APP", "下载 APP", "扫码", "二维码", "加群", "入群", "微信号", "公号", "百度搜索", "最新章节", "全文阅读", "继续阅读")
    templates: tuple[str, ...] = (
        "本书由.{1,20}整理", "更多.{1,30}(?:请访问|请到|请搜索|请关注)", "本(?:文|书|章)来自", "(?:免费|正版).{0,10}(?:小说|阅读)", "(?:转载|搬运).{0,10}(?:请注明|出处)",
        "(?:起点|纵横|17k|晋江|红袖|潇湘|飞卢|番茄).{0,20}(?:首发|原创|独家|连载)", "(?:txt|TXT).{0,10}(?:下载|全集|全本)", "(?:新书|新作).{0,10}(?:求收藏|求推荐|求月票|求打赏)", "(?:收藏|推荐|月票|打赏).{0,5}(?:感谢|谢谢|多谢)",
    )
    decoration: str = r"^\s*[-=*#~_※◆◇■□●○▲△▼▽☆★♦♣♠♥┅┄┈═╌]{5,}\s*$"
    note_start: str = r"^\s*[（(]?(?:作者|笔者|写手|[Pp][Ss])[：:，,、\s]?(?:的话|题外话|感言|留言|请假|请假条|请假通知|停更|断更|今日|昨天|昨天一|今日一|大家|唠|碎碎念|叨叨)"
    note_end: str = r"(?i)^\s*[）)]?\s*(?:以上|完毕|结束|over|就这样|谢谢|感谢)[\s。.]*$"
    page_number: str = r"^\s*\d+\s*/\s*\d+\s*$"
    navigation: str = r"^\s*(?:上一章|下一章|返回目录|章节目录|目录)\s*$"
    orphan: str = r"^[\x{4E00}-\x{9FFF}]$"
    good_chars: str = r"[\x{00}-\x{20}\x{3000}-\x{303F}\x{4E00}-\x{9FFF}\x{FF00}-\x{FFEF}\x{21}-\x{7E}]"
    garbled_share: float = 0.4
    garbled_least: int = 10
    longest: int = 200
    url_rest: int = 30
    #: What every promo line, template, navigation line, orphan and start of a note has: texts without it are not asked for those.
    marked: str | None = None
    #: Whether all of ASCII but DEL is good: then only what is beyond it can be garbled.
    ascii_good: bool = False


DEFAULT = Lexicon(marked=r"[\x{4E00}-\x{9FFF}]", ascii_good=True)
#: Detectors in order of precedence; among equal confidences the earlier one wins.
CATEGORIES = ("url", "promo", "template", "decoration", "garbled", "meta", "repeated")
REMOVED_FROM = 0.8
NOTE_LINES = 30


def url_rest(line: Column, lex: Lexicon = DEFAULT) -> Column:
    """What a line is without its urls."""
    return trimmed(F.regexp_replace(trimmed(line), lex.url, ""))


def garbled_ratio(t: Column, lex: Lexicon = DEFAULT) -> Column:
    """Share of a trimmed line's characters that are none of the good ones."""
    return F.length(F.regexp_replace(t, f"(?:{lex.good_chars})+", "")) / F.greatest(F.length(t), F.lit(1))


def _any(t: Column, patterns: tuple[str, ...], prefix: str = "") -> Column:
    return t.rlike(prefix + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def candidates(line: Column, lex: Lexicon = DEFAULT, t: Column | None = None, marked: Column | None = None) -> dict[str, tuple[Column, float]]:
    """Whether each one-line detector fires, with its confidence (``t``: the trimmed line, ``marked``: whether its text has ``lex.marked``, where they are at hand)."""
    t = trimmed(line) if t is None else t
    marked = F.lit(True) if marked is None else marked
    some = F.length(t) > 0
    short = marked & (F.length(t) <= lex.longest)
    # A character beyond ASCII has a byte more at least.
    strange = F.contains(t, F.lit("\x7f")) | (F.octet_length(t) - F.length(t) >= lex.garbled_share * F.length(t) - 1) if lex.ascii_good else F.lit(True)
    return {
        "url": (t.rlike(lex.url_hint) & t.rlike(lex.url) & (F.length(url_rest(line, lex)) <= lex.url_rest), 0.9),
        "promo": (some & short & _any(t, tuple(re.escape(p) for p in lex.promo), "(?iu)"), 0.85),
        "template": (some & short & _any(t, lex.templates), 0.8),
        "decoration": (line.rlike(lex.decoration), 0.9),
        "garbled": ((F.length(t) >= lex.garbled_least) & strange & (garbled_ratio(t, lex) > lex.garbled_share), 0.85),
        "meta": (some & (t.rlike(lex.page_number) | (marked & t.rlike(lex.navigation))), 0.95),
        "orphan": (marked & t.rlike(lex.orphan), 0.6),
    }


def best(line: Column, lex: Lexicon = DEFAULT, note: Column | None = None, repeated: Column | None = None, t: Column | None = None, marked: Column | None = None) -> Column:
    """The suspicion of a line, ``struct<confidence, order, category>`` or null: greatest confidence, then the earlier detector.

    ``note`` is the confidence that an author-note fold gave the line (it takes the place of the other meta rules),
    ``repeated`` whether the line is a repeated tail.
    """
    found = []
    for name, (fires, confidence) in candidates(line, lex, t, marked).items():
        category = "meta" if name == "orphan" else name
        if note is not None and category == "meta":
            fires = fires & note.isNull()
        found.append((fires, F.lit(confidence), category))
    if note is not None:
        found.append((note.isNotNull(), note, "meta"))
    if repeated is not None:
        found.append((repeated, F.lit(0.75), "repeated"))
    structs = [F.when(f, F.struct(c.cast("double").alias("confidence"), F.lit(-CATEGORIES.index(k)).alias("order"), F.lit(k).alias("category"))) for f, c, k in found]
    return F.array_max(F.array_compact(F.array(*structs)))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, line_num`` (from 1) ``, line``."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("line_num"), "line")


def note_fold(text: str, start: re.Pattern, end: re.Pattern, limit: int = NOTE_LINES) -> list[float | None]:
    """Confidence of each line as part of an author's note: 0.9 where one starts, then 0.7 to its end mark or ``limit`` lines later."""
    out: list[float | None] = []
    began = -1
    for i, raw in enumerate(text.split("\n")):
        line = raw.strip(TRIMMED)
        if not line:
            out.append(None)
        elif began < 0:
            hit = len(line) < 80 and start.search(line) is not None
            began = i if hit else -1
            out.append(0.9 if hit else None)
        else:
            out.append(0.7)
            if end.search(line) or i - began >= limit:
                began = -1
    return out


def with_notes(docs: DataFrame, text_col: str, out: str, lex: Lexicon = DEFAULT) -> DataFrame:
    """Adds an array with the note confidence of each line (a fold in one Arrow function: its state is a position).

    Only texts in which a note may start go to Python; the array of the others holds no confidence.
    """
    hint = "(?Um)" + re.sub(r"^\^(?:\\s\*)?", "", lex.note_start)  # without its anchor, so that it misses no line that is trimmed first

    @F.arrow_udf("array<double>")
    def fold(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        start, end = re.compile(lex.note_start), re.compile(lex.note_end)
        for texts in batches:
            yield pa.array([note_fold(t or "", start, end) for t in texts.to_pylist()], pa.list_(pa.float64()))

    starts = F.col(text_col).rlike(hint)
    return docs.withColumn(out, fold(F.when((F.col(text_col).rlike(lex.marked) & starts) if lex.marked else starts, F.col(text_col))))


def repeated_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n\n\n", share: float = 0.5, least: int = 4, last: int = 5) -> DataFrame:
    """``doc_id, tail, n, sections``: lines among the last of at least ``share`` of a document's sections."""
    sections = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), separator)).alias("section"))
    return section_tails(sections, share, least, last)


def section_tails(sections: DataFrame, share: float = 0.5, least: int = 4, last: int = 5) -> DataFrame:
    """``repeated_tails`` of sections that are rows (``doc_id, section``): a document's text need never stand in one row."""
    body = trimmed(F.col("section"))
    rows = sections.withColumn("_b", body).filter(F.length("_b") > 0).withColumn("_l", F.split("_b", "\n"))
    total = rows.groupBy("doc_id").agg(F.count("*").alias("sections")).filter(F.col("sections") >= least)
    rows = rows.select("doc_id", F.explode(F.slice("_l", F.greatest(F.size("_l") - last + 1, F.lit(1)), last)).alias("tail")).withColumn("tail", trimmed(F.col("tail"))).filter(F.length("tail") > 3)
    return rows.groupBy("doc_id", "tail").agg(F.count("*").alias("n")).join(total, "doc_id").filter(F.col("n") >= share * F.col("sections")).select("doc_id", "sections", "tail", "n")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lex: Lexicon = DEFAULT, notes: bool = True, tails: bool = True) -> DataFrame:
    """``doc_id, line_num, content`` (100 characters) ``, category, confidence`` of the suspect lines, one row a line."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = with_notes(base, "text", "note", lex) if notes else base.withColumn("note", F.lit(None).cast("array<double>"))
    rows = base.select("doc_id", "note", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    rows = rows.withColumns({"line_num": F.col("p") + 1, "tail": trimmed(F.col("line")), "conf": F.get("note", F.col("p"))}).drop("note", "p")
    repeated = None
    if tails:
        found = repeated_tails(base, "doc_id", "text").select("doc_id", "tail", F.lit(True).alias("again"))
        rows = rows.join(found, ["doc_id", "tail"], "left")
        repeated = F.coalesce(F.col("again"), F.lit(False))
    told = rows.withColumn("b", best(F.col("line"), lex, F.col("conf") if notes else None, repeated, F.col("tail"))).filter("b is not null")
    return told.select("doc_id", "line_num", F.substring("tail", 1, 100).alias("content"), F.col("b.category").alias("category"), F.col("b.confidence").alias("confidence"))


def counts(suspects: DataFrame) -> DataFrame:
    """``doc_id`` and the number of suspect lines of each category, zeros included."""
    return suspects.groupBy("doc_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in CATEGORIES])


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lex: Lexicon = DEFAULT, aggressive: bool = False, keep: DataFrame | None = None) -> DataFrame:
    """``doc_id, text, n_lines, n_removed`` without the suspect lines; rows ``doc_id, line_num`` of ``keep`` are never removed.

    All but the keep-lines is done inside a document's row. Repeated tails are less sure than what the default removes, so
    only ``aggressive`` cleaning counts them (which takes a join on the document).
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("marked", F.col("text").rlike(lex.marked) if lex.marked else F.lit(True))
    base = with_notes(base, "text", "note", lex)
    if keep is not None:
        kept = keep.groupBy("doc_id").agg(F.collect_set(F.col("line_num").cast("int")).alias("kept"))
        base = base.join(kept, "doc_id", "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<int>")))
    else:
        base = base.withColumn("kept", F.array().cast("array<int>"))
    least = 0.0 if aggressive else REMOVED_FROM
    if aggressive:
        again = repeated_tails(base, "doc_id", "text").groupBy("doc_id").agg(F.collect_list("tail").alias("tails"))
        base = base.join(again, "doc_id", "left").withColumn("tails", F.coalesce("tails", F.array().cast("array<string>")))

    def stays(x: Column, i: Column) -> Column:
        repeated = F.array_contains("tails", x["t"]) if aggressive else None
        return F.coalesce(best(x["line"], lex, F.get("note", i), repeated, x["t"], F.col("marked"))["confidence"] < least, F.lit(True)) | F.array_contains("kept", i + 1)

    split = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), trimmed(x).alias("t")))
    flagged = base.select("doc_id", F.transform(split, lambda x, i: F.struct(x["line"].alias("line"), stays(x, i).alias("stays"))).alias("l"))
    left = F.transform(F.filter("l", lambda x: x["stays"]), lambda x: x["line"])
    return flagged.select("doc_id", F.array_join(left, "\n").alias("text"), F.size("l").alias("n_lines"), (F.size("l") - F.size(left)).alias("n_removed"))


def in_range(suspects: DataFrame, chapters: DataFrame) -> DataFrame:
    """Suspect lines of each chapter (``doc_id, chapter_index, start_line, end_line``): an equi-join on the document, then the range."""
    return suspects.join(chapters, "doc_id").filter(F.col("line_num").between(F.col("start_line"), F.col("end_line"))).select("doc_id", "chapter_index", "line_num", "category", "confidence")


def outline(suspects: DataFrame, keep: DataFrame, aggressive: bool = False, limit: int = 200) -> DataFrame:
    """The first suspects of each document with ``removed`` and ``restored`` flags (the limit is the report's)."""
    from pyspark.sql import Window

    kept = keep.select("doc_id", F.col("line_num").cast("int").alias("line_num"), F.lit(True).alias("restored")).distinct()
    rows = suspects.join(kept, ["doc_id", "line_num"], "left").withColumn("restored", F.coalesce("restored", F.lit(False)))
    removed = (F.col("confidence") >= (0.0 if aggressive else REMOVED_FROM)) & ~F.col("restored")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_num"))
    return rows.withColumn("removed", removed).withColumn("rank", rank).filter(F.col("rank") <= limit).drop("rank")


def older(lex: Lexicon = DEFAULT) -> Lexicon:
    """The older detector set: urls may hide behind blanks and wide letters (apply to narrowed text without white space)."""
    from dataclasses import replace

    return replace(lex, url_hint=r"(?i)h\s*t\s*t\s*p|w\s*w\s*w|\.\s*(?:com|cn|net|org|cc|me|io|xyz|top|vip|club)", url=r"(?i)(?:h\s*t\s*t\s*p\s*s?\s*:\s*/\s*/|w\s*w\s*w\s*\.)\S+|\S+\s*\.\s*(?:com|cn|net|org|cc|me|io|xyz|top|vip|club)(?![0-9A-Za-z_])")
