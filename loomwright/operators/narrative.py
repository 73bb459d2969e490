"""Events, arcs, story segments, boundary reviews and three-act analysis: windows, range joins and ordered aggregates.

Rules that name a book's people and things are parameters (``Rules``); the defaults are the fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import narrative_sentences, slug_part, trimmed


@dataclass(frozen=True)
class Rules:
    # Fixed values: (pattern, result), the first that fits counts.
    types: tuple[tuple[str, str], ...] = (("解除婚约|退婚|休书", "conflict"), ("聚气散|丹药|赔礼", "resource"), ("三年之约|立下.*约", "turning_point"), ("药老|戒指|秘密|现身", "reveal"), ("炼药|修炼", "training"), ("借钱|筹钱|目标", "goal"))
    functions: tuple[tuple[str, str], ...] = (("解除婚约|退婚", "inciting"), ("聚气散|赔礼", "escalation"), ("休书|三年之约", "turning_point"))
    by_type: tuple[tuple[str, str], ...] = (("reveal", "inciting"), ("training", "setup"), ("goal", "setup"))
    cues: tuple[tuple[str, tuple[str, ...]], ...] = (("婚约|退婚", ("解除婚约", "退婚", "婚约")), ("聚气散", ("聚气散",)), ("休书", ("休书",)), ("三年之约|三年", ("三年之约", "三年")), ("戒指|药老|秘密|现身", ("药老", "戒指", "秘密", "现身")), ("炼药|修炼|筹钱|借钱", ("炼药", "修炼", "借钱", "筹钱")))
    consequences: tuple[tuple[str, str], ...] = (("解除婚约|退婚", "婚约冲突公开化，主角尊严受压。"), ("聚气散", "外部势力用资源交换制造羞辱和诱惑。"), ("休书", "主角夺回主动权，冲突升级。"), ("三年之约", "冲突被延展为长期目标。"), ("药老|戒指", "隐藏助力浮出水面，修炼线开启。"))
    arcs: tuple[tuple[str, str, str], ...] = (("婚约|退婚|休书|三年之约", "退婚冲突", "conflict"), ("戒指|药老|秘密|现身", "戒指秘密", "reveal"), ("炼药|修炼", "修炼目标", "training"), ("聚气散|丹药|资源", "资源争夺", "resource"))
    props: str = "聚气散|戒指|休书|丹药|玉匣|古玉盒"
    worldbuilding: tuple[tuple[str, str], ...] = (("斗气大陆|世界观|设定", "worldbuilding"),)
    metadata: str = "^(?:书名|作者|简介|序言?)[:：]"


RULES = Rules()
MAX_GAP = 2
CONFIDENT, MERGE_HINT = 0.82, 0.72


def _first_fit(text: Column, rules, default: Column) -> Column:
    out = default
    for pattern, result in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(result)).otherwise(out)
    return out


def event_type(summary: Column, rules: Rules = RULES) -> Column:
    return _first_fit(summary, rules.types, F.lit("other"))


def event_function(summary: Column, kind: Column, rules: Rules = RULES) -> Column:
    by_type = F.lit("escalation")
    for k, v in reversed(rules.by_type):
        by_type = F.when(kind == k, F.lit(v)).otherwise(by_type)
    return _first_fit(summary, rules.functions, by_type)


def cue_terms(summary: Column, rules: Rules = RULES) -> Column:
    """The cue words of a summary, else its first two characters."""
    lists = [F.when(summary.rlike(p), F.array(*[F.lit(c) for c in cues])).otherwise(F.array().cast("array<string>")) for p, cues in rules.cues]
    found = F.concat(*lists)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.substring(summary, 1, 2)))


def events(mentions: DataFrame, chapters: DataFrame, characters: DataFrame | None = None, rules: Rules = RULES) -> DataFrame:
    """Event mentions (``book_id, chapter_index, position, text, confidence, source``) enriched with evidence, type, function and people.

    Evidence is the first sentence of the chapter with a cue word, else the chapter's start.
    """
    rows = mentions.join(chapters.select("book_id", "chapter_index", "content"), ["book_id", "chapter_index"], "left").withColumn("content", F.coalesce("content", F.lit("")))
    cues = cue_terms(F.col("text"), rules)
    rows = rows.withColumn("cues", cues).withColumn("hits", F.filter(F.transform(narrative_sentences(F.col("content")), trimmed), lambda s: F.exists("cues", lambda c: F.contains(s, c))))
    evidence = F.substring(F.coalesce(F.get("hits", F.lit(0)), F.substring(trimmed(F.col("content")), 1, 120)), 1, 160)
    rows = rows.withColumns({"evidence": evidence, "event_type": event_type(F.col("text"), rules)}).drop("hits", "content")
    order = Window.partitionBy("book_id").orderBy("chapter_index", "position", "text")
    rows = rows.withColumns({"ordinal": F.row_number().over(order), "function": event_function(F.col("text"), F.col("event_type"), rules), "trigger": F.element_at("cues", 1), "consequence": _first_fit(F.col("text"), rules.consequences, F.lit(None).cast("string"))}).drop("cues")
    rows = rows.withColumn("event_id", F.concat(F.lit("event-"), slug_part(F.col("book_id").cast("string")), F.lit("-"), F.col("chapter_index"), F.lit("-"), F.col("ordinal")))
    if characters is not None:
        people = characters.select("book_id", "chapter_index", F.col("text").alias("who"))
        named = rows.join(people, ["book_id", "chapter_index"]).filter(F.contains("text", F.col("who")) | F.contains("evidence", F.col("who")))
        rows = rows.join(named.groupBy("book_id", "event_id").agg(F.slice(F.array_sort(F.collect_set("who")), 1, 8).alias("participants")), ["book_id", "event_id"], "left")
        rows = rows.withColumn("participants", F.coalesce("participants", F.array().cast("array<string>")))
    return rows


def arc_breaks(rows: DataFrame, keys: list[str], order: list[str], gap: Column, reveal: Column) -> DataFrame:
    """Adds ``arc`` (from 1): a new one where the gap is too wide, or at a reveal right after another kind."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(reveal).over(w)
    starts = F.when(before.isNull() | gap | (reveal & ~before), 1).otherwise(0)
    return rows.withColumn("_s", starts).withColumn("arc", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def arcs(ev: DataFrame, rules: Rules = RULES) -> DataFrame:
    """One row an arc: range, title, type, conflict and confidence."""
    w = Window.partitionBy("book_id").orderBy("ordinal")
    gap = F.col("chapter_index") - F.lag("chapter_index").over(w) > MAX_GAP
    rows = arc_breaks(ev.withColumn("_g", F.coalesce(gap, F.lit(False))), ["book_id"], ["ordinal"], F.col("_g"), F.col("event_type") == "reveal")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), " ")
    out = rows.groupBy("book_id", "arc").agg(
        F.min("chapter_index").alias("start_chapter"), F.max("chapter_index").alias("end_chapter"), F.count("*").alias("n_events"), F.avg("confidence").alias("a"),
        text.alias("t"), F.min_by("text", "ordinal").alias("first"), F.min_by("text", F.when(F.col("event_type") == "conflict", F.col("ordinal"))).alias("conflict"), F.array_sort(F.collect_list(F.struct("ordinal", "text", "event_type"))).alias("events"),
    )
    title = _first_fit(F.col("t"), [(p, t) for p, t, _ in rules.arcs], F.col("first"))
    kind = _first_fit(F.col("t"), [(p, k) for p, _, k in rules.arcs], F.lit("other"))
    confidence = F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.55), F.col("a") + F.when(F.col("n_events") > 1, 0.04).otherwise(0.0))), 2)
    arc_id = F.concat_ws("-", F.lit("arc"), slug_part(F.col("book_id").cast("string")), "start_chapter", "end_chapter", "arc")
    return out.select("book_id", "arc", arc_id.alias("arc_id"), title.alias("title"), kind.alias("arc_type"), "start_chapter", "end_chapter", F.coalesce("conflict", "first").alias("core_conflict"), confidence.alias("confidence"), "n_events", "events")


def narrative_chapters(chapters: DataFrame, least: int = 40, rules: Rules = RULES) -> DataFrame:
    """Chapters without metadata ones and, unless none is long enough, without short ones."""
    title, content = trimmed(F.coalesce("title", F.lit(""))), trimmed(F.coalesce("content", F.lit("")))
    rows = chapters.filter((F.length(content) > 0) & ~title.rlike(rules.metadata) & ~content.rlike("^(?:书名|作者|简介)[:：]"))
    long = F.length(content) >= least
    return rows.withColumn("_any", F.max(long).over(Window.partitionBy("book_id"))).filter(long | ~F.col("_any")).drop("_any")


#: Chapters of a bucket by which mentions and ranges meet.
BUCKET = 64


def in_chapters(mentions: DataFrame, ranges: DataFrame, id_col: str, width: int = BUCKET) -> DataFrame:
    """Mentions inside each range (``book_id, id, start_chapter, end_chapter``), the surest first (``ord``).

    An equi-join on the book and on buckets of ``width`` chapters, then the exact test. A range goes into each bucket that
    it touches and that the book's mentions span; a mention is in one bucket, so no pair comes twice.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    span = mentions.groupBy("book_id").agg(F.min(bucket("chapter_index")).alias("_lo"), F.max(bucket("chapter_index")).alias("_hi"))
    first, last = F.greatest(bucket("start_chapter"), F.col("_lo")), F.least(bucket("end_chapter"), F.col("_hi"))
    held = ranges.select("book_id", id_col, "start_chapter", "end_chapter").filter("start_chapter <= end_chapter").join(span, "book_id").filter(first <= last)
    held = held.withColumn("_bucket", F.explode(F.sequence(first, last))).drop("_lo", "_hi")
    rows = mentions.withColumn("_bucket", bucket("chapter_index")).join(held, ["book_id", "_bucket"]).drop("_bucket").filter(F.col("chapter_index").between(F.col("start_chapter"), F.col("end_chapter")))
    order = Window.partitionBy("book_id", id_col).orderBy(F.desc("confidence"), "chapter_index", "text")
    return rows.withColumn("ord", F.row_number().over(order))


def ranked_names(mentions: DataFrame, texts: DataFrame, id_col: str) -> DataFrame:
    """Names of 2 to 8 characters by how often they stand in the range's text: the first is ``main``, the next eight ``supporting``."""
    names = mentions.groupBy("book_id", id_col, "text").agg(F.min("ord").alias("ord")).filter(F.length("text").between(2, 8))
    rows = names.join(texts.select("book_id", id_col, "source_text"), ["book_id", id_col])
    n = ((F.length("source_text") - F.length(F.replace("source_text", F.col("text"), F.lit("")))) / F.length("text")).cast("long")
    rank = F.row_number().over(Window.partitionBy("book_id", id_col).orderBy(F.desc("n"), "ord"))
    rows = rows.withColumn("n", n).drop("source_text").withColumn("rank", rank)
    return rows.withColumn("role", F.when(F.col("rank") == 1, "main").when(F.col("rank") <= 9, "supporting"))


def chunk_segments(chapters: DataFrame, size: int = 12) -> DataFrame:
    """Where no events are known: every ``size`` chapters a segment; .78 as boundary confidence, .68 for a single chapter."""
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_index"))
    rows = chapters.withColumn("segment", F.floor((n - 1) / size).cast("int") + 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter_index", "content"))), lambda x: x["content"]), "\n\n")
    out = rows.groupBy("book_id", "segment").agg(F.min("chapter_index").alias("start_chapter"), F.max("chapter_index").alias("end_chapter"), F.count("*").alias("n_chapters"), F.min_by("title", "chapter_index").alias("a"), F.max_by("title", "chapter_index").alias("b"), text.alias("source_text"))
    title = F.when(F.col("a") != F.col("b"), F.concat_ws(" - ", "a", "b")).otherwise(F.coalesce("a", "b", F.col("book_id").cast("string")))
    return out.select("book_id", "segment", "start_chapter", "end_chapter", "n_chapters", title.alias("title"), "source_text", F.when(F.col("n_chapters") > 1, 0.78).otherwise(0.68).alias("boundary_confidence"))


def worldbuilding(chapters: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Chapters that their title marks as setting."""
    return chapters.withColumn("kind", _first_fit(F.coalesce("title", F.lit("")), rules.worldbuilding, F.lit(None).cast("string"))).filter("kind is not null")


def arc_segments(arc: DataFrame, chapters: DataFrame, people: DataFrame, places: DataFrame | None = None, rules: Rules = RULES) -> DataFrame:
    """Story segments from arcs: the range's text, ranked people, up to 8 places and turning points, and a summary."""
    joined = arc.join(chapters.select("book_id", "chapter_index", "content"), "book_id", "left")
    inside = F.col("chapter_index").between(F.col("start_chapter"), F.col("end_chapter"))
    first = Window.partitionBy("book_id", "arc")
    use = joined.withColumns({"_in": inside, "_any": F.max(inside).over(first), "_first": F.min("chapter_index").over(first)}).filter(F.col("_in") | (~F.coalesce("_any", F.lit(False)) & (F.col("chapter_index") == F.col("_first"))))
    texts = use.groupBy("book_id", "arc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter_index", "content"))), lambda x: x["content"]), "\n\n").alias("source_text"))
    ranked = ranked_names(in_chapters(people, arc, "arc"), texts, "arc")
    cast = ranked.groupBy("book_id", "arc").agg(F.max(F.when(F.col("role") == "main", F.col("text"))).alias("main"), F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "supporting", F.struct("rank", "text")))), lambda x: x["text"]).alias("supporting"))
    rows = arc.join(texts, ["book_id", "arc"], "left").join(cast, ["book_id", "arc"], "left")
    if places is not None:
        spots = in_chapters(places, arc, "arc").filter(F.length("text") >= 2).groupBy("book_id", "arc", "text").agg(F.min("ord").alias("ord"))
        rows = rows.join(spots.groupBy("book_id", "arc").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), 1, 8).alias("locations")), ["book_id", "arc"], "left")
    props = F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce("source_text", F.lit("")), F.lit(f"({rules.props})"), F.lit(1))), 1, 3)
    turns = F.slice(F.array_distinct(F.concat(F.transform("events", lambda e: e["text"]), props)), 1, 8)
    rows = rows.withColumn("turning_points", turns)
    summary = F.concat(F.coalesce("main", F.lit("主角")), F.lit("卷入“"), F.col("title"), F.lit("”："), F.array_join(F.slice("turning_points", 1, 3), "、"), F.lit("。"))
    return rows.withColumns({"summary": summary, "boundary_confidence": F.col("confidence"), "story_id": F.concat_ws("-", F.lit("story"), slug_part(F.col("book_id").cast("string")), "start_chapter", "end_chapter", "arc")})


def boundary_reviews(segments: DataFrame) -> DataFrame:
    """Segments whose boundary is doubtful: what is before them, the shared main people, and whether a merge suggests itself."""
    w = Window.partitionBy("book_id").orderBy("start_chapter", "segment_id")
    rows = segments.withColumns({"prev_id": F.lag("segment_id").over(w), "prev_end": F.lag("end_chapter").over(w), "prev_people": F.lag("main_characters").over(w)})
    shared = F.array_intersect("main_characters", F.coalesce("prev_people", F.array().cast("array<string>")))
    rows = rows.withColumns({"shared": shared, "can_merge": F.col("prev_id").isNotNull()}).filter(F.col("boundary_confidence") < CONFIDENT)
    merge = F.col("can_merge") & (F.size("shared") > 0) & (F.col("boundary_confidence") < MERGE_HINT)
    return rows.select("book_id", "segment_id", "prev_id", F.coalesce("prev_end", "start_chapter").alias("left_chapter"), F.when(F.col("can_merge"), F.col("start_chapter")).otherwise(F.col("end_chapter")).alias("right_chapter"), F.when(merge, "merge_with_previous").otherwise("confirm").alias("suggestion"), "boundary_confidence", F.size("shared").alias("n_shared"), "can_merge")


def merged_with_previous(segments: DataFrame, decisions: DataFrame) -> DataFrame:
    """Segments decided to merge join the one before (chains too): ranges, people (8), turning points (12) and the best confidence."""
    w = Window.partitionBy("book_id").orderBy("start_chapter", "segment_id")
    yes = decisions.select("book_id", "segment_id", F.lit(True).alias("_m"))
    rows = segments.join(yes, ["book_id", "segment_id"], "left").withColumn("_new", F.when(F.coalesce("_m", F.lit(False)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    rows = rows.withColumns({"_g": F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_o": F.row_number().over(w)})
    flat = lambda c, k: F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_o", F.col(c).alias("v")))), lambda x: x["v"]))), 1, k)
    return rows.groupBy("book_id", "_g").agg(F.min_by("segment_id", "_o").alias("segment_id"), F.min("start_chapter").alias("start_chapter"), F.max("end_chapter").alias("end_chapter"), flat("main_characters", 8).alias("main_characters"), flat("turning_points", 12).alias("turning_points"), F.max("boundary_confidence").alias("boundary_confidence"), (F.count("*") == 1).alias("approved")).drop("_g")


# -- three acts -----------------------------------------------------------------

# Words of turning points.
TURNS = {
    "INCITING": ("突然", "意外", "变故", "开始", "起因", "suddenly", "unexpected", "began"),
    "MIDPOINT": ("转折", "真相", "发现", "秘密", "reveal", "discover", "truth", "secret"),
    "CLIMAX": ("终于", "最后", "关键时刻", "决定性", "生死关头", "高潮", "finally", "at last", "crucial moment", "climax", "turning point"),
}


def turning_points(chapters: DataFrame, words: dict[str, tuple[str, ...]] = TURNS) -> DataFrame:
    """``book_id, i, type, word``: words in their band of the book (first 15 %, the middle fifth once, from 70 % on)."""
    w = Window.partitionBy("book_id")
    rows = chapters.withColumns({"i": F.row_number().over(w.orderBy("chapter_index")) - 1, "n": F.count("*").over(w)})
    bands = {"INCITING": F.col("i") < 0.15 * F.col("n"), "MIDPOINT": (F.col("i") >= 0.4 * F.col("n")) & (F.col("i") <= 0.6 * F.col("n")), "CLIMAX": F.col("i") >= 0.7 * F.col("n")}
    hits = []
    for k, (kind, band) in enumerate(bands.items()):
        word = F.coalesce(*[F.when(F.contains("content", F.lit(x)), F.lit(x)) for x in words[kind]])
        hits.append(F.when(band & word.isNotNull(), F.struct(F.lit(k).alias("k"), F.lit(kind).alias("type"), word.alias("word"))))
    found = rows.select("book_id", "i", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("book_id", "i", "h.k", "h.type", "h.word")
    once = F.row_number().over(Window.partitionBy("book_id", "type").orderBy("i"))
    return found.withColumn("_n", once).filter((F.col("type") != "MIDPOINT") | (F.col("_n") == 1)).drop("_n")


def acts(chapters: DataFrame, turns: DataFrame) -> DataFrame:
    """``book_id, i, act_type, phase, confidence`` of every chapter by its place, given the first turning point within one chapter."""
    w = Window.partitionBy("book_id")
    rows = chapters.select("book_id", (F.row_number().over(w.orderBy("chapter_index")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    near = turns.select("book_id", F.struct("i", "k", "type").alias("t"), F.explode(F.array(F.col("i") - 1, F.col("i"), F.col("i") + 1)).alias("i")).groupBy("book_id", "i").agg(F.min("t").alias("t"))
    rows = rows.join(near, ["book_id", "i"], "left")
    r, t = F.col("i") / F.col("n"), F.coalesce(F.col("t.type"), F.lit(""))
    kind = (
        F.when(r < 0.1, "ACT_1_SETUP").when(r < 0.25, F.when(t == "INCITING", "ACT_1_INCITING").otherwise("ACT_1_SETUP")).when(r < 0.4, "ACT_2_RISING").when(r < 0.5, F.when(t == "MIDPOINT", "ACT_2_MIDPOINT").otherwise("ACT_2_COMPLICATIONS"))
        .when(r < 0.65, "ACT_2_CLIMAX_PREP").when(r < 0.75, F.when(t == "CLIMAX", "ACT_3_CLIMAX").otherwise("ACT_2_CLIMAX_PREP")).when(r < 0.9, "ACT_3_FALLING").otherwise("ACT_3_RESOLUTION")
    )
    return rows.select("book_id", "i", kind.alias("act_type"), F.substring(kind, 1, 5).alias("phase"), F.when(t != "", 0.8).otherwise(0.6).alias("confidence"))


def act_summary(act: DataFrame, turns: DataFrame) -> DataFrame:
    n = turns.groupBy("book_id").agg(F.count("*").alias("k"))
    rows = act.groupBy("book_id").agg(*[F.count_if(F.col("phase") == f"ACT_{p}").alias(f"act{p}") for p in (1, 2, 3)]).join(n, "book_id", "left")
    return rows.select("book_id", "act1", "act2", "act3", F.coalesce("k", F.lit(0)).alias("turning_points"), F.format_string("Act 1: %d chapters, act 2: %d, act 3: %d; %d turning points", "act1", "act2", "act3", F.coalesce("k", F.lit(0))).alias("summary"))
