"""Mention aggregation, confidence and importance, as aggregates, windows and joins.

Mentions: ``book_id, type, text, chapter_index, position, confidence, seq`` and optionally ``total_count, all_chapters,
aliases``. Chapters: ``book_id, chapter_index, content``. Entities are keyed by ``book_id, type, text``.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from . import automaton

KEY = ["book_id", "type", "text"]
_CJK_PAIR = r"[\x{4E00}-\x{9FFF}]{2}"


def grouped(mentions: DataFrame, least_confidence: float = 0.6, least_count: int = 1) -> DataFrame:
    """One row an entity: the most confident mention (the last of equals), its count, chapters and aliases."""
    for c, t in (("total_count", "int"), ("all_chapters", "array<int>"), ("aliases", "array<string>")):
        if c not in mentions.columns:
            mentions = mentions.withColumn(c, F.lit(None).cast(t))
    chapters = F.coalesce("all_chapters", F.array(F.col("chapter_index").cast("int")))
    out = mentions.groupBy(*KEY).agg(
        F.max(F.struct("confidence", "seq", "chapter_index", "position")).alias("b"),
        F.greatest(F.count("*"), F.coalesce(F.max("total_count"), F.lit(0))).cast("long").alias("total_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(chapters)))).alias("all_chapters"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>")))))).alias("aliases"),
    )
    out = out.select(*KEY, F.col("b.confidence").alias("confidence"), F.col("b.seq").alias("seq"), F.col("b.chapter_index").alias("chapter_index"), F.col("b.position").alias("position"), "total_count", "all_chapters", "aliases")
    return out.filter((F.col("confidence") >= least_confidence) & (F.col("total_count") >= least_count))


def chapter_counts(chapters: DataFrame) -> DataFrame:
    return chapters.groupBy("book_id").agg(F.count("*").alias("n"))


def spread(entities: DataFrame) -> DataFrame:
    """Entities exploded to a row a chapter."""
    return entities.select(*KEY, F.explode("all_chapters").alias("c"))


def position_features(entities: DataFrame, chapters: DataFrame) -> DataFrame:
    p = F.col("c") / F.greatest(F.lit(1), F.col("n") - 1)
    rows = spread(entities).join(chapter_counts(chapters), "book_id").withColumn("p", p)
    return rows.groupBy(*KEY).agg(F.min("p").alias("first_position"), F.max("p").alias("last_position"), F.avg("p").alias("avg_position"), F.least(F.lit(1.0), 10 * F.var_pop("p")).alias("position_variance"))


def breadth(entities: DataFrame, chapters: DataFrame) -> DataFrame:
    """Coverage, longest run of consecutive chapters, and evenness of the gaps."""
    w = Window.partitionBy(*KEY).orderBy("c")
    rows = spread(entities).withColumns({"gap": F.col("c") - F.lag("c").over(w), "run": F.col("c") - F.row_number().over(w)})
    runs = rows.groupBy(*KEY, "run").agg(F.count("*").alias("k"), F.sum("gap").alias("g"), F.sum(F.col("gap") * F.col("gap")).alias("gg"), F.count("gap").alias("m"))
    out = runs.groupBy(*KEY).agg(F.sum("k").alias("chapter_count"), F.max("k").alias("max_run"), F.sum("g").alias("g"), F.sum("gg").alias("gg"), F.sum("m").alias("m"))
    out = out.join(chapter_counts(chapters), "book_id")
    variance = F.greatest(F.lit(0.0), F.col("gg") / F.col("m") - (F.col("g") / F.col("m")) * (F.col("g") / F.col("m")))
    uniformity = F.when(F.col("chapter_count") <= 1, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.sqrt(variance) / (F.col("n") / F.col("chapter_count"))))
    return out.select(*KEY, "chapter_count", F.col("n").alias("total_chapters"), (F.col("chapter_count") / F.greatest(F.lit(1), F.col("n"))).alias("coverage"), "max_run", uniformity.alias("uniformity"))


def moments(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population deviation, excess kurtosis and skewness of ``value``; 0 for the last two without deviation."""
    flat = F.coalesce(F.stddev_pop(value), F.lit(0.0)) == 0
    return counts.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.when(flat, 0.0).otherwise(F.kurtosis(value)).alias("kurtosis"), F.when(flat, 0.0).otherwise(F.skewness(value)).alias("skewness"))


def basic_stats(entities: DataFrame, chapters: DataFrame) -> DataFrame:
    """Moments of the 0/1 presence over all chapters, from the number present alone: no spine of zeros is built."""
    rows = entities.select(*KEY, F.size("all_chapters").alias("k")).join(chapter_counts(chapters), "book_id")
    p = F.col("k") / F.col("n")
    q = 1 - p
    std = F.sqrt(p * q)
    m3, m4 = p * q * (q - p), p * q * (q * q * q + p * p * p)
    flat = std == 0
    return rows.select(*KEY, p.alias("mean"), std.alias("std"), F.when(flat, 0.0).otherwise(m4 / (std * std * std * std) - 3).alias("kurtosis"), F.when(flat, 0.0).otherwise(m3 / (std * std * std)).alias("skewness"))


def window_text(content: Column, position: Column, reach: int) -> Column:
    lo = F.greatest(position - reach, F.lit(0))
    return content.substr(lo + 1, position + reach - lo)


def bigrams(text: Column, pattern: str = _CJK_PAIR) -> Column:
    """Distinct pairs of neighbouring characters that match (a look-ahead finds overlapping ones in one pass over the text)."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({pattern}))"), F.lit(1)))


def _windows(mentions: DataFrame, chapters: DataFrame, reach: int) -> DataFrame:
    """Mentions with the text around them; a mention without a place or chapter has none."""
    text = chapters.select("book_id", "chapter_index", "content")
    rows = mentions.join(text, ["book_id", "chapter_index"], "left")
    return rows.withColumn("w", F.when((F.col("position") >= 0) & F.col("content").isNotNull(), window_text(F.col("content"), F.col("position"), reach))).drop("content")


def semantic_features(entities: DataFrame, chapters: DataFrame, pattern: str = _CJK_PAIR) -> DataFrame:
    """Context variety, density and concentration over one pseudo-mention a chapter, all at the entity's own offset."""
    rows = entities.select(*KEY, "position", F.explode("all_chapters").alias("chapter_index"))
    near = _windows(rows, chapters, 50).withColumn("b", bigrams(F.coalesce("w", F.lit("")), pattern))
    variety = near.select(*KEY, F.explode("b").alias("b")).groupBy(*KEY).agg(F.countDistinct("b").alias("bigrams"))
    n = F.size("all_chapters")
    out = entities.join(variety, KEY, "left")
    return out.select(*KEY, F.least(F.lit(1.0), F.coalesce("bigrams", F.lit(0)) / (10 * n)).alias("diversity"), F.lit(0.2).alias("density"), (1 / n).alias("concentration"))


def substitutability(params: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``max(.5, 1 - .1 * n)`` with n the other entities of the group within 2 of the count and less than .1 of the coverage.

    Entities are counted by (count, coverage) first; these few combinations meet by an equi-join on the counts in reach.
    """
    keys = keys or ["book_id", "type"]
    tally = params.groupBy(*keys, "total_count", "coverage").agg(F.count("*").alias("k"))
    other = tally.select(*keys, F.col("coverage").alias("cv"), F.col("k").alias("ok"), F.explode(F.sequence(F.col("total_count") - 2, F.col("total_count") + 2)).alias("total_count"))
    near = tally.join(other, [*keys, "total_count"]).filter(F.abs(F.col("coverage") - F.col("cv")) < 0.1)
    n = near.groupBy(*keys, "total_count", "coverage").agg((F.sum("ok") - 1).alias("similar"))
    return params.join(n, [*keys, "total_count", "coverage"], "left").select(*keys, "text", F.greatest(F.lit(0.5), 1 - 0.1 * F.coalesce("similar", F.lit(0))).alias("substitutability"))


def confidence(entities: DataFrame, chapters: DataFrame, pattern: str = _CJK_PAIR) -> DataFrame:
    """Every feature and the overall confidence of each entity."""
    rows = entities.select(*KEY, "total_count")
    for part in (position_features(entities, chapters), breadth(entities, chapters), semantic_features(entities, chapters, pattern), basic_stats(entities, chapters)):
        rows = rows.join(part, KEY)
    rows = rows.join(substitutability(rows), KEY)
    c = F.col
    mention = F.least(F.lit(1.0), c("total_count") / 3)
    position = F.greatest(F.lit(0.3), 0.5 * c("position_variance") + 0.5 * (1 - F.abs(c("avg_position") - 0.5)))
    distribution = 0.6 * F.least(F.lit(1.0), 5 * c("coverage")) + 0.4 * c("uniformity")
    semantic = F.greatest(F.lit(0.3), 0.5 * c("diversity") + 0.5 * (1 - c("concentration")))
    raw = 0.3 * mention + 0.2 * position + 0.3 * distribution + 0.2 * semantic
    penalties = F.when(c("total_count") < 2, 0.7).otherwise(1.0) * c("substitutability") * F.when(c("std") > 3, 0.8).otherwise(1.0)
    return rows.withColumns({"mention_confidence": mention, "position_confidence": position, "distribution_confidence": distribution, "semantic_confidence": semantic, "overall": F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw * penalties))})


def tier(importance: Column, confidence: Column) -> Column:
    return F.when((importance >= 0.7) & (confidence >= 0.3), "core").when((importance >= 0.5) & (confidence >= 0.2), "supporting").when(importance >= 0.3, "candidate").otherwise("archived")


def route(tier_: Column) -> Column:
    return F.when(tier_.isin("core", "supporting"), "main").when(tier_ == "candidate", "staging").otherwise("archive")


# -- importance -----------------------------------------------------------------

ACTION_WEIGHT = {"character": 0.45, "event": 0.5, "item": 0.3, "location": 0.2}
STORY_VALUES = (0.0, 0.17, 0.33, 0.5, 0.67, 0.83, 1.0)


def _hits(text: Column, words) -> Column:
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def _chars(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]", ""))


def percentile_rank(by: list[str], order: str = "total_count") -> Column:
    """Share of the rows of a group that have no more."""
    return F.cume_dist().over(Window.partitionBy(*by).orderBy(order))


def behaviour_drive(entities: DataFrame, mentions: DataFrame, chapters: DataFrame) -> DataFrame:
    near = _windows(mentions, chapters, 50)
    acts = near.groupBy(*KEY).agg((F.sum(F.coalesce(F.col("w").rlike(f"[{lex.ACTION_CHARS}]").cast("int"), F.lit(0))) / F.count("*")).alias("density"))
    rank = percentile_rank(["book_id"])
    rows = entities.select(*KEY, "total_count", F.size("all_chapters").alias("k")).withColumn("rank", rank).join(chapter_counts(chapters), "book_id").join(acts, KEY, "left")
    freq = F.least(F.lit(1.0), F.log1p("total_count") / F.log1p(F.lit(20.0)))
    spread_ = F.least(F.lit(1.0), F.col("k") / F.greatest(F.lit(1.0), 0.12 * F.col("n")))
    act = F.coalesce(*[F.when(F.col("type") == t, w) for t, w in ACTION_WEIGHT.items()], F.lit(0.3))
    often = F.when(F.col("type") == "event", 0.2).otherwise(0.35)
    score = (0.4 * F.col("rank") + 0.6 * freq) * often + spread_ * F.greatest(F.lit(0.0), 1 - act - often) + F.coalesce("density", F.lit(0.0)) * act
    return rows.select(*KEY, score.alias("behaviour_drive"))


def irreplaceability(entities: DataFrame) -> DataFrame:
    """Longer, less common and less confusable texts score more; confusable are texts of the book that contain it or that it contains."""
    texts = entities.select("book_id", "text").distinct()
    n = F.length("text")
    pieces = texts.filter(n > 1).select("book_id", F.col("text").alias("whole"), F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring("text", i, k)))))).alias("text"))
    inside = texts.join(pieces, ["book_id", "text"]).select("book_id", "text", "whole")
    both = inside.select("book_id", "text", F.col("whole").alias("other")).union(inside.select("book_id", F.col("whole").alias("text"), F.col("text").alias("other")))
    similar = both.groupBy("book_id", "text").agg(F.countDistinct("other").alias("similar"))
    size = F.when(n <= 2, 0.3).when(n <= 3, 0.7).otherwise(1.0)
    unique = F.greatest(F.lit(0.0), 1 - 0.4 * _chars(F.col("text"), lex.COMMON_CHARS))
    distinct = F.greatest(F.lit(0.0), 1 - 0.3 * F.coalesce("similar", F.lit(0)))
    return entities.select(*KEY).join(similar, ["book_id", "text"], "left").select(*KEY, (0.25 * size + 0.35 * unique + 0.4 * distinct).alias("irreplaceability"))


def information_uniqueness(mentions: DataFrame, chapters: DataFrame, pattern: str = _CJK_PAIR) -> DataFrame:
    """Share of the pairs around an entity that no chapter without it has.

    One table of pairs by chapter serves all entities: a pair is unique to an entity if as many chapters have it as
    chapters of the entity do. A pair that more chapters have than the entity is in at all can't be, and is not looked up.
    """
    near = _windows(mentions, chapters, 150).withColumn("b", bigrams(F.coalesce("w", F.lit("")), pattern))
    own = near.select(*KEY, F.explode("b").alias("b")).distinct()
    by_chapter = chapters.select("book_id", "chapter_index", F.explode(bigrams(F.coalesce("content", F.lit("")), pattern)).alias("b"))
    everywhere = by_chapter.groupBy("book_id", "b").agg(F.count("*").alias("chapters"))
    present = mentions.select(*KEY, "chapter_index").distinct()
    size = present.groupBy(*KEY).agg(F.count("*").alias("here"))
    told = own.join(everywhere, ["book_id", "b"], "left").join(size, KEY)
    open_ = told.filter(F.col("chapters") <= F.col("here")).select(*KEY, "b")
    shared = open_.join(by_chapter, ["book_id", "b"]).join(present, [*KEY, "chapter_index"]).groupBy(*KEY, "b").agg(F.count("*").alias("inside"))
    told = told.join(shared, [*KEY, "b"], "left")
    unique = F.coalesce("chapters", F.lit(0)) <= F.coalesce("inside", F.lit(0))
    sums = told.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum(unique.cast("int")).alias("u"))
    score = 0.85 * F.col("u") / F.col("n") + 0.15 * F.least(F.lit(1.0), F.col("n") / 80)
    return mentions.select(*KEY).distinct().join(sums, KEY, "left").select(*KEY, F.coalesce(score, F.lit(0.0)).alias("information_uniqueness"))


def state_transition(mentions: DataFrame, chapters: DataFrame) -> DataFrame:
    near = _windows(mentions, chapters, 100)
    turns = sum((F.when(F.contains("w", F.lit(c)), k).otherwise(0) for c, k in Counter(lex.TRANSITION_CHARS).items()), F.lit(0))
    sums = near.groupBy(*KEY).agg(F.count("w").alias("w"), F.sum(_chars(F.col("w"), lex.EMOTION_CHARS)).alias("e"), F.sum(F.when(F.col("w").isNotNull(), turns)).alias("t"), F.countDistinct("chapter_index").alias("k"))
    rows = sums.join(chapter_counts(chapters), "book_id")
    ratio = lambda c, per: F.when(F.col("w") > 0, F.least(F.lit(1.0), F.col(c) / (per * F.col("w")))).otherwise(0.0)
    return rows.select(*KEY, (0.4 * ratio("e", 3) + 0.3 * ratio("t", 2) + 0.3 * F.least(F.lit(1.0), F.col("k") / (0.3 * F.col("n")))).alias("state_transition"))


def production_value(entities: DataFrame, mentions: DataFrame, chapters: DataFrame) -> DataFrame:
    near = _windows(mentions, chapters, 100)
    w = F.col("w")
    quotes = F.regexp_count(w, F.lit('[“"][^”"]+[”"]'))
    sums = near.groupBy(*KEY).agg(F.count("w").alias("w"), F.sum(_hits(w, lex.DETAIL_WORDS) + quotes).alias("d"), F.sum(_hits(w, lex.SPACE_WORDS) + _hits(w, lex.ACTION_WORDS) + quotes).alias("u"))
    rows = entities.select(*KEY, "total_count", F.size("all_chapters").alias("k")).join(sums.withColumnRenamed("w", "windows"), KEY, "left").join(chapter_counts(chapters), "book_id")
    part = lambda c: F.when(F.col("windows") > 0, F.least(F.lit(1.0), F.col(c) / (4 * F.col("windows")))).otherwise(0.0)
    person = F.col("type") == "character"
    cap, cover = F.when(person, 200.0).otherwise(20.0), F.when(person, 0.18).otherwise(0.08)
    floor = F.least(F.lit(1.0), 0.6 * F.least(F.lit(1.0), F.log1p("total_count") / F.log1p(cap)) + 0.4 * F.least(F.lit(1.0), F.col("k") / F.greatest(F.lit(1), F.col("n")) / cover))
    mean = (part("d") + part("u")) / 2
    score = F.when(F.col("type").isin("character", "event"), F.greatest(mean, floor)).otherwise(mean)
    return rows.select(*KEY, part("d").alias("writing_completeness"), part("u").alias("adaptation_usability"), score.alias("production"))


def pillar(raw: Column) -> Column:
    return F.when(raw >= 0.75, 2).when(raw >= 0.5, 1).otherwise(0)


def story_value(score: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in STORY_VALUES]), F.greatest(F.lit(0), F.least(F.lit(6), score)) + 1)


def story_tier(score: Column) -> Column:
    return F.when(score >= 5, "core").when(score >= 3, "supporting").when(score >= 1, "candidate").otherwise("archived")


def quadrant(importance_: Column, production: Column) -> Column:
    high, made = importance_ >= 0.5, production >= 0.5
    return F.when(high & made, "core").when(high, "supporting").when(made, "candidate").otherwise("archived")


def importance(entities: DataFrame, mentions: DataFrame, chapters: DataFrame, story_weight: float = 0.7, production_weight: float = 0.3) -> DataFrame:
    """All scores of each entity. Order by ``importance, story_score, mention_count`` descending, then text (``COLLATE zh``)."""
    rows = entities.select(*KEY, F.col("total_count").alias("mention_count"), F.col("all_chapters").alias("chapters"), "aliases")
    for part in (behaviour_drive(entities, mentions, chapters), irreplaceability(entities), information_uniqueness(mentions, chapters), state_transition(mentions, chapters), production_value(entities, mentions, chapters)):
        rows = rows.join(part, KEY)
    causal = pillar((F.col("behaviour_drive") + F.col("irreplaceability")) / 2)
    rows = rows.withColumns({"causal_necessity": causal, "information": pillar(F.col("information_uniqueness")), "transition": pillar(F.col("state_transition"))})
    rows = rows.withColumn("story_score", F.col("causal_necessity") + F.col("information") + F.col("transition"))
    rows = rows.withColumn("story_value", story_value(F.col("story_score")))
    rows = rows.withColumn("importance", story_weight * F.col("story_value") + production_weight * F.col("production"))
    return rows.withColumns({"story_tier": story_tier(F.col("story_score")), "quadrant": quadrant(F.col("importance"), F.col("production"))})


def model_entities(model: DataFrame, entities: DataFrame) -> DataFrame:
    """A model's entities (``book_id, type, name, aliases, confidence, first_chapter, chapter_appearances``) in the form of ``grouped``.

    Counts and chapters come from the scanned entities of one name or alias (any case); the place is the chapter's start.
    """
    empty, none = F.array().cast("array<string>"), F.array().cast("array<int>")
    keys = lambda d, name: d.withColumn("k", F.explode(F.array_distinct(F.transform(F.concat(F.array(name), F.coalesce("aliases", empty)), lambda x: F.lower(x)))))
    seen = keys(entities, "text").select("book_id", "type", "k", "total_count", "all_chapters")
    hits = keys(model.select("book_id", "type", "name", "aliases"), "name").join(seen, ["book_id", "type", "k"]).groupBy("book_id", "type", "name").agg(F.max("total_count").alias("n"), F.flatten(F.collect_list("all_chapters")).alias("c"))
    rows = model.join(hits, ["book_id", "type", "name"], "left")
    own = F.coalesce("chapter_appearances", none)
    chapters = F.array_sort(F.array_distinct(F.concat(own, F.coalesce("c", none))))
    count = F.coalesce("n", F.greatest(F.size(own), F.lit(1))).cast("long")
    return rows.select("book_id", "type", F.col("name").alias("text"), F.coalesce("confidence", F.lit(0.7)).alias("confidence"), F.lit(0).cast("long").alias("seq"), F.coalesce("first_chapter", F.get(chapters, F.lit(0)), F.lit(0)).alias("chapter_index"), F.lit(0).alias("position"), count.alias("total_count"), chapters.alias("all_chapters"), F.coalesce("aliases", empty).alias("aliases"))


def selected(entities: DataFrame, scored: DataFrame, confident: DataFrame, character_name: Column | None = None) -> DataFrame:
    """The working set: rows not routed to the archive (rows without a score stay), characters only with a plausible name."""
    rows = entities.join(scored.select(*KEY, F.col("importance").alias("_i")), KEY, "left").join(confident.select(*KEY, F.col("overall").alias("_c")), KEY, "left")
    where = route(tier(F.col("_i"), F.coalesce("_c", F.lit(0.0))))
    keep = F.col("_i").isNull() | (where != "archive")
    if character_name is not None:
        keep = keep & ((F.col("type") != "character") | character_name)
    return rows.filter(keep).drop("_i", "_c")


# -- signals --------------------------------------------------------------------

QUOTES = "[“「『\"][^”」』\"]*[”」』\"]"


def signals(chapters: DataFrame, names: list[str]) -> DataFrame:
    """``book_id, name, mention_count, dialogue_count, co_characters`` for a parameter list of names, zeros included.

    Each chapter is read once by an automaton of all names (any case; those without a CJK character stand apart from word
    characters) and gives one array of hits; only names found in it are exploded.
    """
    apart = [n for n in names if not re.search("[一-鿿]", n)]
    counted = automaton.with_hits(chapters, names, "content", "_h", fold=True, alone=apart)
    rows = counted.select("book_id", "chapter_index", F.transform("_h", lambda h: F.struct(h["name"].alias("name"), h["n"].alias("c"))).alias("hits"), F.regexp_count("content", F.lit(QUOTES)).alias("quotes"))
    rows = rows.withColumn("names", F.transform("hits", lambda x: x["name"])).withColumn("each", F.ceil(F.col("quotes") / F.size("hits")))
    found = rows.select("book_id", F.explode("hits").alias("h"), "names", "each").select("book_id", F.col("h.name").alias("name"), F.col("h.c").alias("c"), "each", F.array_remove("names", F.col("h.name")).alias("others"))
    sums = found.groupBy("book_id", "name").agg(F.sum("c").alias("mention_count"), F.sum("each").alias("dialogue_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("others")))).alias("co_characters"))
    spine = chapters.select("book_id").distinct().withColumn("name", F.explode(F.array(*[F.lit(n) for n in names])))
    out = spine.join(sums, ["book_id", "name"], "left")
    return out.withColumns({"mention_count": F.coalesce("mention_count", F.lit(0)), "dialogue_count": F.coalesce("dialogue_count", F.lit(0)), "co_characters": F.coalesce("co_characters", F.array().cast("array<string>"))})


def rolled_up(found: DataFrame, aliases: DataFrame) -> DataFrame:
    """Signals summed over a name and its aliases (``canonical, alias``); co-occurring names become canonical, the own name goes."""
    a = aliases.select("canonical", "alias")
    rows = found.join(a, F.col("name") == F.col("alias"), "left").withColumn("to", F.coalesce("canonical", "name")).drop("canonical", "alias")
    sums = rows.groupBy("book_id", "to").agg(F.sum("mention_count").alias("mention_count"), F.sum("dialogue_count").alias("dialogue_count"))
    co = rows.select("book_id", "to", F.explode("co_characters").alias("o")).join(a, F.col("o") == F.col("alias"), "left").select("book_id", "to", F.coalesce("canonical", "o").alias("o")).filter("o <> to")
    names = co.groupBy("book_id", "to").agg(F.array_sort(F.collect_set("o")).alias("co_characters"))
    return sums.join(names, ["book_id", "to"], "left").withColumn("co_characters", F.coalesce("co_characters", F.array().cast("array<string>"))).withColumnRenamed("to", "name")


def signal_confidence(mentions: Column, dialogues: Column, co: Column, described: Column, aliased: Column) -> Column:
    base = F.round(0.3 * F.least(mentions / 50, F.lit(1.0)) + 0.4 * F.least(dialogues / 30, F.lit(1.0)) + 0.3 * F.least(co / 20, F.lit(1.0)), 2)
    return F.least(F.lit(1.0), base + F.when(described, 0.05).otherwise(0.0) + F.when(aliased, 0.03).otherwise(0.0))
