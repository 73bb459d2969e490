"""Entity scanners: patterns over chapters give mention rows.

``regex_scan`` takes the matches' offsets from ``offsets``, so patterns run in the JVM like everything behind them (name
predicates, context tests, counts, suppression). Literal names, however many, are found by one automaton (``automaton``).

Chapters: ``book_id, chapter_index, content`` (and ``title``). Mentions: ``book_id, type, text, chapter_index, position``
(code points from 0) ``, source, confidence, seq``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions.text import trimmed
from . import automaton
from .events import CJK, EventRules, scan_events  # noqa: F401  events are scanned beside the other kinds
from .offsets import Pattern, matches

PRECEDING = "，。！？；：、\"\\s"


def _or(words) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: -len(w)))


def regex_scan(chapters: DataFrame, patterns: list[Pattern], text_col: str = "content", reach: int = 0) -> DataFrame:
    """A row for each match of each pattern, patterns in order within a chapter (``seq``).

    With ``reach`` also the ``before`` and ``after`` of a match, so many characters of the text around it.
    """
    rows = chapters.select(F.col("book_id").cast("string").alias("book_id"), F.col("chapter_index").cast("int").alias("chapter_index"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    found = rows.select("book_id", "chapter_index", F.posexplode(F.flatten(F.array(*[matches(F.col("_t"), p, reach) for p in patterns]))).alias("_n", "m"))
    seq = F.coalesce(F.col("chapter_index"), F.lit(0)).cast("long") * 1_000_000 + F.col("_n")
    return found.select("book_id", "chapter_index", "m.text", "m.position", "m.confidence", "m.kind", seq.alias("seq"), *(["m.before", "m.after"] if reach else []))


def _mentions(found: DataFrame, kind: str, keep: Column) -> DataFrame:
    """Trimmed matches that pass ``keep``, once for each place."""
    rows = found.withColumn("text", trimmed(F.col("text"))).filter(keep)
    first = Window.partitionBy("book_id", "chapter_index", "text", "position").orderBy("seq")
    rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "kind")
    return rows.withColumns({"type": F.lit(kind), "source": F.lit("regex")})


# -- predicates -----------------------------------------------------------------


def has_surname(text: Column, single: str = lex.SURNAMES, compound=lex.COMPOUND_SURNAMES) -> Column:
    return text.rlike(f"^(?:{_or(compound)}|[{single}])")


def likely_name(text: Column, stop=lex.NAME_STOP_WORDS, bad: str = lex.BAD_NAME_CHARS, orgs: str = lex.ORG_SUFFIXES) -> Column:
    """2 to 4 CJK characters, no stop word, no organisation, no character that names don't have."""
    return text.rlike(f"^[{CJK}]{{2,4}}$") & ~text.isin(*stop) & ~text.rlike(f"[{orgs}]$") & ~text.rlike(f"[{bad}]")


def likely_frequent_name(text: Column, **lists) -> Column:
    return likely_name(text, **lists) & has_surname(text)


def likely_location(text: Column, stop=lex.LOCATION_STOP_WORDS, bad: str = lex.BAD_LOCATION_CHARS) -> Column:
    return F.length(text).between(2, 4) & ~text.isin(*stop) & ~text.rlike(f"[{bad}]")


# -- scanners -------------------------------------------------------------------


def character_patterns() -> list[Pattern]:
    compound, verbs, titles = f"(?:{_or(lex.COMPOUND_SURNAMES)})", _or(lex.DIALOGUE_VERBS), _or(lex.TITLES)
    return [
        Pattern(f"({compound}[{CJK}])", 1, 0.9, "compound"),
        Pattern(f"[{PRECEDING}]({compound}[{CJK}])(?:{verbs})", 1, 0.85, "dialogue"),
        Pattern(f"[{PRECEDING}]([{lex.SURNAMES}][{CJK}])(?:{verbs})", 1, 0.75, "dialogue"),
        Pattern(f"(?:{_or(lex.INTRODUCTIONS)})([{CJK}]{{2,4}})(?=[，。！？；：、\"\\s]|$)", 1, 0.85, "introduction"),
        Pattern(f"({compound}[{CJK}])(?:{titles})", 1, 0.75, "title"),
        Pattern(f"\"[^\"]{{1,100}}\"\\s*([{CJK}]{{2,3}})(?:说道|道|曰|言|怒道|笑道|喝道)", 1, 0.7, "attribution"),
    ]


def scan_characters(chapters: DataFrame, patterns: list[Pattern] | None = None) -> DataFrame:
    return _mentions(regex_scan(chapters, patterns or character_patterns()), "character", likely_frequent_name(F.col("text")))


def location_patterns(known=lex.KNOWN_LOCATIONS, suffixes: str = lex.LOCATION_SUFFIXES) -> list[Pattern]:
    return [
        Pattern(f"({_or(known)})", 1, 0.95, "known"),
        Pattern(f"[{PRECEDING}]([{CJK}]{{2}}[{suffixes}])", 1, 0.8, "suffix"),
        Pattern(f"(?:{_or(lex.DIRECTION_VERBS)})([{CJK}]{{2,4}}[{lex.DIRECTION_SUFFIXES}])", 1, 0.75, "direction"),
    ]


def scan_locations(chapters: DataFrame, patterns: list[Pattern] | None = None) -> DataFrame:
    return _mentions(regex_scan(chapters, patterns or location_patterns()), "location", likely_location(F.col("text")))


def item_patterns(suffixes: str = lex.ITEM_SUFFIXES, context=lex.ITEM_CONTEXT) -> list[Pattern]:
    return [Pattern(f"[{PRECEDING}]([{lex.ITEM_DESCRIPTORS}][{CJK}]{{1,3}}[{suffixes}])", 1, 0.8, "suffix"), Pattern(f"({_or(context)})", 1, 0.5, "context")]


def scan_items(chapters: DataFrame, patterns: list[Pattern] | None = None) -> DataFrame:
    return _mentions(regex_scan(chapters, patterns or item_patterns()), "item", F.length("text").between(2, 8))


# -- book-wide names ------------------------------------------------------------


def frequent_names(chapters: DataFrame, least: int = 5, limit: int = 160, patterns: list[Pattern] | None = None, keep: Column | None = None, context: Column | None = None) -> DataFrame:
    """Recurring names of each book that the strict patterns miss: ``book_id, text, n, chapter_index, position, all_chapters, confidence, rank``.

    Candidates are all places of surname-led runs of 4, 3 and 2 characters (overlaps included) with a telling
    neighbourhood; shorter and longer variants suppress each other; ``limit`` names a book are the report.
    """
    patterns = patterns or [Pattern(f"((?:{_or(lex.COMPOUND_SURNAMES)}|[{lex.SURNAMES}])[{CJK}]{{0,3}})", 1, 0.0, ahead=5)]
    heads = regex_scan(chapters, patterns, reach=6)
    sized = heads.withColumn("len", F.explode(F.array(F.lit(4), F.lit(3), F.lit(2)))).filter(F.length("text") >= F.col("len"))
    # What stands behind a shorter name starts with the rest of the longer match.
    n = F.col("len")
    near = sized.withColumns({"after": F.concat(F.col("text").substr(n + 1, F.length("text")), "after"), "text": F.substring("text", F.lit(1), n)})
    near = near.filter(likely_frequent_name(F.col("text")) if keep is None else keep)
    beside = F.concat(F.right("before", F.lit(2)), F.left("after", F.lit(2)))
    telling = beside.rlike(f"[{lex.CONTEXT_CHARS}]") | F.concat("before", "text", F.left("after", F.lit(6))).rlike(_or(lex.DIALOGUE_VERBS + lex.TITLES))
    near = near.filter((telling if context is None else context) & ~F.left("after", F.lit(1)).rlike(f"[{lex.ORG_SUFFIXES}]"))
    place = F.struct("chapter_index", "position", (-F.col("len")).alias("l"))
    names = near.groupBy("book_id", "text").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.array_sort(F.collect_set("chapter_index")).alias("all_chapters")).filter(F.col("n") >= least)
    return ranked_names(suppressed(names), limit)


def suppressed(names: DataFrame) -> DataFrame:
    """Drops names that are parts or extensions of others (``book_id, text, n, first``), as an ordered walk would.

    For each name the longer names that contain it are walked by count, length and first place; a walk ends at the first
    that takes the name's place, and a name of three characters or more strikes longer ones before that.
    Containment is an equi-join on the pieces of the longer name.
    """
    w = Window.partitionBy("book_id").orderBy(F.desc("n"), F.desc(F.length("text")), "first")
    ranked = names.withColumn("rank", F.row_number().over(w))
    size = F.length("text")
    longer = ranked.filter(size > 2).select("book_id", F.col("text").alias("other"), F.col("n").alias("other_n"), F.col("rank").alias("other_rank"), F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.substring("text", i, k)))))).alias("text"))
    pairs = ranked.select("book_id", "text", "n").join(longer, ["book_id", "text"])
    a, b = F.length("text"), F.length("other")
    prefix = (a == 2) & (b == 3) & F.col("other").startswith(F.col("text")) & (F.col("other_n") >= 0.8 * F.col("n"))
    strikes = ~prefix & (a >= 3) & (F.col("n") >= 0.8 * F.col("other_n"))
    yields = prefix | (~strikes & (F.col("other_n") > 1.2 * F.col("n")))
    pairs = pairs.withColumns({"strikes": strikes, "stop": F.when(yields, F.col("other_rank"))})
    ends = pairs.groupBy("book_id", "text").agg(F.min("stop").alias("end"))
    gone = ends.filter("end is not null").select("book_id", "text")
    struck = pairs.join(ends, ["book_id", "text"]).filter(F.col("strikes") & (F.col("end").isNull() | (F.col("other_rank") < F.col("end")))).select("book_id", F.col("other").alias("text"))
    return names.join(gone.union(struck).distinct(), ["book_id", "text"], "left_anti")


def ranked_names(names: DataFrame, limit: int = 160) -> DataFrame:
    w = Window.partitionBy("book_id").orderBy(F.desc("n"), F.desc(F.length("text")), "first")
    chapters = F.size("all_chapters")
    confidence = F.least(F.lit(0.95), F.lit(0.62) + F.least(F.lit(0.15), F.col("n") / 80) + F.least(F.lit(0.18), chapters / 40))
    out = names.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return out.select("book_id", "text", "n", F.col("first.chapter_index").alias("chapter_index"), F.col("first.position").alias("position"), "all_chapters", confidence.alias("confidence"), "rank")


def exact_mentions(chapters: DataFrame, names: DataFrame, most: int = automaton.MOST_CHARACTERS) -> DataFrame:
    """Literal, non-overlapping counts of ``names`` (``name``): ``book_id, text, n, chapter_index, position, all_chapters, confidence``.

    Names of up to ``most`` characters in all go into one automaton, which reads each chapter once. More of them meet the
    chapters in an equi-join on their first two characters, of which a chapter has each pair once.
    """
    names = names.filter(F.length("name") > 0).distinct()
    rows = chapters.select("book_id", "chapter_index", "content")
    if automaton.fits(names, most):
        listed = [r["name"] for r in names.orderBy("name").collect()]
        hit = automaton.with_hits(rows, listed, "content", "_h").select("book_id", "chapter_index", F.explode("_h").alias("h"))
        hit = hit.select("book_id", "chapter_index", F.col("h.name").alias("text"), F.col("h.n").alias("c"), F.col("h.first").alias("position"))
    else:
        pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("content")), lambda i: F.substring("content", i, 2)))
        keyed = rows.filter(F.length("content") > 0).withColumn("key", F.explode(F.array_distinct(F.concat(pairs, F.transform(pairs, lambda p: F.left(p, F.lit(1)))))))
        hit = keyed.join(names.withColumn("key", F.left("name", F.lit(2))), "key").filter(F.contains("content", F.col("name")))
        count = ((F.length("content") - F.length(F.replace("content", F.col("name"), F.lit("")))) / F.length("name")).cast("long")
        hit = hit.select("book_id", "chapter_index", F.col("name").alias("text"), count.alias("c"), (F.instr("content", F.col("name")) - 1).alias("position"))
    out = hit.groupBy("book_id", "text").agg(F.sum("c").alias("n"), F.min(F.struct("chapter_index", "position")).alias("f"), F.array_sort(F.collect_set("chapter_index")).alias("all_chapters"))
    return out.select("book_id", "text", "n", F.col("f.chapter_index").alias("chapter_index"), F.col("f.position").alias("position"), "all_chapters", F.least(F.lit(0.95), F.lit(0.7) + F.least(F.lit(0.25), F.col("n") / 80)).alias("confidence"))


def roll_up_aliases(found: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds aliases' counts and chapters to their primary (``primary, alias``) where both occur in a book; the alias goes."""
    names = found.select("book_id", F.col("text").alias("primary")).distinct()
    valid = found.join(aliases, F.col("text") == F.col("alias")).join(names, ["book_id", "primary"], "left_semi").select("book_id", "alias", "primary")
    rows = found.join(valid, (found["book_id"] == valid["book_id"]) & (F.col("text") == F.col("alias")), "left").select(found["*"], "alias", F.coalesce("primary", "text").alias("to"))
    own = F.col("alias").isNull()
    out = rows.groupBy("book_id", "to").agg(
        F.sum("n").alias("n"),
        F.max("confidence").alias("confidence"),
        F.max(F.when(own, F.col("chapter_index"))).alias("chapter_index"),
        F.max(F.when(own, F.col("position"))).alias("position"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("all_chapters")))).alias("all_chapters"),
        F.array_sort(F.collect_set("alias")).alias("aliases"),
        F.array_sort(F.collect_list(F.when(~own, F.struct("alias", F.col("all_chapters").alias("chapter_indices"), F.col("n").alias("count"))))).alias("alias_index"),
    )
    return out.withColumnRenamed("to", "text")


def canonical(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions of an alias become mentions of its primary, the alias noted."""
    a = aliases.select(F.col("alias").alias("_a"), F.col("primary").alias("_p"))
    rows = mentions.join(a, F.col("text") == F.col("_a"), "left")
    old = F.coalesce(F.col("aliases"), F.array().cast("array<string>")) if "aliases" in mentions.columns else F.array().cast("array<string>")
    return rows.withColumn("aliases", F.when(F.col("_a").isNotNull(), F.array_distinct(F.concat(old, F.array("_a")))).otherwise(old)).withColumn("text", F.coalesce("_p", "text")).drop("_a", "_p")


def completed(mentions: DataFrame, chapters: DataFrame, answers: DataFrame, batch: int = 10) -> DataFrame:
    """Adds rows of a model's answers (``book_id, batch, type, text, confidence``): texts the patterns have not found in the batch, placed in its first chapter, once each."""
    number = F.floor(F.col("chapter_index") / batch).cast("int").alias("batch")
    known = mentions.select("book_id", number, "type", "text").distinct()
    first = chapters.select(F.col("book_id").cast("string"), number, "chapter_index").groupBy("book_id", "batch").agg(F.min("chapter_index").alias("chapter_index"))
    fresh = answers.join(known, ["book_id", "batch", "type", "text"], "left_anti").join(first, ["book_id", "batch"])
    one = fresh.groupBy("book_id", "type", "text").agg(F.min("chapter_index").alias("chapter_index"), F.max("confidence").alias("confidence"))
    made = one.select("book_id", "chapter_index", "text", F.lit(-1).alias("position"), "confidence", F.lit(None).cast("long").alias("seq"), "type", F.lit("llm").alias("source"))
    return mentions.unionByName(made, allowMissingColumns=True)
