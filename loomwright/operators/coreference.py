"""Coreference: pronouns, descriptors, honorifics, alias patterns, and the nearest antecedent as an as-of window."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from .offsets import Pattern
from .scanners import CJK, likely_name, regex_scan

# Words and patterns.
PRONOUNS_ZH = {"male": ("他们的", "他们", "他的", "他"), "female": ("她们", "她的", "她"), "neutral": ("它们的", "它们", "它的", "它")}
PRONOUNS_EN = {"male": ("he", "his", "him"), "female": ("she", "hers", "her"), "neutral": ("it", "its")}
HONORIFICS_ZH = (
    "先生", "女士", "小姐", "太太", "夫人", "老爷", "少爷", "姑娘", "大人", "公子", "公主", "王", "皇", "帝", "后", "妃", "臣",
    "将军", "元帅", "奶奶", "相公", "娘子", "夫君", "妻子", "道长", "大师", "仙人", "神", "佛",
)
HONORIFICS_EN = ("mr", "mrs", "miss", "ms", "sir", "madam", "lady", "lord", "princess", "prince", "king", "queen", "duke", "duchess", "doctor", "professor", "captain", "major", "colonel", "general")
#: The descriptor is the first group, or all that matches where there is none.
DESCRIPTORS = (
    "那个(.?)人", "这位(.?)人", "此人", "老者", "年轻人", "少年", "少女", "中年人", "老(.{0,3})", "年轻的(.{0,3})", "小小的(.{0,3})",
    "(?i)the (old|young|little|oldest|youngest) (man|woman|person|boy|girl|child)", "(?i)the (tall|short|big|little|young|old) (one|man|woman|guy|person)", "(?i)a (certain|some) (man|woman|person|boy|girl)",
)
#: Name and alias are the first two groups; a pattern with one group tells an alias of nobody in particular.
ALIASES = (
    '"([^"]+)"常被称为(.+)', '(.+)，又名"([^"]+)"', '(.+)，人称"([^"]+)"', '(.+)，绰号"([^"]+)"', "称(.+)为(.+)", "(.+)之(.+)",
    r'(?i)(\w+),?\s+known\s+as\s+"(\w+)"', r'(?i)(\w+)\s+nicknamed\s+"(\w+)"', r'(?i)(\w+)\s+also\s+calls?\s+(?:himself|herself|themselves)\s+"(\w+)"', r'(?i)(\w+)\s+(?:or|aka|also\s+known\s+as)\s+"(\w+)"', r"(?i)(\w+)\s+for\s+(?:short|shortened)",
)
#: Where a match of a pattern that begins with ``.+`` or ``\\w+`` can begin: if it fails at the first character of a line or word, it fails at all.
_LINE, _WORD = r"(?:\G|(?<=[\n\r\x{85}\x{2028}\x{2029}]))", r"(?i)(?<![0-9A-Za-z_])"
#: ``ALIASES`` in their order, with the same groups, as patterns that read a text once: what every match holds (in lower case), and the pattern.
_ALIASES_ONCE = (
    ('"常被称为', '"([^"]++)"常被称为(.+)'), ('，又名"', _LINE + '(.+)，又名"([^"]++)"'), ('，人称"', _LINE + '(.+)，人称"([^"]++)"'), ('，绰号"', _LINE + '(.+)，绰号"([^"]++)"'),
    ("称", _LINE + r"[^称\n\r\x{85}\x{2028}\x{2029}]*+称(.+)为(.+)"), ("之", _LINE + "(.+)之(.+)"),
    ("known", _WORD + r'(\w++),?\s++known\s++as\s++"(\w++)"'), ("nicknamed", _WORD + r'(\w++)\s++nicknamed\s++"(\w++)"'), ("call", _WORD + r'(\w++)\s++also\s++calls?\s++(?:himself|herself|themselves)\s++"(\w++)"'),
    ('"', _WORD + r'(\w++)\s++(?:or|aka|also\s++known\s++as)\s++"(\w++)"'), ("short", r"(?i)(?:\G|(?<![0-9A-Za-z_]))(\w++)\s++for\s++(?:short|shortened)"),
)
#: Factors by distance from an antecedent: the first bound exceeded counts.
DECAY = ((500, 0.5), (200, 0.7), (100, 0.85), (50, 0.95))


def _either(words) -> str:
    return "|".join(map(re.escape, words))


def pronouns(chapters: DataFrame) -> DataFrame:
    """Pronouns with their gender as ``kind``; English ones stand alone between ASCII word characters."""
    zh = [Pattern(f"(?:^|(?<=[，。！？；：、\"“”‘’\\s]))({_either(w)})", 1, 1.0, g) for g, w in PRONOUNS_ZH.items()]
    en = [Pattern(f"(?i)(?<![0-9A-Za-z_])({_either(w)})(?![0-9A-Za-z_])", 1, 1.0, g) for g, w in PRONOUNS_EN.items()]
    return regex_scan(chapters, zh + en)


def names_found(chapters: DataFrame, names: list[str]) -> DataFrame:
    """Every place of each name (any case)."""
    return regex_scan(chapters, [Pattern(f"(?i)({re.escape(n)})", 1, 1.0, n) for n in names])


def decay(distance: Column) -> Column:
    out = F.lit(1.0)
    for bound, factor in reversed(DECAY):
        out = F.when(distance > bound, factor).otherwise(out)
    return out


def antecedents(found: DataFrame, named: DataFrame, order: list[str]) -> DataFrame:
    """For each pronoun the best of the names' last places before it: nearer is surer, the earlier name of ``order`` among equals.

    A forward-filling window carries the last place of each name, so a chapter is walked once and no pair is formed.
    """
    place = F.create_map(*[x for i, n in enumerate(order) for x in (F.lit(n), F.lit(i))])
    both = found.select("book_id", "chapter_index", "position", F.lit(1).alias("mark"), F.col("text").alias("pronoun"), F.col("kind").alias("gender"), F.lit(None).cast("int").alias("who")).unionByName(
        named.select("book_id", "chapter_index", "position", F.lit(0).alias("mark"), F.lit(None).cast("string").alias("pronoun"), F.lit(None).cast("string").alias("gender"), F.element_at(place, F.col("kind")).alias("who"))
    )
    w = Window.partitionBy("book_id", "chapter_index").orderBy("position", "mark").rowsBetween(Window.unboundedPreceding, 0)
    last = F.array(*[F.struct(F.last(F.when(F.col("who") == i, F.col("position")), ignorenulls=True).over(w).alias("at"), F.lit(-i).alias("o"), F.lit(n).alias("name")) for i, n in enumerate(order)])
    rows = both.withColumn("last", last).filter("mark = 1")
    scored = F.transform(F.filter("last", lambda x: x["at"].isNotNull()), lambda x: F.struct(decay(F.col("position") - x["at"]).alias("confidence"), x["o"].alias("o"), x["name"].alias("name")))
    best = F.array_max(scored)
    return rows.select("book_id", "chapter_index", "position", "pronoun", "gender", best["name"].alias("name"), F.coalesce(best["confidence"], F.lit(0.0)).alias("confidence"))


def descriptors(chapters: DataFrame) -> DataFrame:
    return regex_scan(chapters, [Pattern(p, min(1, re.compile(p).groups), 1.0, "descriptor") for p in DESCRIPTORS])


def descriptor_match(descriptor: Column, names: list[str]) -> Column:
    """``struct<confidence, name>`` of the first name that holds or is held by a descriptor (.9), or shares a word with it (.6)."""
    d = F.lower(descriptor)
    out = F.lit(None).cast("struct<confidence: double, name: string>")
    for n in reversed(names):
        low = n.lower()
        part = F.lit(False)
        for w in low.split():
            if len(w) > 1:
                part = part | F.contains(d, F.lit(w))
        whole = F.contains(d, F.lit(low)) | F.contains(F.lit(low), d)
        out = F.when(whole, F.struct(F.lit(0.9).alias("confidence"), F.lit(n).alias("name"))).when(part, F.struct(F.lit(0.6).alias("confidence"), F.lit(n).alias("name"))).otherwise(out)
    return out


def honorifics(chapters: DataFrame) -> DataFrame:
    """Names behind a form of address (``kind``)."""
    zh = [Pattern(f"{h}\\s*([^\\s，。！？、；：\"'【】（）]{{1,4}})", 1, 1.0, h) for h in HONORIFICS_ZH]
    en = [Pattern(f"(?<![0-9A-Za-z_])(?i:{h})\\.?\\s+([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)?)", 1, 1.0, h) for h in HONORIFICS_EN]
    return regex_scan(chapters, zh + en)


def surname_names(chapters: DataFrame) -> DataFrame:
    """Surname and one or two characters; .9 for compound surnames, .7 for others."""
    compound = f"(?:{_either(lex.COMPOUND_SURNAMES)})"
    return regex_scan(chapters, [Pattern(f"({compound}[{CJK}]{{1,2}})", 1, 0.9, "compound"), Pattern(f"([{lex.SURNAMES}][{CJK}]{{1,2}})", 1, 0.7, "single")]).filter(likely_name(F.col("text")))


def _told(found: Column, pattern: str, two: bool) -> Column:
    """``(name, alias)`` of each match."""
    group = lambda x, k: F.trim(F.regexp_extract(x, pattern, k))
    return F.transform(found, lambda x: F.struct((group(x, 1) if two else F.lit("")).alias("name"), group(x, 2 if two else 1).alias("alias")))


def alias_pairs(chapters: DataFrame) -> DataFrame:
    """``book_id, chapter_index, name, alias`` told by phrases like *known as*.

    Each pattern reads a text once, and only a text that holds its words; groups come from the match alone.
    """
    pairs = []
    for (words, p), rule in zip(_ALIASES_ONCE, ALIASES, strict=True):
        found = F.when(F.contains("_low", F.lit(words)), F.regexp_extract_all("_t", F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>"))
        pairs.append(_told(found, p, re.compile(rule).groups > 1))
    text = F.coalesce("content", F.lit(""))
    rows = chapters.select("book_id", "chapter_index", text.alias("_t"), F.lower(text).alias("_low"))
    return rows.select("book_id", "chapter_index", F.explode(F.concat(*pairs)).alias("p")).select("book_id", "chapter_index", "p.name", "p.alias").distinct()


def extended(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Characters with the aliases that the text tells of their name."""
    more = pairs.groupBy("book_id", "name").agg(F.array_sort(F.collect_set("alias")).alias("_more"))
    empty = F.array().cast("array<string>")
    return rows.join(more, ["book_id", "name"], "left").withColumn("aliases", F.array_distinct(F.concat(F.coalesce("aliases", empty), F.coalesce("_more", empty)))).drop("_more")


def with_potentials(known: DataFrame, potential: DataFrame, least: float = 0.6) -> DataFrame:
    """``book_id, name``: the known names, and potential ones of enough ``confidence`` that are no known name's form of address."""
    from .resolution import address_free_column

    form = lambda d: d.withColumn("_f", address_free_column(F.col("name")))
    new = form(potential.filter(F.col("confidence") >= least).select("book_id", "name").distinct())
    return known.select("book_id", "name").distinct().unionByName(new.join(form(known).select("book_id", "_f").distinct(), ["book_id", "_f"], "left_anti").drop("_f"))
