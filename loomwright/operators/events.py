"""Events of chapters: what a sentence or a whole chapter tells, as expressions over rules.

A chapter's sentences are an array with their places (``offsets``). Each sentence gives at most one summary, from its first
trigger or else from the first narrative rule that tells something; a chapter's own rules come before its sentences. All rules
are columns made from ``EventRules``, so a chapter never leaves its row, and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions.text import trimmed
from .offsets import FLAGS, Pattern, let, matches

CJK = "一-鿿"


@dataclass(frozen=True)
class EventRules:
    """What tells events; the defaults are the fixed values of ``functions.lexicons``."""

    triggers: tuple[str, ...] = lex.EVENT_TRIGGERS
    hints: tuple[str, ...] = lex.EVENT_HINTS
    subjects: tuple[str, ...] = lex.EVENT_SUBJECTS
    narrative: tuple = lex.NARRATIVE_EVENTS
    chapters: tuple = lex.CHAPTER_EVENTS
    #: What a trigger asks of its object: a known name, or a name or thing that a pattern allows; by default any that is no low-value word.
    named: tuple[str, ...] = ("审问", "对峙", "交手", "背叛", "袭击", "追杀", "击杀", "逮捕")
    allowed: tuple[tuple[str, str], ...] = (("调查", lex.EVENT_INVESTIGATED), ("破获", lex.EVENT_CASES), ("查明", lex.EVENT_CASES), ("揭开", lex.EVENT_CASES), ("解开", lex.EVENT_CASES))
    bare: tuple[str, ...] = ("牺牲", "失踪")
    sending: tuple[str, ...] = ("派遣", "派出")


SENTENCE = "[^。！？!?；;\n]{4,120}[。！？!?；;]?"
LEAST, MOST = 4, 24
TRIGGERED = 0.85
_EVENT = "struct<text: string, position: int, confidence: double>"


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(FLAGS + pattern)


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, FLAGS + pattern, "")


def _before(text: Column, pattern: str) -> Column:
    """What stands before the first match, or all."""
    return F.split(text, FLAGS + f"(?:{pattern})", 2)[0]


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _subjects(text: Column, rules: EventRules) -> Column:
    """Known subjects in a text as ``(place, number, name)``."""
    told = F.array(*[F.struct(F.instr(text, F.lit(n)).alias("at"), F.lit(k).alias("k"), F.lit(n).alias("name")) for k, n in enumerate(rules.subjects)])
    return F.filter(told, lambda x: x["at"] > 0)


def summary(text: Column) -> Column:
    """A summary without marks and blanks, of bounded length; null if it is too short."""
    bare = _without(_without(_without(text, lex.EVENT_PUNCTUATION), r"\s+"), "(?:调查|查案|办案|追查)?案情$")
    return let(F.left(bare, F.lit(MOST)), lambda t: F.when(F.length(t) >= LEAST, t))


def _object(text: Column, longest: int) -> Column:
    """What a text begins with, up to an end mark, without particles."""
    begun = _without(_before(text, lex.EVENT_OBJECT_END), "^[了着将把被于在往去至到一批]+")
    return F.left(trimmed(_without(begun, lex.EVENT_PUNCTUATION)), F.lit(longest))


def person(text: Column) -> Column:
    """A name of 2 to 4 characters with a family name, without a form of address; null for words that are none."""
    family = f"(?:{'|'.join(lex.EVENT_COMPOUND)}|[{lex.EVENT_SURNAMES}])"

    def checked(bare: Column) -> Column:
        odd = bare.isin(*sorted(lex.EVENT_NO_SUBJECTS)) | text.isin(*sorted(lex.EVENT_NO_SUBJECTS)) | _has(bare, f"[{lex.EVENT_BAD_CHARS}]")
        return F.when(F.length(bare).between(2, 4) & ~odd & _has(bare, f"^{family}"), bare)

    free = let(_without(text, lex.EVENT_ADDRESS), lambda t: F.when(F.length(t) > 4, _without(F.left(t, F.lit(4)), lex.EVENT_ADDRESS)).otherwise(t))
    return let(free, checked)


def subject_of(text: Column) -> Column:
    """The last stretch of a text that begins with a person, else the last name-like run in it."""
    stretch = lambda p: _without(_without(_before(p, lex.EVENT_SUBJECT_END), lex.EVENT_LEADS), f"[^{CJK}]")
    heads = F.filter(F.transform(F.split(text, FLAGS + f"(?:{lex.EVENT_PUNCTUATION}|\\s)"), lambda p: person(stretch(p))), lambda x: x.isNotNull())
    family = f"(?:{'|'.join(lex.EVENT_COMPOUND)}|[{lex.EVENT_SURNAMES}])"
    runs = F.filter(F.regexp_extract_all(text, F.lit(f"{FLAGS}{family}[{CJK}]{{1,3}}"), F.lit(0)), lambda m: ~_has(m, f"[{lex.EVENT_BAD_CHARS}]"))
    return F.coalesce(let(heads, lambda h: F.try_element_at(h, F.lit(-1))), let(runs, lambda r: person(F.left(F.try_element_at(r, F.lit(-1)), F.lit(4)))))


def triggered(sentence: Column, trigger: Column, rules: EventRules = EventRules()) -> Column:
    """What a sentence tells by its trigger: the last known subject before it, and an object as the trigger asks for."""
    at = F.instr(sentence, trigger)
    parts = F.struct(F.left(sentence, at - 1).alias("before"), F.substring(sentence, at + F.length(trigger), F.length(sentence)).alias("after"))

    def told(p: Column) -> Column:
        before, after = p["before"], p["after"]
        who, known = F.array_max(_subjects(before, rules))["name"], F.array_min(_subjects(after, rules))["name"]
        return let(F.struct(who.alias("who"), known.alias("known"), trimmed(after).alias("rest")), lambda x: forms(before, after, x["who"], x["known"], x["rest"]))

    def forms(before: Column, after: Column, who: Column, known: Column, rest: Column) -> Column:
        beheaded = _some(F.regexp_extract(sentence, f"{FLAGS}([{CJK}]{{2,4}})于.{{0,8}}斩首", 1))
        to = _some(F.regexp_extract(after, f"{FLAGS}(?:前往|赶往|抵达|进入)([{CJK}]{{2,12}})", 1))
        place = _without(_without(_object(to, 6), "^[了往至到]"), "调查.*$")
        sent = F.when(known != who, F.concat(who, trigger, known, F.coalesce(F.concat(F.lit("前往"), _some(place)), F.lit(""))))
        cause = F.regexp_extract(rest, f"{FLAGS}^原因是[^，。！？；：\\s]{{2,10}}", 0)
        thing = F.coalesce(known, _some(_without(_object(after, 10), "^[了着将把被]")))
        return (
            F.when(who.isNull(), None)
            .when(trigger == "下令", F.concat(who, F.lit("下令斩首"), beheaded))
            .when(trigger.isin(*rules.sending), sent)
            .when(F.contains(before, F.lit("：")) | _has(rest, "^(?:自己|自身)"), None)
            .when(trigger == "死亡", F.concat(who, trigger, cause))
            .when(trigger.isin(*rules.bare), F.concat(who, trigger))
            .otherwise(let(thing, lambda x: acted(who, x, known)))
        )

    def acted(who: Column, thing: Column, known: Column) -> Column:
        """The object must not be the subject or of low value, and what the trigger's rule allows."""
        poor = (thing == who) | _any([F.contains(thing, F.lit(w)) for w in lex.EVENT_LOW_VALUE])
        unnamed = trigger.isin(*rules.named) & known.isNull()
        barred = _any([(trigger == t) & ~_has(thing, p) & (F.lit(t != "调查") | known.isNull()) for t, p in rules.allowed])
        return F.when(~(poor | unnamed | barred), F.concat(who, trigger, thing))

    return summary(let(parts, told))


def narrated(sentence: Column, rules: EventRules = EventRules()) -> Column:
    """``(text, confidence)`` by the first narrative rule that tells something."""
    out = []
    for pattern, confidence, lines in rules.narrative:
        told = F.lit(None).cast("string")
        for needed, line in reversed(lines):
            text = summary(F.concat(subject_of(_before(sentence, pattern)), F.lit(line[1:]))) if line.startswith("*") else F.lit(line)
            told = F.when(reduce(lambda a, b: a & b, [_has(sentence, p) for p in needed]), text).otherwise(told)
        checked = let(F.when(_has(sentence, pattern), told), lambda t: F.when(F.length(t).between(LEAST, MOST), t))
        out.append(_worth(checked, confidence))
    return F.coalesce(*out)


def _worth(text: Column, confidence: float) -> Column:
    return let(text, lambda t: F.when(t.isNotNull(), F.struct(t.alias("text"), F.lit(confidence).alias("confidence"))))


def of_sentence(sentence: Column, rules: EventRules = EventRules()) -> Column:
    """``(text, confidence)``: a sentence with a trigger and a hint of a subject is told by the trigger alone, others by a narrative rule."""
    trigger = F.coalesce(*[F.when(F.contains(sentence, F.lit(t)), F.lit(t)) for t in rules.triggers], F.lit(None).cast("string"))
    hinted = _any([F.contains(sentence, F.lit(h)) for h in rules.hints])
    return let(trigger, lambda t: F.when(t.isNotNull() & hinted, _worth(triggered(sentence, t, rules), TRIGGERED)).otherwise(narrated(sentence, rules)))


def of_chapter(content: Column, title: Column, rules: EventRules = EventRules()) -> Column:
    """Events (``_EVENT``) that a whole chapter tells, each at the place of its anchor."""
    out = []
    for needed, told, anchor, confidence in rules.chapters:
        fires = reduce(lambda a, b: a & b, [_has(content, p) | (_has(title, t) if t else F.lit(False)) for p, t in needed])
        at = F.when(_has(content, anchor), F.length(_before(content, anchor))).otherwise(0)
        out.append(F.when(fires, F.struct(F.lit(told).alias("text"), at.cast("int").alias("position"), F.lit(confidence).alias("confidence")).cast(_EVENT)))
    return F.array_compact(F.array(*out)) if out else F.array().cast(f"array<{_EVENT}>")


def scan_events(chapters: DataFrame, rules: EventRules = EventRules(), cap: int = 8) -> DataFrame:
    """Event summaries of each chapter: those of the whole chapter first, then those of its sentences; each text once, and none after the first by which there are ``cap``."""
    title = F.coalesce(F.col("title").cast("string"), F.lit("")) if "title" in chapters.columns else F.lit("")
    rows = chapters.select(F.col("book_id").cast("string").alias("book_id"), F.col("chapter_index").cast("int").alias("chapter_index"), title.alias("_title"), F.coalesce("content", F.lit("")).alias("_text"))
    rows = rows.withColumn("_sentences", matches(F.col("_text"), Pattern(SENTENCE, 0, 0.0)))

    def event(s: Column) -> Column:
        bare = trimmed(F.rtrim(s["text"], F.lit("。！？!?；;")))
        told = let(bare, lambda b: F.when(F.length(b) > 0, of_sentence(b, rules)))
        return let(told, lambda t: F.when(t.isNotNull(), F.struct(t["text"].alias("text"), s["position"].alias("position"), t["confidence"].alias("confidence")).cast(_EVENT)))

    rows = rows.withColumns({"_own": of_chapter(F.col("_text"), F.col("_title"), rules), "_told": F.array_compact(F.transform("_sentences", event))}).drop("_text", "_title", "_sentences")
    every = F.concat("_own", "_told")
    once = let(every, lambda e: let(F.transform(e, lambda x: x["text"]), lambda t: F.filter(e, lambda x, i: F.array_position(t, x["text"]) == i + 1)))
    first = let(once, lambda e: F.slice(e, F.lit(1), F.greatest(F.lit(cap), F.size("_own"))))
    placed = F.transform(first, lambda x, i: F.struct(x["position"].alias("position"), i.alias("i"), x["text"].alias("text"), x["confidence"].alias("confidence")))
    out = rows.select("book_id", "chapter_index", F.posexplode(F.array_sort(placed)).alias("_n", "e"))
    seq = F.coalesce(F.col("chapter_index"), F.lit(0)).cast("long") * 1_000_000 + F.col("_n")
    return out.select("book_id", "chapter_index", "e.text", "e.position", "e.confidence", seq.alias("seq"), F.lit("event").alias("type"), F.lit("regex").alias("source"))
