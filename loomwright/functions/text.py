"""Text normalisation and splitting as column expressions (one row a text, nothing is shuffled)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that normalisation removes, turns into a space, or folds to their narrow form.
INVISIBLE = "​‌‍﻿­‎‏"
IRREGULAR_SPACES = "  ᠎    　"
WIDE = "".join(chr(c) for c in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), *range(0xFF10, 0xFF1A), 0xFF0E))
NARROW = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789."
#: What trimming removes at both ends.
TRIMMED = " \t\n\r\x0b\x0c" + IRREGULAR_SPACES + "﻿"
#: Any white space, as a character class.
WHITE = r"[\s\x{0B}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(TRIMMED))


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def visible(c: Column) -> Column:
    return F.regexp_replace(c, f"[{INVISIBLE}]", "")


def regular_spaces(c: Column) -> Column:
    return F.translate(c, IRREGULAR_SPACES, " " * len(IRREGULAR_SPACES))


def narrow(c: Column) -> Column:
    return F.translate(c, WIDE, NARROW)


def without_trailing_blanks(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)(?<![ \t])[ \t]++$", "")


def few_blank_lines(c: Column) -> Column:
    """Runs of three or more line feeds become two; those at either end go."""
    return F.btrim(F.regexp_replace(c, r"\n{3,}", "\n\n"), F.lit("\n"))


#: Any character that the first four steps of normalisation change.
_CHANGED = "[\\r\\x{AD}" + "".join(f"\\x{{{ord(x):X}}}" for x in INVISIBLE + IRREGULAR_SPACES) + "\\x{FF21}-\\x{FF3A}\\x{FF41}-\\x{FF5A}\\x{FF10}-\\x{FF19}\\x{FF0E}]"


def normalized(c: Column) -> Column:
    """The steps in order; texts that hold nothing for the first four to change are read once for all of them."""
    stepped = lambda x: narrow(regular_spaces(visible(unix_lines(x))))
    c = F.transform(F.array(c), lambda x: F.when(x.rlike(_CHANGED), stepped(x)).otherwise(x))[0]
    return few_blank_lines(without_trailing_blanks(c))


def normalization_report(c: Column) -> dict[str, Column]:
    """How much each step changes, counted on what the steps before it leave (code points)."""
    a = unix_lines(c)
    b = visible(a)
    d = regular_spaces(b)
    e = without_trailing_blanks(narrow(d))
    return {
        "crlf_fixed": F.length(c) - F.length(a),
        "invisible_removed": F.length(a) - F.length(b),
        "whitespace_fixed": F.regexp_count(b, F.lit(f"[{IRREGULAR_SPACES}]")),
        "fullwidth_fixed": F.regexp_count(d, F.lit("[Ａ-Ｚａ-ｚ０-９．]")),
        "blank_compressed": F.length(e) - F.length(F.regexp_replace(e, r"\n{3,}", "\n\n")),
    }


def word_count(c: Column) -> Column:
    """Characters that are no white space."""
    return F.length(F.regexp_replace(c, WHITE, ""))


def book_slug(c: Column) -> Column:
    """A name for folders: illegal characters go, white space becomes single hyphens."""
    legal = F.regexp_replace(c, r'[\\/:*?"<>|]', "")
    return F.btrim(F.regexp_replace(F.regexp_replace(legal, WHITE + "+", "-"), "-+", "-"), F.lit("-"))


def slug_part(c: Column) -> Column:
    """Lower-case ASCII words joined by hyphens, else the first 16 hex digits of the UTF-8 bytes."""
    ascii_ = F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(ascii_, F.lit("")), F.substring(F.lower(F.hex(F.encode(c, "utf-8"))), 1, 16))


# -- sentences and clauses ------------------------------------------------------

ENDS = "。！？!?"


def event_sentences(c: Column) -> Column:
    """Runs of 4 to 120 characters without an end mark or line feed."""
    return F.regexp_extract_all(c, F.lit("[^。！？!?；;\n]{4,120}"), F.lit(0))


def narrative_sentences(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[^。！？!?；;\n]{4,160}"), F.lit(0))


def relation_sentences(c: Column) -> Column:
    return F.filter(F.split(c, "[。！？；.!?;\n]+"), lambda s: F.length(trimmed(s)) > 0)


def description_sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, f"(?<=[{ENDS}])|\n+"), trimmed), lambda s: F.length(s) > 0)


def clauses(c: Column, marks: str = "，,；;、") -> Column:
    return F.filter(F.transform(F.split(c, f"(?<=[{marks}])"), lambda s: F.btrim(s, F.lit(TRIMMED + "“”\"'‘’"))), lambda s: F.length(s) > 0)


# -- descriptions ---------------------------------------------------------------


def _stable(c: Column, step: Callable[[str], str]) -> Column:
    """``step`` applied until the text stays as it is (descriptions are short; null stays null)."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            out = []
            for t in b.to_pylist():
                while t is not None and (new := step(t)) != t:
                    t = new
                out.append(t)
            yield pa.array(out, pa.string())

    return run(c)


_REPEATED = re.compile("([\u4e00-\u9fff]{2,4})\\1+")


def without_repeats(c: Column) -> Column:
    """A CJK phrase of 2 to 4 characters that follows itself stands once, until no phrase does."""
    return _stable(c, lambda t: _REPEATED.sub(r"\1", t))


# Words that leave a sentence hanging.
DANGLING = "被|把|将|以|为|与|和|及|并|但|却|因|在|从|向|对|由|让|令|使|其|该|这|那"
BROKEN_NUMERAL = "反将一|[将把给对向为以于至在从]一"
_MARKS = "，,；;、。！？!?"
_HANGING = re.compile(f"(?:^|[，,；;。！？!?])[^，,；;。！？!?]*?(?:{DANGLING}|{BROKEN_NUMERAL})[\\s{_MARKS}]*$")


def _without_hanging(t: str) -> str:
    return _HANGING.sub("", t).rstrip(_MARKS + " ") if _HANGING.search(t) else t


def cleaned_description(c: Column) -> Column:
    """White space compacted, all hanging fragments at the end dropped, repeated phrases once; null if nothing is left."""
    text = _stable(F.regexp_replace(trimmed(c), WHITE + "+", " "), _without_hanging)
    text = F.when(F.length(F.regexp_replace(text, f"[{_MARKS}\\s]", "")) > 0, text)
    return without_repeats(text)


def merged_descriptions(parts: Column) -> Column:
    """Joins descriptions in order; one that (but for punctuation) lies in another is left out, the longer one standing in its place."""
    bare = lambda s: F.regexp_replace(s, r"[\s，。；、,.;：:！!？?]+", "")

    def add(acc: Column, s: Column) -> Column:
        held = F.exists(acc, lambda a: F.contains(bare(a), bare(s)))
        replaced = F.transform(acc, lambda a: F.when(F.contains(bare(s), bare(a)), s).otherwise(a))
        swallows = F.exists(acc, lambda a: F.contains(bare(s), bare(a)))
        return F.when(held, acc).when(swallows, F.array_distinct(replaced)).otherwise(F.concat(acc, F.array(s)))

    clean = F.filter(F.transform(parts, lambda s: trimmed(F.coalesce(s, F.lit("")))), lambda s: F.length(s) > 0)
    return F.array_join(F.aggregate(clean, F.array().cast("array<string>"), add), "；")
