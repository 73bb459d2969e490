"""Places of a pattern's matches, from built-in functions alone.

Spark's functions give the matches of a pattern and the pieces between them, but no offsets. A match begins where the pieces
and matches before it end, so offsets are running sums of lengths. Sums run over blocks of about the root of their number, so
that a text with many matches takes no quadratic time. Offsets are code points.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, word characters and case as in Unicode, ``.`` and ``$`` with line feeds alone.
FLAGS = "(?Ud)"


@dataclass(frozen=True)
class Pattern:
    """A pattern, the group that is told, and what a match is worth. With ``ahead`` it may match at every place, overlaps included, that many characters at most."""

    regex: str
    group: int
    confidence: float
    kind: str = ""
    ahead: int = 0


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column) -> Column:
    """Sums of the numbers before each place, and that of all: one more than there are values."""
    zero = F.lit(0).cast("long")
    total = lambda part: F.aggregate(part, zero, lambda a, x: a + x)

    def sums(v: Column) -> Column:
        n = F.size(v)

        def by_blocks(width: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor(n / width).cast("int")), lambda b: total(F.slice(v, b * width + 1, width)))
            starts = F.aggregate(blocks, F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
            return let(starts, lambda s: F.transform(F.sequence(F.lit(0), n), lambda i: F.get(s, F.floor(i / width).cast("int")) + total(F.slice(v, F.floor(i / width).cast("int") * width + 1, i % width))))

        return let(F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1)), by_blocks)

    return let(values, sums)


def _group_start(regex: str, group: int) -> int:
    """Where the pattern's capturing group opens; it must not stand inside another group."""
    depth = seen = k = 0
    in_class = False
    while k < len(regex):
        c = regex[k]
        if c == "\\":
            k += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            if regex[k + 1 : k + 2] == "]" or regex[k + 1 : k + 3] == "^]":
                k += regex[k + 1 : k + 3].index("]") + 1
        elif c == "(":
            if regex[k + 1 : k + 2] != "?":
                seen += 1
                if seen == group:
                    if depth:
                        raise ValueError(f"group {group} of {regex} stands inside another")
                    return k
            depth += 1
        elif c == ")":
            depth -= 1
        k += 1
    raise ValueError(f"{regex} has no group {group}")


def with_lead(regex: str, group: int) -> tuple[str, int, int]:
    """The pattern with what stands before the group as a group of its own: pattern, that group, the group told."""
    flags = re.match(r"(?:\(\?[a-zA-Z]+\))*", regex)[0]
    at = _group_start(regex, group) if group else len(flags)
    if at == len(flags):
        return FLAGS + regex, 0, group
    return f"{FLAGS}{flags}({regex[len(flags) : at]}){regex[at:]}", 1, group + 1


_HIT = "array<struct<text: string, position: int, confidence: double, kind: string, before: string, after: string>>"


def _hit(text: Column, at: Column, p: Pattern, before: Column, after: Column) -> Column:
    return F.struct(text.alias("text"), at.cast("int").alias("position"), F.lit(float(p.confidence)).alias("confidence"), F.lit(p.kind).alias("kind"), before.alias("before"), after.alias("after"))


def matches(content: Column, p: Pattern, reach: int = 0) -> Column:
    """An array of a pattern's matches: text and position of its group, and ``reach`` characters around those of patterns that look ahead."""
    none = F.lit(None).cast("string")
    if p.ahead:
        regex, longest = FLAGS + p.regex, p.ahead

        def at_every_place(pieces: Column) -> Column:
            """Pieces begin where the pattern may match; what it sees goes on in the pieces behind."""
            lengths = running(F.transform(pieces, lambda x: F.length(x).cast("long")))

            def each(i: Column, starts: Column) -> Column:
                seen = F.array_join(F.slice(pieces, i + 1, longest + reach), "")
                text = F.regexp_extract(F.left(seen, F.lit(longest)), f"{FLAGS}^(?:{p.regex})", p.group)
                before = F.right(F.array_join(F.slice(pieces, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach))), ""), F.lit(reach)) if reach else none
                return _hit(text, F.get(starts, i), p, before, F.substring(seen, F.length(text) + 1, F.lit(reach)) if reach else none)

            return let(lengths, lambda s: F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: each(i, s)))

        found = let(F.split(content, f"{FLAGS}(?={p.regex})", -1), at_every_place)
    else:
        regex, lead, group = with_lead(p.regex, p.group)
        every = lambda k: F.regexp_extract_all(content, F.lit(regex), F.lit(k))

        def placed(whole: Column, pieces: Column) -> Column:
            starts = running(F.zip_with(pieces, whole, lambda a, b: (F.length(a) + F.coalesce(F.length(b), F.lit(0))).cast("long")))

            def each(texts: Column, leads: Column, at: Column) -> Column:
                start = lambda i: F.get(at, i) + F.length(F.get(pieces, i)) + (F.length(F.get(leads, i)) if lead else 0)
                return F.transform(texts, lambda t, i: _hit(t, start(i), p, none, none))

            return let(starts, lambda at: let(every(group), lambda texts: let(every(lead), lambda leads: each(texts, leads, at)) if lead else each(texts, texts, at)))

        found = let(every(0), lambda whole: let(F.split(content, regex, -1), lambda pieces: placed(whole, pieces)))
    found = F.filter(found, lambda x: F.length(x["text"]) > 0).cast(_HIT)
    return F.when(content.rlike(regex), found).otherwise(F.array().cast(_HIT))
