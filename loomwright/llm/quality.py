"""Quality rules as a short-circuit cascade.

The base measures of a text are made in one vectorised pass over its bytes. The further rules are ordered by what a random
sample of all texts, whatever their length, says of them: each rule's cost (seconds) and selectivity (share rejected) are
measured in the tasks that read it, and rules run by rejections per cost, a text leaving at the first rule that rejects it.
The order changes the work, not the verdict; ``rejected_by``, where several rules reject a text, follows the order.

Defined cases: null counts as empty; words are runs without space, tab, LF, VT, FF, CR; a text without words fails the
base. Lines are cut at LF alone and compared whole. Extra columns stay; repeated rows are judged alike.
"""

from __future__ import annotations

import re
import secrets
import time
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, unused, utf8, window_hashes, with_text_struct, word_hashes

SYMBOLS = "#*$%&|<>"
#: Texts, about, of the sample that orders the cascade (it decides the order only, never a verdict).
SAMPLE = 512
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of the words
LEAST_LINES = 5  # of texts whose lines are judged

Measures = dict[str, int]
Rule = tuple[str, Callable[[str, Measures], bool]]


def _most_symbols(text: str, m: Measures) -> bool:
    return 10 * m["n_symbols"] > 3 * m["n_words"]


def _odd_words(text: str, m: Measures) -> bool:
    return m["word_chars"] > 20 * m["n_words"] or 2 * m["word_chars"] < 3 * m["n_words"]


def _repeated_lines(text: str, m: Measures) -> bool:
    return 2 * m["n_dup_lines"] > text.count("\n") + 1


def _few_letters(text: str, m: Measures) -> bool:
    data = utf8(text)
    ascii_letters = len(data) - len(data.translate(None, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    beyond = len(data) - len(data.translate(None, bytes(range(128, 256))))
    return 2 * (ascii_letters + beyond) < len(data) - text.count(" ") - text.count("\n")


#: Bytes that are neither of a letter (or of what is beyond ASCII) nor white.
_NO_LETTER = bytes(b for b in range(128) if not chr(b).isalpha() and b != 32 and not 9 <= b <= 13)
_BULLET = re.compile(r"^[\x20\x09]*[-*•]", re.M)
_ELLIPSIS = re.compile(r"(?:\.\.\.|…)[\x20\x09\x0D]*$", re.M)


def _one_word(text: str, m: Measures) -> bool:
    return 100 * max(Counter(utf8(text).split()).values(), default=0) > 30 * m["n_words"]  # bytes are split at ASCII white space alone


def _words_without_letter(text: str, m: Measures) -> bool:
    return 2 * (m["n_words"] - len(utf8(text).translate(None, _NO_LETTER).split())) > m["n_words"]


def _bullets(text: str, m: Measures) -> bool:
    n = text.count("\n") + 1
    return n >= LEAST_LINES and 10 * len(_BULLET.findall(text)) > 9 * n


def _cut_off(text: str, m: Measures) -> bool:
    n = text.count("\n") + 1
    return n >= LEAST_LINES and 2 * len(_ELLIPSIS.findall(text)) > n


#: Each rejects a text; they hold only what no clean prose shows, in whatever language.
RULES: list[Rule] = [("most_symbols", _most_symbols), ("odd_words", _odd_words), ("repeated_lines", _repeated_lines), ("few_letters", _few_letters), ("one_word", _one_word), ("words_without_letter", _words_without_letter), ("bullets", _bullets), ("cut_off", _cut_off)]


def measure(text: str, key: int = 0) -> Measures:
    """The base measures of one text (``key`` of the words' hashes)."""
    data = utf8(text)
    words = word_hashes(data, key)
    n = len(words)
    repeated = 0
    if n >= 4:
        _, where, counts = np.unique(window_hashes(words, 3), return_inverse=True, return_counts=True)
        again = counts[where] >= 2
        if again.any():
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= again
            repeated = int(covered.sum())
    seen: set[str] = set()
    dup = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line.strip(" \t\v\f\r"):
                dup += line in seen
                seen.add(line)
    white = sum(text.count(c) for c in " \t\n\v\f\r")
    return {"n_words": n, "word_chars": len(text) - white, "n_symbols": sum(text.count(c) for c in SYMBOLS), "n_dup_lines": dup, "n_repeat_words": repeated}


def base_failed(m: Measures) -> bool:
    return m["n_words"] < LEAST_WORDS or 100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"]


def timed(texts: list[str], rules: list[Rule] = RULES) -> list[tuple[int, int, float]]:
    """For each rule: texts judged (those that pass the base), texts rejected, seconds."""
    passed = [(t, m) for t in texts if not base_failed(m := measure(t))]
    told = []
    for _, rule in rules:
        start = time.perf_counter()
        rejected = sum(rule(t, m) for t, m in passed)
        told.append((len(passed), rejected, time.perf_counter() - start))
    return told


def order_rules(told: list[tuple[int, int, float]], rules: list[Rule] = RULES) -> list[Rule]:
    """By rejections per second, greatest first; rules that reject nothing come last, cheapest first."""
    cost = [max(1e-9, seconds) / max(1, n) for n, _, seconds in told]
    gain = [rejected / max(1, n) / c for (n, rejected, _), c in zip(told, cost, strict=True)]
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-gain[k], cost[k], k))]


def cascade_cost(told: list[tuple[int, int, float]], rules: list[Rule] = RULES) -> tuple[float, float]:
    """Seconds that the texts of ``told`` take in the cascade's order, a text leaving where it is rejected, and with all rules on all.

    Rules are taken to reject independently of each other.
    """
    names = [name for name, _ in rules]
    left, cascade = 1.0, 0.0
    for name, _ in order_rules(told, rules):
        n, rejected, seconds = told[names.index(name)]
        cascade += left * seconds
        left *= 1 - rejected / max(1, n)
    return cascade, sum(seconds for _, _, seconds in told)


def sampled(docs: DataFrame, text_col: str, rules: list[Rule] = RULES, n: int = SAMPLE) -> list[tuple[int, int, float]]:
    """``timed`` over about ``n`` texts drawn from all rows; only the sums leave the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = timed(b.column(0).to_pylist(), rules)
            cols = list(zip(*told, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(range(len(told)), pa.int32()), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True))], names=["k", "n", "rejected", "seconds"])

    share = min(1.0, n / max(1, docs.count()))
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t")).filter(F.rand(11) < share)
    sums = texts.mapInArrow(run, "k int, n long, rejected long, seconds double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds"))
    got = {r["k"]: (r["n"], r["rejected"], r["seconds"]) for r in sums.collect()}
    return [got.get(k, (0, 0, 0.0)) for k in range(len(rules))]


def judge(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES, sample: int = SAMPLE) -> DataFrame:
    """Adds the base measures, ``base_failed``, ``kept`` and ``rejected_by`` (the first rule of the cascade that fired)."""
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    names = [name for name, _ in order_rules(sampled(docs, text_col, rules, sample), rules)]
    by_name, key = dict(rules), secrets.randbits(63)

    def kernel(texts: list[str]) -> pa.Array:
        rows = []
        for t in texts:
            m = measure(t, key)
            failed = base_failed(m)
            by = "base" if failed else next((n for n in names if by_name[n](t, m)), None)
            rows.append((*m.values(), failed, by is None, by))
        cols = list(zip(*rows, strict=True)) or [()] * len(_TYPES)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, _TYPES.values(), strict=True)], names=list(_TYPES))

    tmp = unused(docs, "_quality")
    out = with_text_struct(docs, text_col, tmp, kernel, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string")
    return out.withColumns({c: F.col(f"{tmp}.{c}") for c in _TYPES}).drop(tmp)


_TYPES = {c: pa.int64() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {"base_failed": pa.bool_(), "kept": pa.bool_(), "rejected_by": pa.string()}
