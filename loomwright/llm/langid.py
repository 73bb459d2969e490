"""Language identification with hyperdimensional profiles.

Each letter has a random +-1 vector of ``DIMS`` entries, made from its code point by a fixed rule. An n-gram's vector
binds (multiplies) its letters' vectors, each permuted (rolled) by its place. A text's vector bundles (adds) the vectors
of its letter trigrams; a language's prototype bundles those of its training texts. A text gets the language whose
prototype has the greatest cosine with the text's vector.

Defined cases: texts are lower-cased; every run of characters that are no letters counts as one gap; null, empty and
letterless texts are ``und`` with score 0; of equal cosines the language first in code-point order wins; with no
training text every text is ``und``. Texts of any length go in slices, so memory stays bounded. Extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CACHES, enter, splitmix, unused, with_text_struct

DIMS = 1024
UNKNOWN = "und"
_SLICE = 1 << 17
_CACHED_GRAMS = 8192


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=4096)
def _letter_vector(code: int) -> np.ndarray:
    """+-1 by the bits of splitmix64 of (code point, word index); 0 is the gap between words."""
    words = splitmix(np.arange(DIMS // 64, dtype=np.uint64) + np.uint64(code * 1_000_003 + 17))
    return np.unpackbits(words.view(np.uint8)).astype(np.int8) * 2 - 1


def _gram_vector(code: int) -> np.ndarray:
    a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
    return np.roll(_letter_vector(a), 2) * np.roll(_letter_vector(b), 1) * _letter_vector(c)


class _Grams:
    """Vectors of n-grams met so far; starts anew when full."""

    def __init__(self) -> None:
        self.place: dict[int, int] = {}
        self.rows = np.empty((_CACHED_GRAMS, DIMS), np.int8)

    def of(self, codes: list[int]) -> np.ndarray:
        if len(self.place) + len(codes) > _CACHED_GRAMS:
            new = [c for c in codes if c not in self.place]
            if len(self.place) + len(new) > _CACHED_GRAMS:
                self.place.clear()
        for c in codes:
            if c not in self.place:
                self.place[c] = len(self.place)
                self.rows[self.place[c]] = _gram_vector(c)
        return self.rows[[self.place[c] for c in codes]].astype(np.float32)


@lru_cache(maxsize=1)
def _grams() -> _Grams:
    return _Grams()


CACHES.append(("langid", _grams.cache_clear))


def _gram_codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(_letters()[points], points, 0)
    points = np.concatenate(([0], points, [0]))
    points = points[np.concatenate(([True], (points[1:] != 0) | (points[:-1] != 0)))]
    if len(points) < 3:
        return np.zeros(0, np.int64)
    return points[:-2] << 42 | points[1:-1] << 21 | points[2:]


def _slices(text: str) -> Iterator[str]:
    """Slices end at a character that is no letter where there is one in the last half."""
    at = 0
    while at < len(text):
        end = at + _SLICE
        if end < len(text):
            cut = next((k for k in range(end, end - _SLICE // 2, -1) if not text[k].isalpha()), end)
            end = cut
        yield text[at:end]
        at = end


def text_vectors(texts: list[str]) -> np.ndarray:
    """A row for each text: the bundle of its trigrams' vectors (zeros if it has no letter)."""
    return _bundles(texts)[0]


def _bundles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of texts and their numbers of trigrams."""
    out, n = np.zeros((len(texts), DIMS), np.float32), np.zeros(len(texts), np.int64)
    block: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not block:
            return
        owners = np.concatenate([np.full(len(c), k, np.int64) for k, (_, c) in enumerate(block)])
        grams, where = np.unique(np.concatenate([c for _, c in block]), return_inverse=True)
        for lo in range(0, len(grams), _CACHED_GRAMS // 4):
            hi = min(len(grams), lo + _CACHED_GRAMS // 4)
            mine = (where >= lo) & (where < hi)
            counts = np.bincount(owners[mine] * (hi - lo) + where[mine] - lo, minlength=len(block) * (hi - lo))
            add = counts.reshape(len(block), hi - lo).astype(np.float32) @ _grams().of(grams[lo:hi].tolist())
            for k, (row, _) in enumerate(block):
                out[row] += add[k]
        block.clear()
        size = 0

    for row, text in enumerate(texts):
        for piece in _slices(text):
            codes = _gram_codes(piece)
            if len(codes):
                n[row] += len(codes)
                block.append((row, codes))
                size += len(codes)
                if size >= _SLICE or len(block) >= 128:
                    flush()
    flush()
    return out, n


#: Distinct trigrams (with their counts) that a training task keeps before they are multiplied out, over all its languages.
_MANY = 1 << 20


def _multiplied(told: list[pa.StructArray]) -> np.ndarray:
    """The bundle of counted trigrams: each distinct one is met once."""
    grams, where = np.unique(np.concatenate([t.field("values").to_numpy() for t in told]), return_inverse=True)
    counts = np.bincount(where, np.concatenate([t.field("counts").to_numpy() for t in told]), len(grams))
    out = np.zeros(DIMS)
    for lo in range(0, len(grams), _CACHED_GRAMS // 4):
        part = slice(lo, lo + _CACHED_GRAMS // 4)
        out += counts[part] @ _grams().of(grams[part].tolist())
    return out


def train(labelled: DataFrame, text_col: str, lang_col: str, id_col: str | None = None) -> dict[str, np.ndarray]:
    """Prototypes by language from all labelled texts, whatever their ids.

    The sums are made on the executors, from the counts of trigrams of each task; what reaches the driver is one vector a
    language.
    """
    rows = labelled.select(F.col(f"`{lang_col}`").cast("string").alias("l"), F.col(f"`{text_col}`").cast("string").alias("t")).filter("l is not null and t is not null")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("langid")
        sums: dict[str, np.ndarray] = {}
        counted: dict[str, list[pa.StructArray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        n_counted = n_waiting = 0

        def count() -> None:
            nonlocal n_counted, n_waiting
            for lang, codes in waiting.items():
                told = pa.array(np.concatenate(codes)).value_counts()
                counted.setdefault(lang, []).append(told)
                n_counted += len(told)
            waiting.clear()
            n_waiting = 0
            if n_counted >= _MANY:
                multiply()

        def multiply() -> None:
            nonlocal n_counted
            for lang, told in counted.items():
                sums[lang] = sums.get(lang, 0) + _multiplied(told)
            counted.clear()
            n_counted = 0

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for piece in _slices(text):
                    codes = _gram_codes(piece)
                    if len(codes):
                        waiting.setdefault(lang, []).append(codes)
                        n_waiting += len(codes)
                    if n_waiting >= _MANY:
                        count()
        count()
        multiply()
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMS), pa.array(np.arange(DIMS, dtype=np.int32)), pa.array(v)], names=["l", "d", "v"])

    sums = rows.mapInArrow(bundle, "l string, d int, v double").groupBy("l", "d").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():
        out.setdefault(r["l"], np.zeros(DIMS))[r["d"]] = r["v"]
    return {k: out[k] for k in sorted(out) if out[k].any()}


def _scorer(prototypes: dict[str, np.ndarray]):
    """For texts: the place of the language, the cosine (0 to 1) and the number of trigrams; place -1 and 0 without a language."""
    matrix = np.array([v / np.linalg.norm(v) for v in prototypes.values()], np.float32).reshape(len(prototypes), DIMS)

    def score(texts: list[str]) -> Iterator[tuple[int, float, int]]:
        vectors, grams = _bundles(texts)
        norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        cosines = vectors @ matrix.T / np.maximum(norms, 1e-9)[:, None]
        for norm, row, n in zip(norms, cosines, grams.tolist(), strict=True):
            best = int(np.argmax(row)) if norm and len(row) else -1
            yield best, min(1.0, max(0.0, float(row[best]))) if best >= 0 else 0.0, n

    return score


def predict(df: DataFrame, text_col: str, prototypes: dict[str, np.ndarray], lang_out: str = "lang_pred", score_out: str = "score", grams_out: str | None = None) -> DataFrame:
    """Adds the predicted language, the cosine with its prototype (0 to 1) and, where named, the number of trigrams."""
    names = list(prototypes)
    score = _scorer(prototypes)

    def kernel(texts: list[str]) -> pa.Array:
        enter("langid")
        langs, scores, grams = [], [], []
        for lo in range(0, len(texts), 256):
            for best, s, n in score(texts[lo : lo + 256]):
                langs.append(names[best] if best >= 0 else UNKNOWN)
                scores.append(s)
                grams.append(n)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(grams, pa.int64())], names=["lang", "score", "grams"])

    tmp = unused(df, "_lang")
    out = with_text_struct(df, text_col, tmp, kernel, "lang string, score double, grams long")
    made = {lang_out: F.col(f"{tmp}.lang"), score_out: F.col(f"{tmp}.score")} | ({grams_out: F.col(f"{tmp}.grams")} if grams_out else {})
    return out.withColumns(made).drop(tmp)


#: A text is rejected below this share of the score that all but ``TAIL`` of the training texts of its size reach; sizes with
#: fewer training texts than ``LEAST_TEXTS`` take shorter ones along. Scores are counted by steps of 1 / ``STEPS``.
TAIL, SLACK, LEAST_TEXTS, STEPS = 0.001, 0.5, 30, 1 << 16


def thresholds(scored: DataFrame, score_col: str, grams_col: str) -> list[float]:
    """Least scores by the number of trigrams: entry k is for 2**k to 2**(k+1) - 1 of them.

    From the scores that ``predict`` gave the training texts, all of them: of n texts the one with ``TAIL`` * (n - 1) below it
    tells, rounded down to a step. Where a size and the shorter ones taken along have no training text, nothing is known and
    the entry is 0.
    """
    step = F.floor(F.col(f"`{score_col}`") * STEPS).cast("int")
    counts = scored.filter(F.col(f"`{grams_col}`") > 0).groupBy((F.length(F.bin(F.col(f"`{grams_col}`"))) - 1).alias("k"), step.alias("step")).agg(F.count("*").alias("n"))
    # At most STEPS + 1 rows a size, however many texts.
    upto, size = F.sum("n").over(Window.partitionBy("k").orderBy("step")), F.sum("n").over(Window.partitionBy("k"))
    rows = counts.withColumns({"upto": upto, "size": size}).filter(F.col("upto") > TAIL * (F.col("size") - 1)).groupBy("k").agg(F.first("size").alias("n"), F.min("step").alias("step")).collect()
    tails = {r["k"]: (r["n"], min(1.0, r["step"] / STEPS)) for r in rows}
    out = []
    for k in range(64):
        seen, tail = 0, None
        for j in range(k, -1, -1):
            if j in tails and seen < LEAST_TEXTS:
                seen, tail = seen + tails[j][0], min(tails[j][1], 1.0 if tail is None else tail)
        out.append(SLACK * tail if tail is not None else 0.0)
    return out


def unlike(score: Column, grams: Column, least: list[float]) -> Column:
    """Whether a text's score is below the least one of its number of trigrams."""
    return score < F.element_at(F.array(*[F.lit(float(x)) for x in least]), F.greatest(F.length(F.bin(grams)), F.lit(1)))


def held_out(id_col: str):
    """True for rows that training must not see: crc32 of the id's text is divisible by 5; a null id is held out too."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Trains on the labelled rows that are not held out, then predicts every row; keeps all columns of ``docs``."""
    prototypes = train(docs.filter(~held_out(id_col)), text_col, lang_col)
    return predict(docs, text_col, prototypes)
