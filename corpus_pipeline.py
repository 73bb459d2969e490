"""From raw documents to packed sequences: language ID, exact and near deduplication, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read again as the next stage's
``docs``. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import exact_dedup, langid, mixing, near_dedup, packing
from loomwright.llm.common import documents, prepare, scratch, unused, written

#: Target shares of the tokens, reached by repeating documents; none is given up for the mixture.
SHARES = {"good": 0.78, "low": 0.12, "toxic": 0.10}
#: A share may miss its target by this much before the stage warns.
SHARE_TOLERANCE = 0.005


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language: those with a letter whose score is not below what training texts of their size reach. ``lang`` stays as it came."""
    prepare(spark)
    lang, score, grams = unused(docs, "_lang_pred"), unused(docs, "_lang_score"), unused(docs, "_lang_grams")
    prototypes = langid.train(docs.filter(~langid.held_out("doc_id")), "text", "lang")
    # Written, so that the scores of all training texts can tell the thresholds before any text is dropped.
    told = written(langid.predict(docs, "text", prototypes, lang, score, grams), "told", keep=True).filter(F.col(lang) != langid.UNKNOWN)
    least = langid.thresholds(told.filter(~langid.held_out("doc_id") & F.col("lang").isNotNull()), score, grams)
    return told.filter(~langid.unlike(F.col(score), F.col(grams), least)).drop(lang, score, grams)


#: Ids (or row numbers) of dropped documents up to which they are broadcast (8 bytes a row); beyond, a shuffle join.
BROADCAST_ROWS = 2_000_000


def _without_copies(spark: SparkSession, docs: DataFrame, decide: Callable[..., DataFrame]) -> DataFrame:
    """The rows of ``docs`` that ``decide`` keeps: told by their ids, or by row numbers written with them where an id occurs more than once."""
    told_by, key = "doc_id", unused(docs, "_i")
    if not docs.groupBy(F.col("doc_id").cast("long").alias("i")).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        told_by = unused(docs, "_row")
        docs, columns = written(docs.withColumn(told_by, F.monotonically_increasing_id()), "numbered", keep=True), docs.columns
    else:
        columns = docs.columns
    with scratch(spark):
        decisions = written(decide(docs, row_col=None if told_by == "doc_id" else told_by).select(told_by, "kept"), "kept", keep=True)
    dropped = decisions.filter("not kept").select(F.col(told_by).alias(key))
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, F.col(told_by).eqNullSafe(F.col(key)), "left_anti").select(*[F.col(f"`{c}`") for c in columns])


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    return _without_copies(spark, docs, exact_dedup.deduplicate)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document with the smallest id stays."""
    return _without_copies(spark, docs, near_dedup.near_duplicates)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents by their rates, which bring the domains' expected tokens to the target shares; every document stays at least once."""
    labels = mixing.domains_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rated = mixing.mix(docs, labels, mixing.DOMAINS, SHARES, least=1.0)
    reached = mixing.shares(rated, mixing.DOMAINS)
    if any(abs(x - SHARES[d]) > SHARE_TOLERANCE for d, x in reached.items()):
        warnings.warn(f"The mixture misses its target shares {SHARES}: {reached}", stacklevel=2)
    return mixing.repeated(rated, F.col("rate"), "doc_id", docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, one row a piece."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), memo=MEMO)


#: Pieces that a worker remembers while packing: fewer than by default, as its memory is that of all stages before.
MEMO = 200_000

STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: Language profiles, rates and packings have no SQL form; the tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
