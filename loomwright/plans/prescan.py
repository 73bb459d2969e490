"""Whole plans: cleaning, chapters, and the prescan from chapters to selected entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized
from ..operators import noise, scanners, scoring, segmentation
from ..session import kept, stored


def preprocess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalize: bool = True, aggressive: bool = False, keep: DataFrame | None = None) -> DataFrame:
    """``doc_id, text, n_lines, n_removed``: normalised (unless told not to), then without noise lines."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if normalize:
        base = base.withColumn("text", normalized(F.col("text")))
    return noise.cleaned(base, aggressive=aggressive, keep=keep)


def outline(docs: DataFrame, **options) -> DataFrame:
    """Chapters of the cleaned text with their volumes, without a scan for entities."""
    clean = stored(preprocess(docs, **options))  # read by each way of splitting
    return segmentation.tree(segmentation.chapters(clean), segmentation.volumes(clean))


def scan(chapters: DataFrame, aliases: DataFrame | None = None, least: int = 5, names: DataFrame | None = None, answers: DataFrame | None = None, batch: int = 10) -> dict[str, DataFrame]:
    """Mentions, entities, confidence, importance, the selected working set of all four types, and counts of each step.

    ``names`` are looked for literally besides the patterns; ``aliases`` (``primary, alias``) roll up into their primary;
    ``answers`` (``book_id, batch, type, text, confidence``) are a model's completion by batches of chapters.
    """
    mentions = scanners.scan_characters(chapters).unionByName(scanners.scan_locations(chapters)).unionByName(scanners.scan_items(chapters)).unionByName(scanners.scan_events(chapters))
    columns = ["book_id", "text", "n", "chapter_index", "position", "all_chapters", "confidence"]
    found = scanners.frequent_names(chapters, least).select(*columns)
    if names is not None:
        exact = scanners.exact_mentions(chapters.withColumn("book_id", F.col("book_id").cast("string")), names).select(*columns)
        found = found.join(exact.select("book_id", "text"), ["book_id", "text"], "left_anti").unionByName(exact)
    if answers is not None:
        mentions = scanners.completed(mentions, chapters, answers, batch)
    if aliases is not None:
        found = scanners.roll_up_aliases(found, aliases)
        mentions = scanners.canonical(mentions, aliases)
    more = ["aliases"] if aliases is not None else []
    found = found.select("book_id", F.lit("character").alias("type"), "text", "chapter_index", "position", "confidence", F.lit(1 << 50).alias("seq"), F.col("n").cast("int").alias("total_count"), "all_chapters", F.lit("regex").alias("source"), *more)
    # Each of these is read by several of the later steps.
    mentions = kept(mentions.unionByName(found, allowMissingColumns=True))
    entities = kept(scoring.grouped(mentions))
    confident = kept(scoring.confidence(entities, chapters))
    scored = kept(scoring.importance(entities, entities, chapters))
    selected = scoring.selected(entities, scored, confident, scanners.likely_frequent_name(F.col("text")))
    counted = lambda rows, c: rows.groupBy("book_id", "type").agg(F.count("*").alias(c))
    statistics = counted(mentions, "n_mentions").join(counted(entities, "n_entities"), ["book_id", "type"], "left").join(counted(selected, "n_selected"), ["book_id", "type"], "left").na.fill(0)
    return {"mentions": mentions, "entities": entities, "confidence": confident, "importance": scored, "selected": selected, "statistics": statistics}
