"""Reading raw text files, and the pipe-separated mention and report files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MENTION_SCHEMA = "chapter_index int, text string, source string, confidence double"


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of the files (each whole); an empty file has no row."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def is_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def encoding_of(content: Column) -> Column:
    return F.when(is_utf8(content) | (F.octet_length(content) == 0), F.lit("utf-8")).otherwise(F.lit("gb18030"))


def decoded(files: DataFrame, content_col: str = "content", out: str = "text") -> DataFrame:
    """Adds the text: UTF-8 (without a byte order mark) in the JVM, anything else as GB18030 in Arrow batches."""

    @F.arrow_udf("string")
    def gb18030(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if x is None else x.decode("gb18030", "replace") for x in b.to_pylist()], pa.string())

    c = F.col(content_col)
    other = F.when(encoding_of(c) == "gb18030", c)
    text = F.when(encoding_of(c) == "utf-8", F.regexp_replace(c.cast("string"), "^\\x{FEFF}", "")).otherwise(gb18030(other))
    return files.withColumns({"encoding": encoding_of(c), out: text})


def mention_lines(mentions: DataFrame) -> DataFrame:
    """``book_id, type, line``: mentions as pipe-separated lines, each chapter and text once, aliases behind a character's name."""
    first = Window.partitionBy("book_id", "type", "chapter_index", "text").orderBy("position")
    rows = mentions.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    alias = F.array_except(F.array_distinct(F.coalesce("aliases", F.array().cast("array<string>"))), F.array("text")) if "aliases" in mentions.columns else F.array().cast("array<string>")
    name = F.when((F.col("type") == "character") & (F.size(alias) > 0), F.concat("text", F.lit("（别名："), F.array_join(alias, "、"), F.lit("）"))).otherwise(F.col("text"))
    line = F.concat_ws("|", "chapter_index", name, "source", F.format_string("%.2f", "confidence"))
    order = F.row_number().over(Window.partitionBy("book_id", "type").orderBy("chapter_index", "position"))
    return rows.select("book_id", "type", order.alias("ord"), line.alias("line"))


def write_mentions(mentions: DataFrame, path: str) -> None:
    """A folder for each book and type."""
    mention_lines(mentions).repartition("book_id", "type").sortWithinPartitions("book_id", "type", "ord").select("book_id", "type", F.col("line").alias("value")).write.partitionBy("book_id", "type").mode("overwrite").text(path)


def parsed_mentions(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Mentions of lines whose text may hold the separator: the last two fields are source and confidence. The place is -1."""
    f = F.split(F.col(line_col), "\\|")
    n = F.size(f)
    rows = lines.filter(n >= 4)
    return rows.select(*[c for c in lines.columns if c != line_col], F.get(f, F.lit(0)).cast("int").alias("chapter_index"), F.array_join(F.slice(f, F.lit(2), n - 3), "|").alias("text"), F.element_at(f, -2).alias("source"), F.element_at(f, -1).cast("double").alias("confidence"), F.lit(-1).alias("position"))


def read_mentions(spark: SparkSession, path: str) -> DataFrame:
    return parsed_mentions(spark.read.text(path).withColumnRenamed("value", "line"))


REPORT = ("text", "story_score", "story_value", "causal_necessity", "information", "transition", "writing_completeness", "adaptation_usability", "production", "importance", "mention_count", "tier", "route")


def report_lines(scored: DataFrame) -> DataFrame:
    """``book_id, type, line``: 13 pipe-separated columns an entity."""
    cols = [F.format_string("%.3f", c) if t == "double" else F.col(c).cast("string") for c, t in scored.select(*REPORT).dtypes]
    return scored.select("book_id", "type", F.concat_ws("|", *cols).alias("line"))


def report_counts(scored: DataFrame) -> DataFrame:
    """Entities of each type by tier and route."""
    tiers, routes = ("core", "supporting", "candidate", "archived"), ("main", "staging", "archive")
    return scored.groupBy("book_id", "type").agg(*[F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in tiers], *[F.count_if(F.col("route") == r).alias(f"n_{r}") for r in routes])


def parsed_report(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Rows of a sectioned report (``doc, n, line``): a line ``## type`` opens a section, forward-filled over its rows; summaries are no rows."""
    w = Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.last(F.nullif(F.regexp_extract(line_col, r"^#+\s*(\w+)", 1), F.lit("")), ignorenulls=True).over(w)
    f = F.split(F.col(line_col), "\\|")
    rows = lines.withColumn("type", kind).filter(F.size(f) == len(REPORT))
    return rows.select("doc", "type", *[F.get(f, F.lit(i)).alias(c) for i, c in enumerate(REPORT)])
