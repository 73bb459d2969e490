"""Exports as JSON, CSV and Markdown; run summaries and discovery of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FORMATS = ("json", "csv", "markdown")
LABELS = {"character": "Characters", "location": "Locations", "item": "Items"}
COMMON = ("name", "aliases", "description", "confidence", "status", "mention_count", "first_chapter", "last_chapter")
OF_CHARACTERS = ("dialogue_count", "co_characters")
TIERED = ("tier", "importance_score", "pillar_causal", "pillar_uniqueness", "pillar_transition")
THREE_PLACES = ("confidence", "importance_score")


def columns_of(kind: str) -> tuple[str, ...]:
    return COMMON + (OF_CHARACTERS if kind == "character" else TIERED)


def _field(rows: DataFrame, name: str) -> Column:
    zero = "0" if name.endswith("_count") or name.startswith("pillar") else ""
    if name not in rows.columns:
        return F.lit("0.000" if name in THREE_PLACES else zero)
    kind = dict(rows.dtypes)[name]
    if kind.startswith("array"):
        return F.array_join(F.coalesce(name, F.array().cast(kind)), "; ")
    if name in THREE_PLACES:
        return F.format_string("%.3f", F.coalesce(name, F.lit(0.0)))
    return F.coalesce(F.col(name).cast("string"), F.lit(zero))


def quoted(c: Column) -> Column:
    return F.when(c.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_lines(rows: DataFrame, kind: str) -> DataFrame:
    """``book_id, line`` without the header (``csv_header``)."""
    return rows.select("book_id", F.concat_ws(",", *[quoted(_field(rows, c)) for c in columns_of(kind)]).alias("line"))


def csv_header(kind: str) -> str:
    return ",".join(columns_of(kind))


def json_documents(rows: DataFrame, kind: str, books: DataFrame) -> DataFrame:
    """``book_id, value``: one document a book with its entities in order of ``seq``."""
    plural = f"{kind}s"
    packed = rows.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct(*[c for c in rows.columns if c not in ("book_id", "seq")]).alias("v")))), lambda x: x["v"]).alias(plural))
    out = books.join(packed, "book_id", "left")
    return out.select("book_id", F.to_json(F.struct(F.struct("book_id", "title").alias("book"), F.lit(kind).alias("kind"), F.lit(LABELS[kind]).alias("kindLabel"), F.col(plural))).alias("value"))


def markdown_entities(rows: DataFrame, kind: str) -> DataFrame:
    """``book_id, seq, block``: heading, aliases, description and property table of each entity."""
    line = lambda label, c, shown: F.when(shown, F.concat(F.lit(f"| {label} | "), c.cast("string"), F.lit(" |\n")))
    has = lambda c: F.col(c).isNotNull() if c in rows.columns else F.lit(False)
    get = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    filled = lambda c: (F.coalesce(F.size(c), F.lit(0)) > 0) if c in rows.columns else F.lit(False)
    joined = lambda c: F.array_join(c, ", ") if c in rows.columns else F.lit("")
    parts = [
        F.concat(F.lit("### "), "name", F.lit("\n\n")),
        F.when(filled("aliases"), F.concat(F.lit("**Aliases:** "), joined("aliases"), F.lit("\n\n"))),
        F.when(F.coalesce(get("description"), F.lit("")) != "", F.concat(get("description"), F.lit("\n\n"))),
        F.lit("| Property | Value |\n|----------|-------|\n"),
        line("Confidence", F.format_string("%.1f%%", F.coalesce(get("confidence").cast("double"), F.lit(0.0)) * 100), F.lit(True)),
        line("Status", F.coalesce(get("status"), F.lit("")), F.lit(True)),
        line("Chapters", joined("chapter_appearances"), filled("chapter_appearances")),
        line("First Chapter", get("first_chapter"), has("first_chapter")),
        line("Last Chapter", get("last_chapter"), has("last_chapter")),
        line("Mentions", get("mention_count"), F.coalesce(get("mention_count").cast("long"), F.lit(0)) > 0),
    ]
    if kind == "character":
        parts += [line("Dialogues", get("dialogue_count"), F.coalesce(get("dialogue_count").cast("long"), F.lit(0)) > 0), line("Co-Characters", joined("co_characters"), filled("co_characters"))]
    else:
        parts += [line("Tier", get("tier"), has("tier")), line("Importance", F.format_string("%.3f", get("importance_score").cast("double")), has("importance_score"))]
        parts += [line(f"Pillar · {label}", get(c), has(c)) for label, c in (("Causal", "pillar_causal"), ("Uniqueness", "pillar_uniqueness"), ("Transition", "pillar_transition"))]
    return rows.select("book_id", "seq", F.concat_ws("", *parts, F.lit("\n---\n")).alias("block"))


def markdown_documents(rows: DataFrame, kind: str, books: DataFrame) -> DataFrame:
    blocks = markdown_entities(rows, kind).groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "block"))), lambda x: x["block"]), "\n").alias("body"), F.count("*").alias("n"))
    out = books.join(blocks, "book_id", "left")
    return out.select("book_id", F.concat(F.lit("# "), "title", F.lit(f"\n\n## {LABELS[kind]} ("), F.coalesce("n", F.lit(0)).cast("string"), F.lit(")\n\n"), F.coalesce("body", F.lit(""))).alias("value"))


def export(rows: DataFrame, kind: str, fmt: str, books: DataFrame) -> DataFrame:
    """Dispatch by format; an unknown one is an error."""
    if fmt == "json":
        return json_documents(rows, kind, books)
    if fmt == "csv":
        return csv_lines(rows, kind).select("book_id", F.col("line").alias("value"))
    if fmt == "markdown":
        return markdown_documents(rows, kind, books)
    raise ValueError(f"unknown format {fmt}; known are {', '.join(FORMATS)}")


def write_documents(docs: DataFrame, path: str) -> None:
    docs.select("book_id", "value").write.partitionBy("book_id").mode("overwrite").text(path)


def write_assets(assets: DataFrame, path: str) -> None:
    """JSON, a folder for each story."""
    assets.write.partitionBy("story_id").mode("overwrite").json(path)


def read_assets(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def run_summary(entities: DataFrame) -> DataFrame:
    """Counts and names of each book and type."""
    return entities.groupBy("book_id", "type").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("name")).alias("names"))


def runs(summaries: DataFrame, book: str | None = None) -> DataFrame:
    """Official runs, newest first, the newest of each book marked ``current``."""
    rows = summaries.filter("official") if book is None else summaries.filter(F.col("official") & (F.col("book_id") == book))
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("generated_at"), "run_id"))
    return rows.withColumn("rank", rank).withColumn("current", F.col("rank") == 1)
