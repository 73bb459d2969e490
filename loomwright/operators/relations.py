"""Relationship edges from sentences, and queries on the graph they make.

Edges: ``book_id, source, target, type, confidence, chapter_first, chapter_last`` (and ``evidence``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions.text import relation_sentences
from . import automaton

TYPES = ("family", "romantic", "friendship", "antagonistic", "professional", "narrative", "unknown")
#: Words by type and strength (``functions.lexicons`` has them); parameters of ``evidence``.
INDICATORS: dict[str, dict[str, tuple[str, ...]]] = {"family": lex.FAMILY, "romantic": lex.ROMANTIC, "friendship": lex.FRIENDSHIP, "antagonistic": lex.ANTAGONISTIC}
STRENGTH = {"explicit": 0.85, "dialogue": 0.65, "action": 0.6}
CO_MENTION = 0.3


def sentence_mentions(chapters: DataFrame, names: list[str]) -> DataFrame:
    """``book_id, chapter_index, sentence_no, sentence, found``: sentences that hold two or more of the names (any case)."""
    rows = chapters.select("book_id", "chapter_index", F.posexplode(relation_sentences(F.coalesce("content", F.lit("")))).alias("sentence_no", "sentence"))
    found = automaton.with_hits(rows, names, "sentence", "_h", fold=True).withColumn("found", F.transform("_h", lambda h: h["name"])).drop("_h")
    return found.filter(F.size("found") >= 2)


def evidence(sentences: DataFrame, indicators=INDICATORS) -> DataFrame:
    """A row for each ordered pair of names in a sentence and each type, with its strength."""
    low = F.lower("sentence")
    strengths = []
    for kind, lists in indicators.items():
        s = F.lit(CO_MENTION)
        for level in reversed(list(STRENGTH)):
            words = lists.get(level, ())
            if words:
                s = F.when(F.greatest(*[F.contains(low, F.lit(w.lower())) for w in words], F.lit(False)), F.lit(STRENGTH[level])).otherwise(s)
        strengths.append(F.struct(F.lit(kind).alias("type"), s.alias("strength")))
    rows = sentences.withColumn("e", F.explode(F.array(*strengths)))
    pairs = rows.withColumn("source", F.explode("found")).withColumn("target", F.explode("found")).filter("source <> target")
    return pairs.select("book_id", "chapter_index", "sentence_no", "sentence", "source", "target", F.col("e.type").alias("type"), F.col("e.strength").alias("strength"))


def edges(found: DataFrame) -> DataFrame:
    """Evidence gathered by pair and type: the first strength, a tenth for each further sentence, at most .99."""
    place = F.struct("chapter_index", "sentence_no")
    out = found.groupBy("book_id", "source", "target", "type").agg(F.min_by("strength", place).alias("c"), F.count("*").alias("n"), F.min("chapter_index").alias("chapter_first"), F.max("chapter_index").alias("chapter_last"))
    return out.select("book_id", "source", "target", "type", F.least(F.lit(0.99), F.col("c") + 0.1 * (F.col("n") - 1)).alias("confidence"), "chapter_first", "chapter_last", "n")


def both_ways(e: DataFrame) -> DataFrame:
    return e.unionByName(e.withColumns({"source": F.col("target"), "target": F.col("source")}))


def confident(e: DataFrame, least: float) -> DataFrame:
    return e.filter(F.col("confidence") >= least)


def merged(e: DataFrame) -> DataFrame:
    return e.groupBy("book_id", "source", "target", "type").agg(F.max("confidence").alias("confidence"), F.min("chapter_first").alias("chapter_first"), F.max("chapter_last").alias("chapter_last"))


def with_ids(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """Endpoints as node ids (``book_id, id, name``), the first node of a name; unknown names stay."""
    first = nodes.groupBy("book_id", "name").agg(F.min_by("id", "seq").alias("id"))
    for side in ("source", "target"):
        e = e.join(first.select("book_id", F.col("name").alias(side), F.col("id").alias("_id")), ["book_id", side], "left").withColumn(side, F.coalesce("_id", side)).drop("_id")
    return e


def name_index(nodes: DataFrame) -> DataFrame:
    """``book_id, key, id``: names and aliases in lower case, the last node that has one."""
    names = nodes.select("book_id", "id", "seq", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    return names.groupBy("book_id", F.lower("n").alias("key")).agg(F.max_by("id", "seq").alias("id"))


def query(e: DataFrame, node: str | None = None, kind: str | None = None, least: float | None = None, chapters: tuple[int, int] | None = None) -> DataFrame:
    """Edges by endpoint, type, confidence and overlap with a range of chapters (unknown chapters pass)."""
    c = F.lit(True)
    if node is not None:
        c = c & ((F.col("source") == node) | (F.col("target") == node))
    if kind is not None:
        c = c & (F.col("type") == kind)
    if least is not None:
        c = c & (F.col("confidence") >= least)
    if chapters is not None:
        c = c & F.coalesce((F.col("chapter_first") <= chapters[1]) & (F.col("chapter_last") >= chapters[0]), F.lit(True))
    return e.filter(c)


def timeline(e: DataFrame, a: str, b: str) -> DataFrame:
    hit = ((F.col("source") == a) & (F.col("target") == b)) | ((F.col("source") == b) & (F.col("target") == a))
    return e.filter(hit).orderBy(F.coalesce("chapter_first", F.lit(0)), "type", "source")


def friends_of_friends(e: DataFrame, nodes: DataFrame, only_unknown: bool = True) -> DataFrame:
    """``book_id, id, target, confidence``: friends of friends at half the first edge's confidence; by default only those that are no node."""
    f = both_ways(e.filter(F.col("type") == "friendship").select("book_id", "source", "target", "confidence")).distinct()
    two = f.select("book_id", F.col("source").alias("id"), F.col("target").alias("via"), "confidence").join(f.select("book_id", F.col("source").alias("via"), F.col("target").alias("target")), ["book_id", "via"]).filter("id <> target")
    known = nodes.select("book_id", F.col("id").alias("target")).distinct()
    two = two.join(nodes.select("book_id", "id").distinct(), ["book_id", "id"], "left_semi")
    if only_unknown:
        two = two.join(known, ["book_id", "target"], "left_anti")
    else:
        two = two.join(f.select("book_id", F.col("source").alias("id"), "target"), ["book_id", "id", "target"], "left_anti")
    return two.groupBy("book_id", "id", "target").agg((0.5 * F.max("confidence")).alias("confidence"))


def stats(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row a book: nodes, edges and edges of each type, zeros included."""
    n = nodes.groupBy("book_id").agg(F.count("*").alias("nodes"))
    k = e.groupBy("book_id").agg(F.count("*").alias("edges"), *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in TYPES])
    out = n.join(k, "book_id", "full_outer")
    return out.select("book_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in out.columns if c != "book_id"])


def write_graph(e: DataFrame, nodes: DataFrame, path: str) -> None:
    """Nodes and edges as JSON lines, in folders of their own; no book is gathered anywhere."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    e.write.mode("overwrite").json(f"{path}/edges")


def read_graph(spark: SparkSession, path: str, node_schema: str, edge_schema: str) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes of ``write_graph``."""
    return spark.read.schema(edge_schema).json(f"{path}/edges"), spark.read.schema(node_schema).json(f"{path}/nodes")
