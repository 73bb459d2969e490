"""Registered queries over the driver's tables, with their SQL equivalents where SQL can say it.

Mapping: a document is a book (``doc_id``); 3000-character pieces are its chapters; conversations are books whose turns are
chapters; events are a narrative stream by user; customers, parts and orders are entity tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assembly, coreference, narrative, noise, relations, resolution, scanners, scoring, segmentation, validation
from ..sources import exports, model, tables, text_files
from ..streaming import progress
from . import prescan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        @wraps(f)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            """Whole numbers come as long, as SQL counts them."""
            df = f(spark, sf)
            return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark, sf) -> DataFrame:
    return _t(spark, sf, "documents")


def _turns(spark, sf) -> DataFrame:
    """Conversations as chapters."""
    return _t(spark, sf, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").cast("int").alias("chapter_index"), F.col("role").alias("title"), F.col("text").alias("content"))


WORDS = ["that", "with", "from", "this"]
#: Patterns of the driver's documents, in place of the default ones.
LATIN = noise.Lexicon(templates=("(?i)licensed under", "(?i)all rights reserved", "(?i)copyright", "(?i)released under"), promo=("GNU General Public License",), garbled_share=0.1, good_chars="[A-Za-z0-9\\s.,!?'\\x{80}-\\x{10FFFF}]")
WS = " \\t\\n\\r\\x0b\\x0c"
URL_SQL = r"(?i)(?:https?://|www\.)\S+|\S+\.(?:com|cn|net|org|cc|me|io|xyz|top|vip|club)\b"
_TRIM = "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_LINES = "l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_num FROM documents)"

# -- lines and noise ------------------------------------------------------------


@query(f"WITH {_LINES} SELECT doc_id, line_num, line FROM l")
def line_explode(spark, sf):
    return noise.lines(_docs(spark, sf))


@query(rf"""
WITH {_LINES}, t AS (SELECT doc_id, line_num, {_TRIM} AS t FROM l)
SELECT doc_id, line_num, length({_TRIM.replace('line', f"regexp_replace(t, '{URL_SQL}', '', 'g')")}) AS rest,
       length({_TRIM.replace('line', f"regexp_replace(t, '{URL_SQL}', '', 'g')")}) <= 30 AS is_noise
FROM t WHERE regexp_matches(t, '{URL_SQL}')""")
def noise_url(spark, sf):
    line = F.col("line")
    rows = noise.lines(_docs(spark, sf)).filter(T.trimmed(line).rlike(noise.DEFAULT.url))
    rest = F.length(noise.url_rest(line))
    return rows.select("doc_id", "line_num", rest.alias("rest"), (rest <= 30).alias("is_noise"))


_TEMPLATE = "licensed under|all rights reserved|copyright|released under"


@query(rf"""
WITH {_LINES}, t AS (SELECT doc_id, line_num, {_TRIM} AS t FROM l)
SELECT doc_id, line_num, substr(t, 1, 100) AS content FROM t WHERE t <> '' AND length(t) <= 200 AND regexp_matches(t, '(?i){_TEMPLATE}')""")
def noise_template(spark, sf):
    rows = noise.lines(_docs(spark, sf))
    fires, _ = noise.candidates(F.col("line"), LATIN)["template"]
    return rows.filter(fires).select("doc_id", "line_num", F.substring(T.trimmed(F.col("line")), 1, 100).alias("content"))


@query(rf"""
WITH {_LINES}, t AS (SELECT doc_id, line_num, {_TRIM} AS t FROM l)
SELECT doc_id, line_num, length(regexp_replace(t, '[A-Za-z0-9\s.,!?''\x{{80}}-\x{{10FFFF}}]', '', 'g')) AS bad, length(t) AS n
FROM t WHERE length(t) >= 10 AND length(regexp_replace(t, '[A-Za-z0-9\s.,!?''\x{{80}}-\x{{10FFFF}}]', '', 'g')) / length(t) > 0.1""")
def noise_symbol_ratio(spark, sf):
    fires, _ = noise.candidates(F.col("line"), LATIN)["garbled"]
    t = T.trimmed(F.col("line"))
    return noise.lines(_docs(spark, sf)).filter(fires).select("doc_id", "line_num", F.length(F.regexp_replace(t, LATIN.good_chars, "")).alias("bad"), F.length(t).alias("n"))


_SUSPECTS = rf"""
{_LINES}, t AS (SELECT doc_id, line_num, line, {_TRIM} AS t FROM l),
c AS (
  SELECT doc_id, line_num, 0.9 AS confidence, 0 AS rank, 'url' AS category FROM t WHERE regexp_matches(t, '{URL_SQL}') AND length({_TRIM.replace('line', f"regexp_replace(t, '{URL_SQL}', '', 'g')")}) <= 30
  UNION ALL SELECT doc_id, line_num, 0.85, 1, 'promo' FROM t WHERE t <> '' AND length(t) <= 200 AND contains(lower(t), 'gnu general public license')
  UNION ALL SELECT doc_id, line_num, 0.8, 2, 'template' FROM t WHERE t <> '' AND length(t) <= 200 AND regexp_matches(t, '(?i){_TEMPLATE}')
  UNION ALL SELECT doc_id, line_num, 0.85, 4, 'garbled' FROM t WHERE length(t) >= 10 AND length(regexp_replace(t, '[A-Za-z0-9\s.,!?''\x{{80}}-\x{{10FFFF}}]', '', 'g')) / length(t) > 0.1
  UNION ALL SELECT doc_id, line_num, 0.9, 3, 'decoration' FROM t WHERE regexp_matches(line, '^\s*[-=*#~_]{{5,}}\s*$')
  UNION ALL SELECT doc_id, line_num, 0.95, 5, 'meta' FROM t WHERE regexp_matches(t, '^\s*\d+\s*/\s*\d+\s*$')),
b AS (SELECT doc_id, line_num, category, confidence FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, line_num ORDER BY confidence DESC, rank) = 1)"""


@query(f"WITH {_SUSPECTS} SELECT doc_id, line_num, category, cast(confidence AS DOUBLE) AS confidence FROM b")
def noise_dedup(spark, sf):
    return noise.detect(_docs(spark, sf), lex=LATIN).select("doc_id", "line_num", "category", "confidence")


@query(f"WITH {_SUSPECTS} SELECT doc_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (category = '{c}') AS n_{c}" for c in noise.CATEGORIES) + " FROM b GROUP BY doc_id")
def noise_counts(spark, sf):
    return noise.counts(noise.detect(_docs(spark, sf), lex=LATIN))


@query(f"WITH {_SUSPECTS}" + """,
g AS (SELECT l.doc_id, count(*) AS n_lines, count(b.line_num) AS n_removed, string_agg(l.line, chr(10) ORDER BY l.line_num) FILTER (b.line_num IS NULL) AS text
      FROM l LEFT JOIN b ON b.doc_id = l.doc_id AND b.line_num = l.line_num AND b.confidence >= 0.8 GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) AS word_count, md5(coalesce(text, '')) AS text_md5 FROM g""")
def clean_stats(spark, sf):
    """The flagship: noise detection, cleaning and statistics, inside each document's row."""
    out = noise.cleaned(_docs(spark, sf), lex=LATIN)
    return out.select("doc_id", "n_lines", "n_removed", F.length(F.regexp_replace("text", r"\s", "")).alias("word_count"), F.md5(F.encode("text", "utf-8")).alias("text_md5"))


@query(f"WITH {_SUSPECTS}" + """, k AS (SELECT DISTINCT doc_id, line_num FROM b WHERE (doc_id + line_num) % 2 = 0)
SELECT b.doc_id, b.line_num, b.category, k.line_num IS NOT NULL AS restored, b.confidence >= 0.8 AND k.line_num IS NULL AS removed
FROM b LEFT JOIN k USING (doc_id, line_num) QUALIFY row_number() OVER (PARTITION BY b.doc_id ORDER BY b.line_num) <= 200""")
def noise_outline(spark, sf):
    found = noise.detect(_docs(spark, sf), lex=LATIN)
    keep = found.filter((F.col("doc_id") + F.col("line_num")) % 2 == 0).select("doc_id", "line_num")
    return noise.outline(found, keep).select("doc_id", "line_num", "category", "restored", "removed")


@query(f"""WITH {_LINES} SELECT doc_id, {_TRIM} AS tail, count(*) AS n FROM l WHERE length({_TRIM}) > 3 GROUP BY ALL HAVING count(*) >= 3""")
def repeated_lines_in_doc(spark, sf):
    docs = _docs(spark, sf).withColumn("text", F.regexp_replace("text", "\n", "\n\n\n"))
    rows = noise.repeated_tails(docs, share=0.0, least=1, last=1)
    return rows.filter("n >= 3").select("doc_id", "tail", "n")


@query("""
WITH s AS (SELECT doc_id % 10 AS g, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents WHERE trim(coalesce(text, ''), ' ' || chr(10)) <> ''),
n AS (SELECT g, count(*) AS sections FROM s GROUP BY g),
e AS (SELECT g, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i, len(ls) AS k FROM s),
t AS (SELECT g, trim(line, ' ' || chr(9) || chr(13)) AS tail FROM e WHERE i > k - 5)
SELECT g AS doc_id, sections, tail, count(*) AS n FROM t JOIN n USING (g) WHERE length(tail) > 3 GROUP BY ALL HAVING count(*) >= 0.02 * sections""")
def repeated_tails(spark, sf):
    """Documents as sections of ten books."""
    sections = _docs(spark, sf).select((F.col("doc_id") % 10).alias("doc_id"), F.coalesce("text", F.lit("")).alias("section"))
    return noise.section_tails(sections, share=0.02)


@query("""
SELECT doc_id, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '\\r\\n', chr(10), 'g')) AS crlf_fixed,
       length(regexp_replace(regexp_replace(coalesce(text, ''), '[ \\t]+\\n', chr(10), 'g'), '[ \\t]+$', '')) AS n_stripped
FROM documents""")
def normalization(spark, sf):
    text = F.coalesce("text", F.lit(""))
    return _docs(spark, sf).select("doc_id", T.normalization_report(text)["crlf_fixed"].alias("crlf_fixed"), F.length(T.without_trailing_blanks(text)).alias("n_stripped"))


@query(r"""SELECT doc_id, length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) AS word_count FROM documents""")
def word_counts(spark, sf):
    return _docs(spark, sf).select("doc_id", T.word_count(F.coalesce("text", F.lit(""))).alias("word_count"))


@query(r"""
WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[。！？；.!?;\n]+')) AS s FROM documents)
SELECT doc_id, count(*) AS n, cast(sum(length(s)) AS BIGINT) AS chars FROM s WHERE trim(s, ' ' || chr(9)) <> '' GROUP BY doc_id""")
def relation_sentences(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.explode(T.relation_sentences(F.coalesce("text", F.lit("")))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))


@query(r"""
WITH s AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^。！？!?；;\n]{4,120}')) AS s FROM documents)
SELECT doc_id, count(*) AS n, max(length(s)) AS longest FROM s GROUP BY doc_id""")
def event_sentences(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.explode(T.event_sentences(F.coalesce("text", F.lit("")))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("s")).alias("longest"))


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part""")
def slugs(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", T.slug_part(F.col("p_name")).alias("slug"))


# -- chapters -------------------------------------------------------------------


@query("""
WITH c AS (SELECT doc_id, text, unnest(range(0, cast(ceil(length(text) / 3000) AS BIGINT))) AS chapter_index FROM documents WHERE length(text) > 0)
SELECT doc_id, cast(chapter_index AS BIGINT) AS chapter_index, length(regexp_replace(substr(text, chapter_index * 3000 + 1, 3000), '\\s', '', 'g')) AS word_count FROM c""")
def fixed_chunks(spark, sf):
    return segmentation.fixed_chunks(_docs(spark, sf)).select("doc_id", "chapter_index", "word_count")


@query("""
WITH c AS (SELECT doc_id, trim(text, ' ' || chr(10) || chr(9)) AS t FROM documents),
e AS (SELECT doc_id, t, unnest(range(0, cast(ceil(length(t) / 2000) AS BIGINT))) AS chapter_index FROM c WHERE length(t) > 0)
SELECT doc_id, cast(chapter_index AS BIGINT) AS chapter_index, length(substr(t, chapter_index * 2000 + 1, 2000)) AS n FROM e""")
def legacy_chunks(spark, sf):
    return segmentation.legacy_chapters(_docs(spark, sf)).select("doc_id", "chapter_index", F.length("content").alias("n"))


@query("""
WITH m AS (SELECT user_id, event_id, ts, event_type, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT user_id, event_id, CASE WHEN k > 0 THEN cast(k - 1 AS BIGINT) END AS volume_idx FROM m WHERE event_type <> 'signup'""")
def as_of_volume(spark, sf):
    """Events as chapters, sign-ups as volume headings: the last heading at or before each."""
    ev = _t(spark, sf, "events").withColumn("line", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    base = ev.select(F.col("user_id").alias("doc_id"), "line", "event_type", "event_id")
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("line")) - 1
    vols = base.filter("event_type = 'signup'").select("doc_id", F.col("line").alias("line_num"), idx.alias("volume_idx"))
    chaps = base.filter("event_type <> 'signup'").select("doc_id", F.col("line").alias("start_line"), F.col("line").alias("chapter_index"), "event_id")
    return segmentation.with_volumes(chaps, vols).select(F.col("doc_id").alias("user_id"), "event_id", "volume_idx")


# -- mentions, signals, scores --------------------------------------------------

_COUNT = "(length(text) - length(replace(text, w, ''))) // length(w)"
_WORDS_SQL = "(SELECT unnest(['" + "', '".join(WORDS) + "']) AS w)"


@query(f"""
SELECT conv_id AS book_id, w AS text, cast(sum({_COUNT}) AS BIGINT) AS n, min(turn) AS chapter_index, count(*) AS n_chapters,
       least(0.95::DOUBLE, 0.7::DOUBLE + least(0.25::DOUBLE, sum({_COUNT}) / 80.0::DOUBLE)) AS confidence
FROM conversations, {_WORDS_SQL} WHERE contains(text, w) GROUP BY ALL""")
def exact_mentions(spark, sf):
    names = spark.createDataFrame([(w,) for w in WORDS], "name string")
    out = scanners.exact_mentions(_turns(spark, sf), names)
    return out.select("book_id", "text", "n", "chapter_index", F.size("all_chapters").cast("long").alias("n_chapters"), "confidence")


_HITS = f"""h AS (SELECT conv_id, turn, w, len(regexp_extract_all(lower(text), '\\b' || w || '\\b')) AS c FROM conversations, {_WORDS_SQL}),
p AS (SELECT * FROM h WHERE c > 0), q AS (SELECT conv_id, turn, len(regexp_extract_all(text, '[“「『"][^”」』"]*[”」』"]')) AS quotes FROM conversations),
n AS (SELECT conv_id, turn, count(*) AS k FROM p GROUP BY ALL)"""


@query(f"""WITH {_HITS},
s AS (SELECT p.conv_id, w, sum(c) AS m, sum(ceil(quotes / k)) AS d FROM p JOIN n USING (conv_id, turn) JOIN q USING (conv_id, turn) GROUP BY ALL),
b AS (SELECT conv_id, w FROM (SELECT DISTINCT conv_id FROM conversations), {_WORDS_SQL})
SELECT b.conv_id AS book_id, b.w AS name, cast(coalesce(m, 0) AS BIGINT) AS mention_count, cast(coalesce(d, 0) AS BIGINT) AS dialogue_count FROM b LEFT JOIN s USING (conv_id, w)""")
def mention_counts(spark, sf):
    return scoring.signals(_turns(spark, sf), WORDS).select("book_id", "name", "mention_count", "dialogue_count")


@query(f"""WITH {_HITS} SELECT DISTINCT a.conv_id AS book_id, a.w AS name, b.w AS other FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.w <> b.w""")
def co_occurrence(spark, sf):
    return scoring.signals(_turns(spark, sf), WORDS).select("book_id", "name", F.explode("co_characters").alias("other"))


@query("""
WITH w AS (SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '\\bthe\\b')) AS a, len(regexp_extract_all(lower(coalesce(text, '')), '\\band\\b')) AS b,
                  len(regexp_extract_all(coalesce(text, ''), '[“「『"][^”」』"]*[”」』"]')) AS q FROM documents),
k AS (SELECT *, (CASE WHEN a > 0 THEN 1 ELSE 0 END) + (CASE WHEN b > 0 THEN 1 ELSE 0 END) AS n FROM w)
SELECT doc_id AS book_id, 'the' AS name, cast(CASE WHEN a > 0 THEN ceil(q / n) ELSE 0 END AS BIGINT) AS dialogue_count FROM k WHERE q > 0
UNION ALL SELECT doc_id, 'and', cast(CASE WHEN b > 0 THEN ceil(q / n) ELSE 0 END AS BIGINT) FROM k WHERE q > 0""")
def dialogue_share(spark, sf):
    chaps = _docs(spark, sf).select(F.col("doc_id").alias("book_id"), F.lit(0).alias("chapter_index"), F.coalesce("text", F.lit("")).alias("content"))
    quoted = chaps.filter(F.regexp_count("content", F.lit(scoring.QUOTES)) > 0)
    return scoring.signals(quoted, ["the", "and"]).select("book_id", "name", "dialogue_count")


def _event_mentions(spark, sf) -> DataFrame:
    """Events as mentions: the user is the book, the type the text, the day the chapter."""
    ev = _t(spark, sf, "events")
    day = F.datediff("ts", F.lit("2024-01-01"))
    return ev.select(F.col("user_id").alias("book_id"), F.lit("event").alias("type"), F.col("event_type").alias("text"), day.alias("chapter_index"), F.lit(0).alias("position"), (F.pmod(F.col("event_id"), F.lit(97)) / 97.0).alias("confidence"), F.col("event_id").alias("seq"))


_MENTIONS = "m AS (SELECT user_id AS book_id, event_type AS text, cast(date_diff('day', DATE '2024-01-01', cast(ts AS DATE)) AS BIGINT) AS d, (event_id % 97) / 97.0::DOUBLE AS confidence, event_id AS seq FROM events)"


@query(f"""WITH {_MENTIONS}
SELECT book_id, text, max(confidence) AS confidence, max(struct_pack(c := confidence, s := seq)).s AS seq, count(*) AS total_count, count(DISTINCT d) AS n_chapters
FROM m GROUP BY ALL HAVING max(confidence) >= 0.6""")
def grouped_mentions(spark, sf):
    return scoring.grouped(_event_mentions(spark, sf)).select("book_id", "text", "confidence", "seq", "total_count", F.size("all_chapters").cast("long").alias("n_chapters"))


def _days(spark, sf) -> DataFrame:
    """The chapters of ``_event_mentions``: every day from the first to the last of all."""
    m = _event_mentions(spark, sf)
    span = m.agg(F.min("chapter_index").alias("lo"), F.max("chapter_index").alias("hi"))
    return m.select("book_id").distinct().crossJoin(F.broadcast(span)).select("book_id", F.explode(F.sequence("lo", "hi")).alias("chapter_index")).withColumn("content", F.lit(""))


_SPREAD = f"{_MENTIONS}, e AS (SELECT DISTINCT book_id, text, d FROM m WHERE (book_id, text) IN (SELECT (book_id, text) FROM m GROUP BY ALL HAVING max(confidence) >= 0.6)), n AS (SELECT max(d) - min(d) + 1 AS n FROM m)"


@query(f"""WITH {_SPREAD}, p AS (SELECT book_id, text, d / greatest(1, n - 1) AS p FROM e, n)
SELECT book_id, text, min(p) AS first_position, max(p) AS last_position, round(avg(p), 9) AS avg_position, round(least(1.0, 10 * var_pop(p)), 9) AS position_variance FROM p GROUP BY ALL""")
def position_features(spark, sf):
    ent = scoring.grouped(_event_mentions(spark, sf))
    out = scoring.position_features(ent, _days(spark, sf))
    return out.select("book_id", "text", "first_position", "last_position", F.round("avg_position", 9).alias("avg_position"), F.round("position_variance", 9).alias("position_variance"))


@query(f"""WITH {_SPREAD},
g AS (SELECT book_id, text, d, d - row_number() OVER w AS run, d - lag(d) OVER w AS gap FROM e WINDOW w AS (PARTITION BY book_id, text ORDER BY d)),
r AS (SELECT book_id, text, run, count(*) AS k FROM g GROUP BY ALL),
a AS (SELECT book_id, text, count(*) AS chapter_count, stddev_pop(gap) AS s FROM g GROUP BY ALL)
SELECT a.book_id, a.text, chapter_count, (SELECT max(k) FROM r WHERE r.book_id = a.book_id AND r.text = a.text) AS max_run, chapter_count / n AS coverage,
       round(CASE WHEN chapter_count <= 1 THEN 0 ELSE greatest(0, 1 - s / (n / chapter_count)) END, 6) AS uniformity
FROM a, n""")
def distribution_breadth(spark, sf):
    out = scoring.breadth(scoring.grouped(_event_mentions(spark, sf)), _days(spark, sf))
    return out.select("book_id", "text", "chapter_count", "max_run", "coverage", F.round("uniformity", 6).alias("uniformity"))


@query(f"""WITH {_SPREAD}, k AS (SELECT book_id, text, count(*) AS k FROM e GROUP BY ALL), x AS (SELECT book_id, text, k / n AS p FROM k, n)
SELECT book_id, text, round(p, 9) AS mean, round(sqrt(p * (1 - p)), 9) AS std,
       round(CASE WHEN p * (1 - p) = 0 THEN 0 ELSE (p * (1 - p) ** 4 + (1 - p) * p ** 4) / (p * (1 - p)) ** 2 - 3 END, 6) AS kurtosis,
       round(CASE WHEN p * (1 - p) = 0 THEN 0 ELSE (p * (1 - p) ** 3 - (1 - p) * p ** 3) / (p * (1 - p)) ** 1.5 END, 6) AS skewness FROM x""")
def presence_moments(spark, sf):
    out = scoring.basic_stats(scoring.grouped(_event_mentions(spark, sf)), _days(spark, sf))
    return out.select("book_id", "text", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), F.round("kurtosis", 6).alias("kurtosis"), F.round("skewness", 6).alias("skewness"))


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), m AS (SELECT user_id, avg(c) AS mu FROM c GROUP BY ALL)
SELECT user_id, round(any_value(mu), 9) AS mean, round(sqrt(avg((c - mu) ** 2)), 9) AS std,
       round(CASE WHEN avg((c - mu) ** 2) = 0 THEN 0 ELSE avg((c - mu) ** 4) / avg((c - mu) ** 2) ** 2 - 3 END, 6) AS kurtosis,
       round(CASE WHEN avg((c - mu) ** 2) = 0 THEN 0 ELSE avg((c - mu) ** 3) / avg((c - mu) ** 2) ** 1.5 END, 6) AS skewness
FROM c JOIN m USING (user_id) GROUP BY user_id""")
def moments(spark, sf):
    counts = _t(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("c"))
    out = scoring.moments(counts, ["user_id"], "c")
    return out.select("user_id", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), F.round("kurtosis", 6).alias("kurtosis"), F.round("skewness", 6).alias("skewness"))


@query("""WITH c AS (SELECT event_type, user_id, count(*) AS total_count FROM events GROUP BY ALL)
SELECT event_type, user_id, total_count, round(cume_dist() OVER (PARTITION BY event_type ORDER BY total_count), 9) AS rank FROM c""")
def cume_rank(spark, sf):
    rows = _t(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("total_count"))
    return rows.withColumn("rank", F.round(scoring.percentile_rank(["event_type"]), 9))


@query("""
WITH c AS (SELECT event_type, user_id, count(*) AS n, count(DISTINCT cast(ts AS DATE)) / 30.0::DOUBLE AS cov FROM events GROUP BY ALL)
SELECT a.event_type, cast(a.user_id AS VARCHAR) AS text, round(greatest(0.5::DOUBLE, 1 - 0.1::DOUBLE * count(b.user_id)), 9) AS substitutability
FROM c a LEFT JOIN c b ON a.event_type = b.event_type AND a.user_id <> b.user_id AND abs(a.n - b.n) <= 2 AND abs(a.cov - b.cov) < 0.1 GROUP BY ALL""")
def substitutability(spark, sf):
    rows = _t(spark, sf, "events").groupBy("event_type", F.col("user_id").cast("string").alias("text")).agg(F.count("*").alias("total_count"), (F.countDistinct(F.to_date("ts")) / 30.0).alias("coverage"))
    return scoring.substitutability(rows, ["event_type"]).withColumn("substitutability", F.round("substitutability", 9))


@query("""
WITH b AS (SELECT DISTINCT conv_id, turn, unnest(list_transform(range(1, length(text)), lambda i: substr(text, i, 2))) AS b FROM conversations WHERE length(text) >= 2),
s AS (SELECT DISTINCT conv_id, turn, b FROM b WHERE regexp_matches(b, '^[a-z]{2}$')), n AS (SELECT conv_id, b, count(*) AS n FROM s GROUP BY ALL)
SELECT conv_id AS book_id, turn AS chapter_index, count(*) AS bigrams, count(*) FILTER (n.n = 1) AS unique_bigrams FROM s JOIN n USING (conv_id, b) GROUP BY ALL""")
def unique_bigrams(spark, sf):
    """Letter pairs of a turn that no other turn of its conversation has."""
    rows = _turns(spark, sf).select("book_id", F.col("chapter_index").cast("long").alias("chapter_index"), F.explode(scoring.bigrams(F.col("content"), "[a-z]{2}")).alias("b"))
    n = rows.groupBy("book_id", "b").agg(F.count("*").alias("n"))
    return rows.join(n, ["book_id", "b"]).groupBy("book_id", "chapter_index").agg(F.count("*").alias("bigrams"), F.count_if(F.col("n") == 1).alias("unique_bigrams"))


@query("""
SELECT s_suppkey, round(0.7 * v + 0.3 * p, 9) AS importance, CASE WHEN score >= 5 THEN 'core' WHEN score >= 3 THEN 'supporting' WHEN score >= 1 THEN 'candidate' ELSE 'archived' END AS story_tier,
       CASE WHEN 0.7 * v + 0.3 * p >= 0.7 AND p >= 0.3 THEN 'core' WHEN 0.7 * v + 0.3 * p >= 0.5 AND p >= 0.2 THEN 'supporting' WHEN 0.7 * v + 0.3 * p >= 0.3 THEN 'candidate' ELSE 'archived' END AS route_tier
FROM (SELECT s_suppkey, s_suppkey % 7 AS score, ([0, 0.17, 0.33, 0.5, 0.67, 0.83, 1])[s_suppkey % 7 + 1] AS v, (s_suppkey % 10) / 10.0 AS p FROM supplier)""")
def importance_tiers(spark, sf):
    rows = _t(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 7).cast("int").alias("score"), ((F.col("s_suppkey") % 10) / 10.0).alias("p"))
    imp = 0.7 * scoring.story_value(F.col("score")) + 0.3 * F.col("p")
    return rows.select("s_suppkey", F.round(imp, 9).alias("importance"), scoring.story_tier(F.col("score")).alias("story_tier"), scoring.tier(imp, F.col("p")).alias("route_tier"))


@query("""
WITH t AS (SELECT p_partkey, p_name, unnest(string_split(p_name, ' ')) AS w FROM part),
n AS (SELECT w AS text, count(*) AS n FROM t GROUP BY w HAVING count(*) >= 5)
SELECT text, n, row_number() OVER (ORDER BY n DESC, length(text) DESC, text) AS rank FROM n QUALIFY rank <= 160""")
def frequent_terms(spark, sf):
    terms = _t(spark, sf, "part").select(F.lit("parts").alias("book_id"), F.explode(F.split("p_name", " ")).alias("text"))
    names = terms.groupBy("book_id", "text").agg(F.count("*").alias("n"))
    names = names.filter("n >= 5").withColumns({"first": F.struct(F.lit(0).alias("chapter_index"), F.col("text").alias("position")), "all_chapters": F.array(F.lit(0))})
    return scanners.ranked_names(names).select("text", "n", F.col("rank").cast("long").alias("rank"))


# -- resolution and validation --------------------------------------------------


@query("""
WITH d AS (SELECT md5(coalesce(text, '')) AS key, doc_id, n_chars / 1000.0 AS confidence FROM documents)
SELECT key, max(confidence) AS confidence, arg_max(doc_id, confidence * 1e9 - doc_id) AS doc_id, count(*) - 1 AS n_duplicates FROM d GROUP BY key""")
def entity_dedup(spark, sf):
    rows = _docs(spark, sf).select(F.md5(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("key"), "doc_id", (F.col("n_chars") / 1000.0).alias("confidence"))
    return resolution.best_of_duplicates(rows, ["key"], "doc_id")


@query("""
SELECT lower(trim(c_mktsegment)) AS key, max(c_acctbal) AS confidence, count(*) AS n FROM customer GROUP BY ALL""")
def same_name_dedup(spark, sf):
    rows = _t(spark, sf, "customer").select(F.lit(0).alias("book_id"), F.col("c_custkey").alias("seq"), F.col("c_mktsegment").alias("name"), F.col("c_acctbal").alias("confidence"), F.array().cast("array<string>").alias("aliases"), F.array().cast("array<int>").alias("chapter_appearances"))
    return resolution.same_name(rows).select("key", "confidence", "n")


@query("""
SELECT c_custkey AS id, (CASE WHEN c_acctbal < 0.3 THEN 1 ELSE 0 END)::BIGINT + (CASE WHEN trim(c_mktsegment) = '' THEN 1 ELSE 0 END)::BIGINT AS n_errors,
       NOT (c_acctbal < 0.3) AND trim(c_mktsegment) <> '' AS valid FROM customer""")
def validation_rules(spark, sf):
    rows = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("confidence"), F.col("c_mktsegment").alias("description"), F.array(F.lit(1)).alias("chapter_appearances"), F.array().cast("array<string>").alias("aliases"), F.col("c_name").alias("name"))
    out = validation.validate(rows)
    return out.select("id", F.when(F.col("errors") == "", 0).otherwise(F.size(F.split("errors", "; "))).alias("n_errors"), "valid")


@query("SELECT c_custkey AS id FROM customer WHERE NOT (c_custkey % 3 = 0 AND c_custkey % 5 = 0)")
def hallucination_filter(spark, sf):
    rows = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 3).alias("mention_count"), (F.col("c_custkey") % 5).alias("dialogue_count"))
    return resolution.hallucination_free(rows).select("id")


@query("""
WITH k AS (SELECT DISTINCT o_custkey AS a, l_suppkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT c.c_custkey AS id, min(b) AS first_supplier, count(b) AS suppliers FROM customer c LEFT JOIN k ON k.a = c.c_custkey GROUP BY ALL""")
def left_enrich(spark, sf):
    pairs = _t(spark, sf, "orders").join(_t(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    sums = pairs.groupBy("a").agg(F.min("b").alias("first_supplier"), F.count("b").alias("suppliers"))
    rows = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(sums, F.col("id") == F.col("a"), "left")
    return rows.select("id", "first_supplier", F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("""
WITH p AS (SELECT c_custkey AS k, 'c' || c_custkey AS name, c_acctbal AS v FROM customer), s AS (SELECT s_suppkey AS k, 'C' || s_suppkey AS name, s_acctbal AS v FROM supplier)
SELECT coalesce(p.name, s.name) AS name, coalesce(p.v, s.v) AS v FROM s FULL OUTER JOIN p ON lower(s.name) = lower(p.name)""")
def payload_merge(spark, sf):
    p = _t(spark, sf, "customer").select(F.lit(0).alias("book_id"), F.col("c_custkey").alias("seq"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"), F.col("c_acctbal").alias("v"))
    s = _t(spark, sf, "supplier").select(F.lit(0).alias("book_id"), F.col("s_suppkey").alias("seq"), F.concat(F.lit("C"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_acctbal").alias("v"))
    return resolution.payload_first(p, s, ["name", "v"]).select("name", "v")


# -- graph ----------------------------------------------------------------------


def _edges(spark, sf) -> DataFrame:
    """Customers and suppliers that trade, the order's priority as type, its month as chapter."""
    kinds = F.create_map(*[F.lit(x) for k, v in zip(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), relations.TYPES, strict=False) for x in (k, v)])
    o = _t(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.element_at(kinds, F.col("o_orderpriority")).alias("type"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("chapter"))
    li = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"), F.col("l_discount"))
    rows = o.join(li, "o_orderkey").withColumn("type", F.coalesce("type", F.lit("unknown")))
    return rows.groupBy(F.lit(0).alias("book_id"), "source", "target", "type").agg(F.max("l_discount").alias("confidence"), F.min("chapter").alias("chapter_first"), F.max("chapter").alias("chapter_last"))


_EDGES = """e AS (
  SELECT 'c' || o_custkey AS source, 's' || l_suppkey AS target,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'family' WHEN '2-HIGH' THEN 'romantic' WHEN '3-MEDIUM' THEN 'friendship' WHEN '4-NOT SPECIFIED' THEN 'antagonistic' WHEN '5-LOW' THEN 'professional' ELSE 'unknown' END AS type,
         max(l_discount) AS confidence, cast(min(year(o_orderdate) * 12 + month(o_orderdate)) AS BIGINT) AS chapter_first, cast(max(year(o_orderdate) * 12 + month(o_orderdate)) AS BIGINT) AS chapter_last
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""


@query(f"WITH {_EDGES} SELECT source, target, type, confidence, chapter_first, chapter_last FROM e WHERE source = 'c7' AND confidence >= 0.02 AND chapter_first <= 23968 AND chapter_last >= 23900")
def edge_query(spark, sf):
    return relations.query(_edges(spark, sf), node="c7", least=0.02, chapters=(23900, 23968)).drop("book_id")


@query(f"WITH {_EDGES} SELECT source, target, type, chapter_first FROM e WHERE source = 'c7' AND target IN (SELECT min(target) FROM e WHERE source = 'c7')")
def timeline(spark, sf):
    e = _edges(spark, sf)
    other = e.filter("source = 'c7'").agg(F.min("target")).first()[0]
    return relations.timeline(e, "c7", other or "").select("source", "target", "type", "chapter_first")


@query(f"WITH {_EDGES} SELECT (SELECT count(*) FROM customer) AS nodes, count(*) AS edges, " + ", ".join(f"count(*) FILTER (type = '{t}') AS n_{t}" for t in relations.TYPES) + " FROM e")
def graph_stats(spark, sf):
    nodes = _t(spark, sf, "customer").select(F.lit(0).alias("book_id"), "c_custkey")
    return relations.stats(_edges(spark, sf), nodes).drop("book_id")


@query(f"""WITH {_EDGES}, f AS (SELECT source, target, confidence FROM e WHERE type = 'friendship' UNION SELECT target, source, confidence FROM e WHERE type = 'friendship'),
t AS (SELECT a.source AS id, b.target, 0.5 * max(a.confidence) AS confidence FROM f a JOIN f b ON a.target = b.source WHERE a.source IN ('c1', 'c2', 'c3', 'c4', 'c5') AND a.source <> b.target GROUP BY ALL)
SELECT id, target, confidence FROM t WHERE target NOT IN ('c1', 'c2', 'c3', 'c4', 'c5')""")
def friend_of_friend(spark, sf):
    nodes = spark.createDataFrame([(0, f"c{k}") for k in range(1, 6)], "book_id int, id string")
    return relations.friends_of_friends(_edges(spark, sf), nodes).select("id", "target", "confidence")


@query(r"""
WITH s AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[。！？；.!?;\n]+')) AS s, generate_subscripts(regexp_split_to_array(text, '[。！？；.!?;\n]+'), 1) AS i FROM conversations),
f AS (SELECT conv_id, turn, i, s, list_filter(['the', 'and', 'that'], lambda w: contains(lower(s), w)) AS names FROM s),
p AS (SELECT conv_id, turn, i, s, unnest(names) AS source, names FROM f WHERE len(names) >= 2),
q AS (SELECT conv_id, turn, i, s, source, unnest(names) AS target FROM p),
v AS (SELECT *, CASE WHEN contains(lower(s), 'with') THEN 0.85::DOUBLE ELSE 0.3::DOUBLE END AS c FROM q WHERE source <> target)
SELECT conv_id AS book_id, source, target, round(least(0.99::DOUBLE, arg_min(c, turn * 100000 + i) + 0.1::DOUBLE * (count(*) - 1)), 9) AS confidence, cast(min(turn) AS BIGINT) AS chapter_first, cast(max(turn) AS BIGINT) AS chapter_last, count(*) AS n
FROM v GROUP BY ALL""")
def sentence_edges(spark, sf):
    found = relations.evidence(relations.sentence_mentions(_turns(spark, sf), ["the", "and", "that"]), {"friendship": {"explicit": ("with",)}})
    out = relations.edges(found)
    return out.select("book_id", "source", "target", F.round("confidence", 9).alias("confidence"), "chapter_first", "chapter_last", "n")


# -- narrative ------------------------------------------------------------------


@query("""
WITH o AS (SELECT user_id, event_id, ts, event_type, lag(ts) OVER w AS pt, lag(event_type) OVER w AS pe FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CASE WHEN pt IS NULL OR ts - pt > INTERVAL 1 DAY OR (event_type = 'error' AND pe <> 'error') THEN 1 ELSE 0 END AS b FROM o),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS arc FROM s)
SELECT user_id, cast(arc AS BIGINT) AS arc, count(*) AS n_events, min(event_id) AS first_event FROM g GROUP BY ALL""")
def arc_sessions(spark, sf):
    ev = _t(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce(F.col("ts") - F.lag("ts").over(w) > F.expr("interval 1 day"), F.lit(False))
    rows = narrative.arc_breaks(ev.withColumn("g", gap), ["user_id"], ["ts", "event_id"], F.col("g"), F.col("event_type") == "error")
    return rows.groupBy("user_id", "arc").agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_event"))


@query("""
WITH r AS (SELECT conv_id, turn, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 + 1 AS segment FROM conversations)
SELECT conv_id AS book_id, cast(segment AS BIGINT) AS segment, cast(min(turn) AS BIGINT) AS start_chapter, cast(max(turn) AS BIGINT) AS end_chapter, count(*) AS n_chapters,
       CASE WHEN count(*) > 1 THEN 0.78::DOUBLE ELSE 0.68::DOUBLE END AS boundary_confidence, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_md5
FROM r GROUP BY ALL""")
def chunk_segments(spark, sf):
    out = narrative.chunk_segments(_turns(spark, sf), 3)
    return out.select("book_id", "segment", "start_chapter", "end_chapter", "n_chapters", "boundary_confidence", F.md5(F.encode("source_text", "utf-8")).alias("text_md5"))


@query("""
WITH s AS (SELECT user_id AS book_id, event_id, event_type, (event_id % 40) / 40.0 AS c, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT *, lag(event_id) OVER w AS prev_id, lag(event_type) OVER w AS pt FROM s WINDOW w AS (PARTITION BY book_id ORDER BY n))
SELECT book_id, event_id AS segment_id, CASE WHEN prev_id IS NOT NULL AND pt = event_type AND c < 0.72 THEN 'merge_with_previous' ELSE 'confirm' END AS suggestion,
       (CASE WHEN pt = event_type THEN 1 ELSE 0 END)::BIGINT AS n_shared FROM p WHERE c < 0.82""")
def boundary_reviews(spark, sf):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    seg = _t(spark, sf, "events").select(F.col("user_id").alias("book_id"), F.col("event_id").alias("segment_id"), n.alias("start_chapter"), n.alias("end_chapter"), ((F.col("event_id") % 40) / 40.0).alias("boundary_confidence"), F.array("event_type").alias("main_characters"))
    return narrative.boundary_reviews(seg).select("book_id", "segment_id", "suggestion", "n_shared")


@query("""
WITH r AS (SELECT c_custkey AS id, c_custkey * 3 AS lo, c_custkey * 3 + 40 AS hi FROM customer)
SELECT id, event_id, row_number() OVER (PARTITION BY id ORDER BY value DESC, event_id) AS ord FROM events JOIN r ON event_id BETWEEN lo AND hi""")
def range_join_mentions(spark, sf):
    ranges = _t(spark, sf, "customer").select(F.lit(0).alias("book_id"), F.col("c_custkey").alias("id"), (F.col("c_custkey") * 3).alias("start_chapter"), (F.col("c_custkey") * 3 + 40).alias("end_chapter"))
    m = _t(spark, sf, "events").select(F.lit(0).alias("book_id"), F.col("event_id").alias("chapter_index"), F.col("value").alias("confidence"), F.lit("").alias("text"))
    return narrative.in_chapters(m, ranges, "id").select("id", F.col("chapter_index").alias("event_id"), F.col("ord").cast("long").alias("ord"))


@query("""
WITH b AS (SELECT conv_id AS book_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, text FROM conversations),
h AS (SELECT book_id, i, 0 AS k FROM b WHERE i < 0.15 * n AND contains(text, 'the') UNION ALL SELECT * FROM (SELECT book_id, min(i) AS i, 1 FROM b WHERE i >= 0.4 * n AND i <= 0.6 * n AND contains(text, 'that') GROUP BY book_id)
      UNION ALL SELECT book_id, i, 2 FROM b WHERE i >= 0.7 * n AND contains(text, 'and'))
SELECT book_id, i, (['INCITING', 'MIDPOINT', 'CLIMAX'])[k + 1] AS type FROM h""")
def turning_points(spark, sf):
    words = {"INCITING": ("the",), "MIDPOINT": ("that",), "CLIMAX": ("and",)}
    return narrative.turning_points(_turns(spark, sf), words).select("book_id", F.col("i").cast("long").alias("i"), "type")


@query("""
WITH b AS (SELECT conv_id AS book_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT book_id, count(*) FILTER (i / n < 0.25) AS act1, count(*) FILTER (i / n >= 0.25 AND i / n < 0.75) AS act2, count(*) FILTER (i / n >= 0.75) AS act3 FROM b GROUP BY book_id""")
def three_acts(spark, sf):
    chaps = _turns(spark, sf)
    none = narrative.turning_points(chaps, {"INCITING": ("\x00",), "MIDPOINT": ("\x00",), "CLIMAX": ("\x00",)})
    return narrative.act_summary(narrative.acts(chaps, none), none).select("book_id", "act1", "act2", "act3")


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3""")
def top_per_group(spark, sf):
    return tables.top(_t(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


# -- tables and exports ---------------------------------------------------------


@query("""SELECT d.doc_id, l.quality::BIGINT AS quality, l.toxic::BIGINT AS toxic, d.n_chars FROM labels l JOIN documents d USING (doc_id) WHERE l.quality = 1""")
def review_status(spark, sf):
    rows = _t(spark, sf, "labels").join(_docs(spark, sf), "doc_id")
    return tables.by_book(rows, quality=1).select("doc_id", "quality", "toxic", "n_chars")


@query("""
WITH t AS (SELECT user_id AS book_id, event_type AS stage, CASE WHEN event_id % 3 = 0 THEN 'COMPLETED' WHEN event_id % 3 = 1 THEN 'RUNNING' ELSE 'FAILED' END AS status FROM events),
w AS (SELECT book_id, status, CASE stage WHEN 'click' THEN 25 WHEN 'view' THEN 10 WHEN 'purchase' THEN 15 ELSE 0 END AS w FROM t)
SELECT book_id, sum(CASE status WHEN 'COMPLETED' THEN w WHEN 'RUNNING' THEN w * 0.5 ELSE 0 END)::DOUBLE AS progress, bool_or(status = 'FAILED') AS failed, bool_and(status = 'COMPLETED') AS completed FROM w GROUP BY book_id""")
def stage_progress(spark, sf):
    k = F.col("event_id") % 3
    tasks = _t(spark, sf, "events").select(F.col("user_id").alias("book_id"), F.col("event_type").alias("stage"), F.when(k == 0, "COMPLETED").when(k == 1, "RUNNING").otherwise("FAILED").alias("status"), F.lit(False).alias("dead_lettered"))
    return tables.stage_progress(tasks, {"click": 25, "view": 10, "purchase": 15})


@query("""WITH m AS (SELECT max(ts) AS t FROM events) SELECT event_id AS id FROM events, m WHERE event_type = 'click' AND ts < t - INTERVAL 6 HOUR""")
def stuck_tasks(spark, sf):
    ev = _t(spark, sf, "events")
    now = ev.agg(F.max("ts")).first()[0]
    tasks = ev.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "RUNNING").otherwise("DONE").alias("status"), F.col("ts").alias("updated_at"))
    return tables.stuck(tasks, F.lit(now), 6 * 3600).select("id")


@query("""SELECT event_id AS id FROM events WHERE event_type = 'view' ORDER BY ts, event_id LIMIT 1""")
def oldest_pending(spark, sf):
    tasks = _t(spark, sf, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "PENDING").otherwise("DONE").alias("status"), F.col("ts").alias("created_at"))
    return tables.oldest_pending(tasks).select("id")


@query("""
SELECT user_id AS book_id, event_type AS line_num, coalesce(max(event_id) FILTER (event_id % 2 = 1), max(event_id)) AS event_id FROM events GROUP BY ALL""")
def override_upsert(spark, sf):
    rows = _t(spark, sf, "events").select(F.col("user_id").alias("book_id"), F.col("event_type").alias("line_num"), "event_id")
    return tables.upserted(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), ["book_id", "line_num"], "event_id")


@query("""SELECT c_custkey AS id FROM customer WHERE contains(lower(c_mktsegment), 'build')""")
def entity_search(spark, sf):
    rows = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), F.col("c_acctbal").alias("confidence"), F.array().cast("array<string>").alias("aliases"))
    return tables.searched(rows, "build").select("id")


@query("""SELECT event_type, cast(user_id AS VARCHAR) AS status, count(*) AS n FROM events GROUP BY ALL""")
def group_report(spark, sf):
    return _t(spark, sf, "events").groupBy("event_type", F.col("user_id").cast("string").alias("status")).agg(F.count("*").alias("n"))


@query("""
SELECT c_nationkey::BIGINT AS book_id, c_name || ',' || CASE WHEN contains(c_mktsegment, 'E') THEN '"x, ' || c_mktsegment || '"' ELSE 'x; y' END || ',,' || printf('%.3f', c_acctbal) || ',,' || c_custkey || ',,,core,' || printf('%.3f', c_acctbal) || ',0,0,0' AS line
FROM (SELECT *, 1 AS one FROM customer)""")
def csv_export(spark, sf):
    rows = _t(spark, sf, "customer").select(
        F.col("c_nationkey").alias("book_id"), F.col("c_name").alias("name"), F.when(F.contains("c_mktsegment", F.lit("E")), F.array(F.concat(F.lit("x, "), "c_mktsegment"))).otherwise(F.array(F.lit("x"), F.lit("y"))).alias("aliases"),
        F.col("c_acctbal").alias("confidence"), F.col("c_custkey").alias("mention_count"), F.lit("core").alias("tier"), F.col("c_acctbal").alias("importance_score"),
    )
    return exports.csv_lines(rows, "location")


@query("""
WITH e AS (SELECT user_id AS book_id, event_type, cast(event_id AS VARCHAR) AS run_id, ts FROM events WHERE event_type <> 'error')
SELECT book_id, run_id, row_number() OVER (PARTITION BY book_id ORDER BY ts DESC, run_id) = 1 AS current FROM e""")
def run_discovery(spark, sf):
    rows = _t(spark, sf, "events").select(F.col("user_id").alias("book_id"), F.col("event_id").cast("string").alias("run_id"), F.col("ts").alias("generated_at"), (F.col("event_type") != "error").alias("official"))
    return exports.runs(rows).select("book_id", "run_id", "current")


@query("""
WITH m AS (SELECT DISTINCT user_id, event_type, cast(date_diff('day', DATE '2024-01-01', cast(ts AS DATE)) AS BIGINT) AS d FROM events)
SELECT user_id AS book_id, d AS chapter_index, event_type AS text, 'regex' AS source, 0.5::DOUBLE AS confidence FROM m""")
def mention_round_trip(spark, sf):
    """Mentions written as pipe-separated lines and parsed back."""
    m = _event_mentions(spark, sf).withColumns({"source": F.lit("regex"), "confidence": F.lit(0.5)})
    lines = text_files.mention_lines(m)
    return text_files.parsed_mentions(lines.select("book_id", "line")).select("book_id", "chapter_index", "text", "source", "confidence")


@query("""SELECT doc_id, coalesce(json_extract_string(p, '$.n'), '0')::BIGINT AS n FROM (SELECT doc_id, '{"n": ' || n_chars || '}' AS p FROM documents)""")
def model_salvage(spark, sf):
    """Answers with prose and fences around their JSON, parsed by a schema."""
    rows = _docs(spark, sf).select("doc_id", F.concat(F.lit("<think>{\"n\": 1}</think> Here it is: ```json\n{\"n\": "), F.col("n_chars").cast("string"), F.lit("}\n``` thanks")).alias("answer"))
    return model.parsed(rows, "n long").select("doc_id", F.coalesce("parsed.n", F.lit(0)).alias("n"))


@query("""
WITH s AS (SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) * 2 AS f FROM conversations), b AS (SELECT conv_id, turn, f + 1 AS n FROM s UNION ALL SELECT conv_id, turn, f + 2 FROM s),
k AS (SELECT conv_id, count(*) AS k FROM b GROUP BY ALL)
SELECT conv_id AS story_id, n AS clip_no, turn AS scene_no, (['establishing', 'wide', 'medium', 'close_up', 'insert', 'reaction'])[(n - 1) % 6 + 1] AS shot_type, greatest(4, cast(floor(90 / k + 0.5) AS BIGINT)) AS duration_s
FROM b JOIN k USING (conv_id)""")
def storyboard_clips(spark, sf):
    scenes = _t(spark, sf, "conversations").select(F.col("conv_id").alias("story_id"), F.col("turn").alias("scene_no"), F.lit("walks").alias("action"), F.lit("hello").alias("line"), F.col("role").alias("emotion"))
    frames = assembly.storyboard(scenes)
    cl = assembly.clips(frames)
    return cl.join(frames.select("story_id", F.col("frame_no").alias("clip_no"), "shot_type"), ["story_id", "clip_no"]).select("story_id", F.col("clip_no").cast("long").alias("clip_no"), "scene_no", "shot_type", "duration_s")


@query(r"""
WITH p AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '\b(?:he|his|him|she|hers|her|it|its)\b') AS m FROM conversations)
SELECT conv_id::VARCHAR AS book_id, cast(turn AS BIGINT) AS chapter_index, len(m) AS n FROM p WHERE len(m) > 0""")
def pronoun_counts(spark, sf):
    found = coreference.pronouns(_turns(spark, sf))
    return found.groupBy("book_id", "chapter_index").agg(F.count("*").alias("n"))


@query()
def nearest_antecedent(spark, sf):
    """The surest of three words before each pronoun of a turn (an as-of window over offsets; the tests compare it with a scan)."""
    chaps = _turns(spark, sf)
    return coreference.antecedents(coreference.pronouns(chaps), coreference.names_found(chaps, ["the", "and", "that"]), ["the", "and", "that"])


@query()
def resolve_suppliers(spark, sf):
    """Suppliers as characters, resolved by the ordered walk (its fold is compared with literals in the tests)."""
    rows = _t(spark, sf, "supplier").select(
        (F.col("s_nationkey") % 5).cast("string").alias("book_id"), F.col("s_suppkey").alias("seq"), F.concat(F.lit("S"), (F.col("s_suppkey") % 40).cast("string")).alias("name"), F.array(F.concat(F.lit("alias"), (F.col("s_suppkey") % 60).cast("string"))).alias("aliases"),
        F.lit(None).cast("string").alias("description"), (F.col("s_acctbal") / 10000).alias("confidence"), F.lit(1).alias("first_chapter"), F.col("s_nationkey").cast("int").alias("last_chapter"), F.array(F.col("s_nationkey").cast("int")).alias("chapter_appearances"),
        F.lit(1).cast("long").alias("mention_count"), F.lit(0).cast("long").alias("dialogue_count"), F.array().cast("array<string>").alias("co_characters"), F.array().cast("array<struct<description: string, scene: string, first_chapter: int, last_chapter: int>>").alias("outfits"),
    )
    return resolution.resolve(rows).select("book_id", "seq", "name", "confidence", "mention_count", "merged")


@query("""
WITH e AS (SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT cast(user_id AS VARCHAR) AS book_id, event_type AS stage, event_id AS last_event FROM e WHERE n = 1""")
def last_status(spark, sf):
    """The streaming aggregate's batch form: the latest event of each stage."""
    rows = _t(spark, sf, "events").select(F.col("user_id").cast("string").alias("book_id"), F.col("event_type").alias("stage"), F.col("event_id").alias("status"), F.struct("ts", "event_id").alias("ts"))
    return progress.last_status(rows).select("book_id", "stage", F.col("status").alias("last_event"))


@query()
def outline_tree(spark, sf):
    """Chapters, volumes and line types of cleaned documents (headings are rare there, so most come in fixed pieces)."""
    return prescan.outline(_docs(spark, sf)).select("doc_id", "chapter_index", "mode", "word_count", "volume_idx", "number", "line_type", "flat_index")
