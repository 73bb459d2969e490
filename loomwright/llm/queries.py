"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, filter_audit, langid, mixing, multi_index, near_dedup, packing, prefix_trie, quality, secret_scan, token_output, url_filter, warc
from .common import documents, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = documents(spark, sf_dir)
    return langid.identify(docs.select("doc_id", "text", "lang")).select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = mixing.domains_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = mixing.mix(documents(spark, sf_dir).select("doc_id", "text"), labels, mixing.DOMAINS, mixing.TARGETS, columns=["doc_id"])
    return out.select("doc_id", "n_tokens", *[F.col("posteriors")[k].alias(f"p_{d}") for k, d in enumerate(mixing.DOMAINS)], "rate")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(documents(spark, sf_dir))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), percent=85)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES |= {f.__name__: f for f in (op1_language_id, op2_source_mixing, op3_exact_dedup, op4_minhash_near_dedup, op5_secret_scan, op6_best_fit_packing, op7_url_filter, op8_warc, op9_quality_rules, op10_token_output, op11_filter_audit, op12_nearest_neighbours, op13_prefix_trie)}

ORACLE_SQL["op3_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""

ORACLE_SQL["op9_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
tri AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM pos),
hot AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hot, (SELECT unnest([0, 1, 2]) AS k) WHERE hot.n >= 2 GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, text, ws, string_split(text, chr(10)) AS lines, len(ws) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM d JOIN w USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id)),
j AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         10 * n_symbols > 3 * n_words
         OR word_chars > 20 * n_words OR 2 * word_chars < 3 * n_words
         OR 2 * n_dup_lines > length(text) - length(replace(text, chr(10), '')) + 1
         OR 2 * (strlen(text) - strlen(regexp_replace(text, '[a-zA-Z]|[^\x00-\x7F]', '', 'g')))
            < strlen(text) - (length(text) - length(replace(replace(text, ' ', ''), chr(10), '')))
         OR 100 * coalesce(list_max(map_values(list_histogram(ws))), 0) > 30 * n_words
         OR 2 * len(list_filter(ws, lambda x: NOT regexp_matches(x, '[a-zA-Z]|[^\x00-\x7F]'))) > n_words
         OR (n_lines >= 5 AND (10 * len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) > 9 * n_lines
                               OR 2 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\x0D]*$'))) > n_lines)) AS rejected
  FROM (SELECT *, len(lines) AS n_lines FROM m))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM j
"""

ORACLE_SQL["op4_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, array_to_string(ws[i : i + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
    UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(comp.b, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(comp.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.a = d.doc_id
"""

ORACLE_SQL["op8_warc"] = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

ORACLE_SQL["op11_filter_audit"] = r"""
WITH d AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         map {'A': len(ws) < 50, 'B': 100 * len(list_distinct(ws)) < 65 * len(ws),
              'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text),
              'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first_id, false)} AS fails
  FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
r AS (
  SELECT part, filter_order, step, n, good, toxic, fails[filter_order[step]] AS own,
         len(list_filter(range(1, step), lambda k: fails[filter_order[k]])) > 0 AS earlier,
         len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: fails[x])) AS n_failed
  FROM g, steps),
t AS (
  SELECT part, filter_order, step,
         sum(CASE WHEN NOT earlier AND NOT own THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN NOT earlier AND own THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN earlier AND own THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN own AND n_failed = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN NOT earlier AND own AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN NOT earlier AND own AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley
FROM t
"""

ORACLE_SQL["op13_prefix_trie"] = r"""
WITH own AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS x
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda b: ascii(b)::BIGINT)),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda r, k: xor(r >> 1, (r & 1) * 3988292384))), 4294967295) % 6 AS h
  FROM own),
z AS (
  SELECT own.c, list_concat(coalesce(base.x[1 : h], []), own.x[h + 1 :]) AS z
  FROM own JOIN crc USING (c) LEFT JOIN own base ON base.c = own.c - own.c % 100),
p AS (SELECT c, len(z) AS n, z, unnest(range(0, len(z) + 1)) AS d FROM z),
m AS (SELECT c, d, n, md5(z[1 : d]::VARCHAR) AS node, CASE WHEN d > 0 THEN md5(z[1 : d - 1]::VARCHAR) END AS parent, CASE WHEN d > 0 THEN length(z[d].t) ELSE 0 END AS cp FROM p),
nodes AS (
  SELECT d, node, any_value(parent) AS parent, any_value(cp) AS cp, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
  FROM m GROUP BY d, node),
kids AS (SELECT d - 1 AS d, parent AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, node)),
below AS (
  SELECT a.d, a.node, f.d AS bd, f.node AS bnode, any_value(f.n_children) AS k, any_value((f.n_convs - 1) * f.cp) AS w
  FROM m a JOIN m b ON a.c = b.c AND b.d >= a.d JOIN full_ f ON f.d = b.d AND f.node = b.node GROUP BY ALL),
sums AS (SELECT d, node, count(*) FILTER (k = 0) AS n_leaves, sum(w)::BIGINT AS saved_tokens FROM below GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_ f JOIN sums USING (d, node) LEFT JOIN full_ up ON up.d = f.d - 1 AND up.node = f.parent
"""
