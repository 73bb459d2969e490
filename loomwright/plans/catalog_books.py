"""More registered queries: operators of books, over the driver's tables with Chinese phrases put in for frequent words.

The driver's texts hold no Chinese, and the default lexicons nothing else. So each conversation is read as a book whose
frequent short words have been replaced by phrases (``PHRASES``), in Spark and in SQL alike, over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import text as T
from ..operators import assembly, coreference, narrative, noise, relations, resolution, scanners, scoring, segmentation, validation
from ..sources import exports, model, tables, text_files
from ..streaming import progress
from . import catalog, prescan
from .catalog import _t, query

#: Words of the driver's texts and what stands for them.
PHRASES = (
    (" the ", "，李伟说：好。"), (" and ", "。欧阳锋走来，他的剑很快，"), (" of ", "，慕容燕道：走。"), (" la ", "，我是张三，"), (" de ", "他来到青云山，"), (" le ", "，紫金丹入手，"), (" und ", "，京城很大。"), (" der ", "。司马光大人与欧阳锋是朋友，"),
    (" die ", "，\"好\" 王五笑道，"), (" el ", "，碧水洞，法宝。"), (" que ", "。欧阳锋身穿黑袍，面容清秀。"), (" in ", "李伟追杀欧阳锋。"), (" to ", "！药老从戒指里现身，"), (" en ", "；解除婚约。"), (" un ", "。萧炎写下休书，突然"), (" is ", "老者，此人。她看着"),
)
CJK = "[一-鿿]"
_ZH = "text"
for _a, _b in PHRASES:
    _ZH = f"replace({_ZH}, '{_a}', '{_b}')"
#: ``b``: conversation (as text), turn, role and text with phrases.
BOOKS = f"b AS (SELECT cast(conv_id AS VARCHAR) AS book_id, turn AS chapter_index, role AS title, {_ZH} AS content FROM conversations)"


def books(spark, sf) -> DataFrame:
    c = F.col("text")
    for a, b in PHRASES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return _t(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("book_id"), F.col("turn").cast("int").alias("chapter_index"), F.col("role").alias("title"), c.alias("content"))


_known = set(catalog.QUERIES)


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _or(words) -> str:
    return "|".join(words)


def _places(patterns: list[tuple[str, str, str, float]], keep: str) -> str:
    """SQL of ``scan`` rows: (what stands before, the name, what follows, confidence), matched at every place of a text."""
    parts = []
    for k, (before, name, after, confidence) in enumerate(patterns):
        rx = f"^({before})({name})(?:{after})".replace("'", "''")
        parts.append(f"SELECT book_id, chapter_index, regexp_extract(s, '{rx}', 2) AS text, i - 1 + length(regexp_extract(s, '{rx}', 1)) AS position, cast({confidence} AS DOUBLE) AS confidence, {k} AS k FROM p WHERE regexp_matches(s, '{rx}')")
    return f"""{BOOKS}, p AS (SELECT book_id, chapter_index, i, substr(content, i, 140) AS s FROM (SELECT book_id, chapter_index, content, unnest(range(1, length(content) + 1)) AS i FROM b)),
m AS ({' UNION ALL '.join(parts)}),
f AS (SELECT * FROM m WHERE {keep} QUALIFY row_number() OVER (PARTITION BY book_id, chapter_index, text, position ORDER BY k) = 1)"""


_PRE = r"[，。！？；：、\"\s]"
_COMPOUND = f"(?:{_or(lex.COMPOUND_SURNAMES)})"
_VERBS = _or(lex.DIALOGUE_VERBS)
_NAME = f"regexp_matches(text, '^{CJK}{{2,4}}$') AND text NOT IN {_in(lex.NAME_STOP_WORDS)} AND NOT regexp_matches(text, '[{lex.ORG_SUFFIXES}]$') AND NOT regexp_matches(text, '[{lex.BAD_NAME_CHARS}]')"
_FREQUENT = f"{_NAME} AND regexp_matches(text, '^(?:{_COMPOUND}|[{lex.SURNAMES}])')"
_END = r"(?:[，。！？；：、\"\s]|$)"
_SCAN = "SELECT book_id, chapter_index, text, position, confidence FROM f"


def _scanned(rows: DataFrame) -> DataFrame:
    return rows.select("book_id", "chapter_index", "text", "position", "confidence")


@query("WITH " + _places([("", f"{_COMPOUND}{CJK}", "", 0.9), (_PRE, f"{_COMPOUND}{CJK}", _VERBS, 0.85), (_PRE, f"[{lex.SURNAMES}]{CJK}", _VERBS, 0.75), (f"(?:{_or(lex.INTRODUCTIONS)})", f"{CJK}{{2,4}}", _END, 0.85), ("", f"{_COMPOUND}{CJK}", _or(lex.TITLES), 0.75), (r'"[^"]{1,100}"\s*', f"{CJK}{{2,3}}", "说道|道|曰|言|怒道|笑道|喝道", 0.7)], _FREQUENT) + _SCAN)
def scan_characters(spark, sf):
    return _scanned(scanners.scan_characters(books(spark, sf)))


@query("WITH " + _places([("", f"(?:{_or(lex.KNOWN_LOCATIONS)})", "", 0.95), (_PRE, f"{CJK}{{2}}[{lex.LOCATION_SUFFIXES}]", "", 0.8), (f"(?:{_or(lex.DIRECTION_VERBS)})", f"{CJK}{{2,4}}[{lex.DIRECTION_SUFFIXES}]", "", 0.75)], f"length(text) BETWEEN 2 AND 4 AND text NOT IN {_in(lex.LOCATION_STOP_WORDS)} AND NOT regexp_matches(text, '[{lex.BAD_LOCATION_CHARS}]')") + _SCAN)
def scan_locations(spark, sf):
    return _scanned(scanners.scan_locations(books(spark, sf)))


@query("WITH " + _places([(_PRE, f"[{lex.ITEM_DESCRIPTORS}]{CJK}{{1,3}}[{lex.ITEM_SUFFIXES}]", "", 0.8), ("", f"(?:{_or(lex.ITEM_CONTEXT)})", "", 0.5)], "length(text) BETWEEN 2 AND 8") + _SCAN)
def scan_items(spark, sf):
    return _scanned(scanners.scan_items(books(spark, sf)))


# Names of 4, 3 and 2 characters at every place, with a telling neighbourhood and no organisation behind.
_CANDIDATES = f"""{BOOKS}, p AS (SELECT book_id, chapter_index, content, unnest(range(1, length(content) + 1)) AS i FROM b),
c AS (SELECT book_id, chapter_index, i - 1 AS position, n, substr(content, i, n) AS text, substr(content, greatest(1, i - 6), i - greatest(1, i - 6)) AS pre, substr(content, i + n, 6) AS post FROM p, (SELECT unnest([4, 3, 2]) AS n)),
k AS (SELECT * FROM c WHERE length(text) = n AND {_FREQUENT} AND NOT regexp_matches(substr(post, 1, 1), '[{lex.ORG_SUFFIXES}]')
      AND (regexp_matches(right(pre, 2) || substr(post, 1, 2), '[{lex.CONTEXT_CHARS}]') OR regexp_matches(pre || text || post, '{_or(lex.DIALOGUE_VERBS + lex.TITLES)}'))),
g AS (SELECT book_id, text, count(*) AS n, min(struct_pack(c := chapter_index, p := position, l := -n)) AS first, count(DISTINCT chapter_index) AS n_chapters FROM k GROUP BY ALL HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY n DESC, length(text) DESC, first) AS rank FROM g)"""


@query(f"""WITH {_CANDIDATES},
j AS (SELECT a.book_id, a.text AS a, b.text AS b, b.rank AS br, length(a.text) = 2 AND length(b.text) = 3 AND starts_with(b.text, a.text) AND b.n >= 0.8 * a.n AS prefix,
             length(a.text) >= 3 AND a.n >= 0.8 * b.n AS strike, b.n > 1.2 * a.n AS more FROM r a JOIN r b ON a.book_id = b.book_id AND a.text <> b.text AND contains(b.text, a.text)),
e AS (SELECT *, min(CASE WHEN prefix OR (NOT strike AND more) THEN br END) OVER (PARTITION BY book_id, a) AS stop FROM j),
gone AS (SELECT book_id, a AS text FROM e WHERE stop IS NOT NULL UNION SELECT book_id, b FROM e WHERE strike AND NOT prefix AND (stop IS NULL OR br < stop))
SELECT book_id, text, n, first.c AS chapter_index, first.p AS position, n_chapters, least(0.95::DOUBLE, 0.62::DOUBLE + least(0.15::DOUBLE, n / 80.0::DOUBLE) + least(0.18::DOUBLE, n_chapters / 40.0::DOUBLE)) AS confidence,
       row_number() OVER (PARTITION BY book_id ORDER BY n DESC, length(text) DESC, first) AS rank
FROM g ANTI JOIN gone USING (book_id, text)""")
def frequent_names(spark, sf):
    out = scanners.frequent_names(books(spark, sf), least=2)
    return out.select("book_id", "text", "n", "chapter_index", "position", F.size("all_chapters").alias("n_chapters"), "confidence", "rank")


@query(f"""SELECT w AS text, regexp_matches(w, '^{CJK}{{2,4}}$') AND w NOT IN {_in(lex.NAME_STOP_WORDS)} AND NOT regexp_matches(w, '[{lex.ORG_SUFFIXES}]$') AND NOT regexp_matches(w, '[{lex.BAD_NAME_CHARS}]') AS likely
FROM (WITH {BOOKS} SELECT DISTINCT unnest(regexp_extract_all(content, '{CJK}{{2,4}}')) AS w FROM b)""")
def likely_names(spark, sf):
    rows = books(spark, sf).select(F.explode(F.regexp_extract_all("content", F.lit("[一-鿿]{2,4}"), F.lit(0))).alias("text")).distinct()
    return rows.select("text", scanners.likely_name(F.col("text")).alias("likely"))


_PAIRS = (("李伟", "张三"), ("欧阳锋", "王五"))
_NAMES = ("李伟", "张三", "欧阳锋", "王五", "慕容燕")
_FOUND = f"""{BOOKS}, w AS (SELECT unnest({list(_NAMES)}) AS text),
h AS (SELECT book_id, text, chapter_index, (length(content) - length(replace(content, text, ''))) // length(text) AS c FROM b, w WHERE contains(content, text)),
x AS (SELECT book_id, text, sum(c) AS n, list(DISTINCT chapter_index) AS ch FROM h GROUP BY ALL), al AS (SELECT unnest({[p for p, _ in _PAIRS]}) AS main, unnest({[a for _, a in _PAIRS]}) AS alias)"""


def _names_found(spark, sf) -> DataFrame:
    return scanners.exact_mentions(books(spark, sf), spark.createDataFrame([(n,) for n in _NAMES], "name string"))


@query("""WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{5,}')) AS name FROM benchmark),
h AS (SELECT coalesce(source, '') AS book_id, doc_id AS chapter_index, name, (length(text) - length(replace(text, name, ''))) // length(name) AS c, instr(text, name) - 1 AS position FROM documents, n WHERE contains(text, name))
SELECT book_id, name AS text, sum(c)::BIGINT AS n, min(struct_pack(c := chapter_index, p := position)).c AS chapter_index, min(struct_pack(c := chapter_index, p := position)).p AS position, count(*) AS n_chapters FROM h GROUP BY book_id, name""")
def many_names(spark, sf):
    """All longer words of the benchmark as names, found in the documents (each a chapter of its source) in one pass."""
    words = _t(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0))).alias("name"))
    docs = _t(spark, sf, "documents").select(F.coalesce("source", F.lit("")).alias("book_id"), F.col("doc_id").alias("chapter_index"), F.col("text").alias("content"))
    out = scanners.exact_mentions(docs, words)
    return out.select("book_id", "text", "n", "chapter_index", F.col("position").cast("long").alias("position"), F.size("all_chapters").cast("long").alias("n_chapters"))


def _alias_table(spark) -> DataFrame:
    return spark.createDataFrame(list(_PAIRS), "primary string, alias string")


@query(f"""WITH {_FOUND},
v AS (SELECT x.book_id, x.text AS alias, al.main FROM x JOIN al ON x.text = al.alias WHERE EXISTS (SELECT 1 FROM x y WHERE y.book_id = x.book_id AND y.text = al.main)),
t AS (SELECT x.*, v.alias, coalesce(v.main, x.text) AS main FROM x LEFT JOIN v ON v.book_id = x.book_id AND v.alias = x.text)
SELECT book_id, main AS text, cast(sum(n) AS BIGINT) AS n, len(list_distinct(flatten(list(ch)))) AS n_chapters, coalesce(string_agg(alias, ',' ORDER BY alias), '') AS aliases FROM t GROUP BY ALL""")
def alias_roll_up(spark, sf):
    out = scanners.roll_up_aliases(_names_found(spark, sf), _alias_table(spark))
    return out.select("book_id", "text", "n", F.size("all_chapters").alias("n_chapters"), F.array_join("aliases", ",").alias("aliases"))


@query(f"""WITH {_FOUND} SELECT h.book_id, h.chapter_index, coalesce(al.main, h.text) AS text, coalesce(al.alias, '') AS aliases, h.c AS n FROM h LEFT JOIN al ON h.text = al.alias""")
def canonical_mentions(spark, sf):
    rows = books(spark, sf).crossJoin(F.broadcast(spark.createDataFrame([(n,) for n in _NAMES], "text string"))).filter(F.contains("content", F.col("text")))
    rows = rows.withColumn("n", ((F.length("content") - F.length(F.replace("content", F.col("text"), F.lit("")))) / F.length("text")).cast("long"))
    return scanners.canonical(rows, _alias_table(spark)).select("book_id", "chapter_index", "text", F.array_join("aliases", ",").alias("aliases"), "n")


@query(f"""WITH {_FOUND}, known AS (SELECT DISTINCT book_id, chapter_index // 2 AS batch, text FROM h), first AS (SELECT book_id, chapter_index // 2 AS batch, min(chapter_index) AS chapter_index FROM b GROUP BY ALL),
a AS (SELECT f.book_id, f.batch, w.text, f.chapter_index FROM first f, w ANTI JOIN known k ON k.book_id = f.book_id AND k.batch = f.batch AND k.text = w.text),
o AS (SELECT book_id, text, min(chapter_index) AS chapter_index, 'llm' AS source FROM a GROUP BY ALL)
SELECT book_id, text, cast(chapter_index AS BIGINT) AS chapter_index, source FROM o UNION ALL SELECT book_id, text, cast(chapter_index AS BIGINT), 'regex' FROM h""")
def completed_mentions(spark, sf):
    chaps = books(spark, sf)
    names = spark.createDataFrame([(n,) for n in _NAMES], "text string")
    found = chaps.crossJoin(F.broadcast(names)).filter(F.contains("content", F.col("text"))).select("book_id", "chapter_index", "text", F.lit("character").alias("type"), F.lit("regex").alias("source"), F.lit(0).alias("position"), F.lit(0.7).alias("confidence"))
    batches = chaps.select("book_id", F.floor(F.col("chapter_index") / 2).cast("int").alias("batch")).distinct()
    answers = batches.crossJoin(F.broadcast(names)).select("book_id", "batch", F.lit("character").alias("type"), "text", F.lit(0.8).alias("confidence"))
    return scanners.completed(found, chaps, answers, batch=2).select("book_id", "text", "chapter_index", "source")


# -- confidence and importance --------------------------------------------------

# ``e``: the names as entities; ``n``: chapters of a book; ``me``: a mention a chapter, at the name's first place there.
_ENT = f"""{BOOKS}, w AS (SELECT unnest({list(_NAMES)}) AS text),
me AS (SELECT book_id, text, chapter_index, content, instr(content, text) - 1 AS position, (length(content) - length(replace(content, text, ''))) // length(text) AS c FROM b, w WHERE contains(content, text)),
e AS (SELECT book_id, text, cast(sum(c) AS BIGINT) AS tc, list_sort(list(DISTINCT chapter_index)) AS ch, min(struct_pack(c := chapter_index, p := position)) AS f FROM me GROUP BY ALL),
n AS (SELECT book_id, count(*) AS n FROM b GROUP BY book_id), k AS (SELECT e.*, n, len(ch) AS k FROM e JOIN n USING (book_id))"""


def _around(reach: int) -> str:
    return f"substr(content, greatest(position - {reach}, 0) + 1, position + {reach} - greatest(position - {reach}, 0))"


def _cjk_pairs(source: str, text: str, keys: str) -> str:
    """SQL of the distinct pairs of neighbouring CJK characters of ``text`` by ``keys``."""
    return f"SELECT DISTINCT {keys}, pair FROM (SELECT {keys}, substr(t, i, 2) AS pair FROM (SELECT {keys}, {text} AS t, unnest(range(1, length({text}))) AS i FROM {source})) WHERE regexp_matches(pair, '^[一-鿿]{{2}}$')"


def _entities(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, mentions and chapters of the names."""
    chaps = books(spark, sf)
    ent = _names_found(spark, sf).select("book_id", F.lit("character").alias("type"), "text", F.col("n").alias("total_count"), "all_chapters", "chapter_index", "position", F.array().cast("array<string>").alias("aliases"))
    names = spark.createDataFrame([(n,) for n in _NAMES], "text string")
    m = chaps.crossJoin(F.broadcast(names)).filter(F.contains("content", F.col("text"))).select("book_id", F.lit("character").alias("type"), "text", "chapter_index", (F.instr("content", F.col("text")) - 1).alias("position"))
    return ent, m, chaps


_SEMANTIC = f"""sw AS (SELECT x.book_id, x.text, x.f.p AS position, b.content FROM (SELECT book_id, text, f, unnest(ch) AS c FROM e) x JOIN b ON b.book_id = x.book_id AND b.chapter_index = x.c),
sp AS (SELECT book_id, text, count(DISTINCT pair) AS pairs FROM ({_cjk_pairs('sw', _around(50), 'book_id, text')}) GROUP BY ALL)"""


@query(f"""WITH {_ENT}, {_SEMANTIC} SELECT k.book_id, k.text, least(1.0::DOUBLE, coalesce(pairs, 0) / (10.0::DOUBLE * k)) AS diversity, 0.2::DOUBLE AS density, 1.0::DOUBLE / k AS concentration FROM k LEFT JOIN sp USING (book_id, text)""")
def semantic_features(spark, sf):
    ent, _, chaps = _entities(spark, sf)
    return scoring.semantic_features(ent, chaps).select("book_id", "text", "diversity", "density", "concentration")


_CONFIDENCE = f"""{_ENT}, {_SEMANTIC},
x AS (SELECT book_id, text, k, n, unnest(ch) AS c FROM k), pf AS (SELECT book_id, text, avg(c / greatest(1, n - 1)) AS ap, least(1.0, 10 * var_pop(c / greatest(1, n - 1))) AS pv FROM x GROUP BY ALL),
gp AS (SELECT book_id, text, stddev_pop(g) AS sg FROM (SELECT book_id, text, c - lag(c) OVER (PARTITION BY book_id, text ORDER BY c) AS g FROM x) GROUP BY ALL),
z AS (SELECT k.*, k / n AS cov, ap, pv, CASE WHEN k <= 1 THEN 0 ELSE greatest(0, 1 - sg / (n / k)) END AS un, least(1.0, coalesce(pairs, 0) / (10.0 * k)) AS dv, sqrt(k / n * (1 - k / n)) AS sd
      FROM k JOIN pf USING (book_id, text) JOIN gp USING (book_id, text) LEFT JOIN sp USING (book_id, text)),
su AS (SELECT a.book_id, a.text, greatest(0.5, 1 - 0.1 * count(o.text)) AS su FROM z a LEFT JOIN z o ON a.book_id = o.book_id AND a.text <> o.text AND abs(a.tc - o.tc) <= 2 AND abs(a.cov - o.cov) < 0.1 GROUP BY ALL),
cf AS (SELECT book_id, text, least(1.0, tc / 3) AS mc, greatest(0.3, 0.5 * pv + 0.5 * (1 - abs(ap - 0.5))) AS pc, 0.6 * least(1.0, 5 * cov) + 0.4 * un AS dc, greatest(0.3, 0.5 * dv + 0.5 * (1 - 1 / k)) AS sc, su, CASE WHEN tc < 2 THEN 0.7 ELSE 1 END * su * CASE WHEN sd > 3 THEN 0.8 ELSE 1 END AS pen FROM z JOIN su USING (book_id, text)),
co AS (SELECT *, least(1.0, greatest(0.0, (0.3 * mc + 0.2 * pc + 0.3 * dc + 0.2 * sc) * pen)) AS overall FROM cf)"""


@query(f"WITH {_CONFIDENCE} SELECT book_id, text, round(mc::DOUBLE, 9) AS mention_confidence, round(pc::DOUBLE, 9) AS position_confidence, round(dc::DOUBLE, 9) AS distribution_confidence, round(sc::DOUBLE, 9) AS semantic_confidence, round(su::DOUBLE, 9) AS substitutability, round(overall::DOUBLE, 9) AS overall FROM co")
def entity_confidence(spark, sf):
    ent, _, chaps = _entities(spark, sf)
    out = scoring.confidence(ent, chaps)
    return out.select("book_id", "text", *[F.round(c, 9).alias(c) for c in ("mention_confidence", "position_confidence", "distribution_confidence", "semantic_confidence", "substitutability", "overall")])


_DRIVE = f"""dn AS (SELECT book_id, text, avg(CASE WHEN regexp_matches({_around(50)}, '[{lex.ACTION_CHARS}]') THEN 1.0 ELSE 0.0 END) AS density FROM me GROUP BY ALL),
rk AS (SELECT *, cume_dist() OVER (PARTITION BY book_id ORDER BY tc) AS rank FROM k),
bd AS (SELECT book_id, text, (0.4 * rank + 0.6 * least(1.0, ln(1 + tc) / ln(21))) * 0.35 + least(1.0, k / greatest(1.0, 0.12 * n)) * greatest(0.0, 1 - 0.45 - 0.35) + density * 0.45 AS drive FROM rk JOIN dn USING (book_id, text))"""


@query(f"WITH {_ENT}, {_DRIVE} SELECT book_id, text, round(drive::DOUBLE, 9) AS behaviour_drive FROM bd")
def behaviour_drive(spark, sf):
    ent, m, chaps = _entities(spark, sf)
    return scoring.behaviour_drive(ent, m, chaps).select("book_id", "text", F.round("behaviour_drive", 9).alias("behaviour_drive"))


_IRREPLACEABLE = f"""si AS (SELECT a.book_id, a.text, count(DISTINCT o.text) AS simi FROM e a JOIN e o ON a.book_id = o.book_id AND a.text <> o.text AND (contains(a.text, o.text) OR contains(o.text, a.text)) GROUP BY ALL),
ir AS (SELECT e.book_id, e.text, 0.25 * CASE WHEN length(e.text) <= 2 THEN 0.3 WHEN length(e.text) <= 3 THEN 0.7 ELSE 1 END + 0.35 * greatest(0, 1 - 0.4 * length(regexp_replace(e.text, '[^{lex.COMMON_CHARS}]', '', 'g'))) + 0.4 * greatest(0, 1 - 0.3 * coalesce(simi, 0)) AS irr FROM e LEFT JOIN si USING (book_id, text))"""


@query("""WITH t AS (SELECT DISTINCT c_nationkey AS book_id, unnest(['c' || (c_custkey % 7), 'c' || (c_custkey % 70), '人c' || (c_custkey % 70)]) AS text FROM customer),
s AS (SELECT a.book_id, a.text, count(DISTINCT o.text) AS simi FROM t a JOIN t o ON a.book_id = o.book_id AND a.text <> o.text AND (contains(a.text, o.text) OR contains(o.text, a.text)) GROUP BY ALL)
SELECT cast(t.book_id AS BIGINT) AS book_id, t.text, round((0.25 * CASE WHEN length(t.text) <= 2 THEN 0.3 WHEN length(t.text) <= 3 THEN 0.7 ELSE 1 END + 0.35 * greatest(0, 1 - 0.4 * length(regexp_replace(t.text, '[^人事物地方天大小多少好坏新旧高低长短快慢冷热]', '', 'g'))) + 0.4 * greatest(0, 1 - 0.3 * coalesce(simi, 0)))::DOUBLE, 9) AS irreplaceability
FROM t LEFT JOIN s USING (book_id, text)""")
def irreplaceability(spark, sf):
    """Names made of customers' keys, some inside others."""
    c = _t(spark, sf, "customer")
    short, long = (F.concat(F.lit("c"), (F.col("c_custkey") % k).cast("string")) for k in (7, 70))
    rows = c.select(F.col("c_nationkey").alias("book_id"), F.explode(F.array(short, long, F.concat(F.lit("人"), long))).alias("text")).distinct().withColumn("type", F.lit("item"))
    return scoring.irreplaceability(rows).select("book_id", "text", F.round("irreplaceability", 9).alias("irreplaceability"))


_UNIQUE = f"""own AS ({_cjk_pairs('me', _around(150), 'book_id, text')}), bc AS ({_cjk_pairs('b', 'content', 'book_id, chapter_index')}),
ev AS (SELECT book_id, pair, count(*) AS chapters FROM bc GROUP BY ALL),
ins AS (SELECT own.book_id, own.text, own.pair, count(DISTINCT me.chapter_index) AS inside FROM own JOIN me USING (book_id, text) JOIN bc ON bc.book_id = me.book_id AND bc.chapter_index = me.chapter_index AND bc.pair = own.pair GROUP BY ALL),
iu AS (SELECT own.book_id, own.text, 0.85 * count(*) FILTER (coalesce(chapters, 0) <= coalesce(inside, 0)) / count(*) + 0.15 * least(1.0, count(*) / 80) AS uniq FROM own LEFT JOIN ev USING (book_id, pair) LEFT JOIN ins USING (book_id, text, pair) GROUP BY ALL)"""


@query(f"WITH {_ENT}, {_UNIQUE} SELECT e.book_id, e.text, round(coalesce(uniq, 0)::DOUBLE, 9) AS information_uniqueness FROM e LEFT JOIN iu USING (book_id, text)")
def information_uniqueness(spark, sf):
    _, m, chaps = _entities(spark, sf)
    return scoring.information_uniqueness(m, chaps).select("book_id", "text", F.round("information_uniqueness", 9).alias("information_uniqueness"))


_TURNS_SQL = " + ".join(f"CASE WHEN contains(w, '{c}') THEN {lex.TRANSITION_CHARS.count(c)} ELSE 0 END" for c in dict.fromkeys(lex.TRANSITION_CHARS))
_TRANSITION = f"""tw AS (SELECT book_id, text, chapter_index, {_around(100)} AS w FROM me),
ts AS (SELECT book_id, text, count(w) AS m, sum(length(regexp_replace(w, '[^{lex.EMOTION_CHARS}]', '', 'g'))) AS em, sum({_TURNS_SQL}) AS tu, count(DISTINCT chapter_index) AS kc FROM tw GROUP BY ALL),
st AS (SELECT book_id, text, 0.4 * least(1.0, em / (3 * m)) + 0.3 * least(1.0, tu / (2 * m)) + 0.3 * least(1.0, kc / (0.3 * n)) AS trans FROM ts JOIN n USING (book_id))"""


@query(f"WITH {_ENT}, {_TRANSITION} SELECT book_id, text, round(trans::DOUBLE, 9) AS state_transition FROM st")
def state_transition(spark, sf):
    _, m, chaps = _entities(spark, sf)
    return scoring.state_transition(m, chaps).select("book_id", "text", F.round("state_transition", 9).alias("state_transition"))


def _held(words) -> str:
    return " + ".join(f"CASE WHEN contains(w, '{x}') THEN 1 ELSE 0 END" for x in words)


_PRODUCED = f"""pw AS (SELECT book_id, text, {_around(100)} AS w FROM me),
pq AS (SELECT book_id, text, w, len(regexp_extract_all(w, '[“"][^”"]+[”"]')) AS q FROM pw),
ps AS (SELECT book_id, text, count(*) AS m, sum({_held(lex.DETAIL_WORDS)} + q) AS d, sum({_held(lex.SPACE_WORDS + lex.ACTION_WORDS)} + q) AS u FROM pq GROUP BY ALL),
pv2 AS (SELECT k.book_id, k.text, least(1.0, d / (4 * m)) AS wc, least(1.0, u / (4 * m)) AS au, least(1.0, 0.6 * least(1.0, ln(1 + tc) / ln(201)) + 0.4 * least(1.0, k / greatest(1, n) / 0.18)) AS fl FROM k JOIN ps USING (book_id, text)),
pr AS (SELECT *, greatest((wc + au) / 2, fl) AS prod FROM pv2)"""


@query(f"WITH {_ENT}, {_PRODUCED} SELECT book_id, text, round(wc::DOUBLE, 9) AS writing_completeness, round(au::DOUBLE, 9) AS adaptation_usability, round(prod::DOUBLE, 9) AS production FROM pr")
def production_value(spark, sf):
    ent, m, chaps = _entities(spark, sf)
    out = scoring.production_value(ent, m, chaps)
    return out.select("book_id", "text", *[F.round(c, 9).alias(c) for c in ("writing_completeness", "adaptation_usability", "production")])


def _pillar(x: str) -> str:
    return f"CASE WHEN {x} >= 0.75 THEN 2 WHEN {x} >= 0.5 THEN 1 ELSE 0 END"


_IMPORTANCE = f"""{_DRIVE}, {_IRREPLACEABLE}, {_UNIQUE}, {_TRANSITION}, {_PRODUCED},
al2 AS (SELECT bd.book_id, bd.text, {_pillar('(drive + irr) / 2')} AS ca, {_pillar('coalesce(uniq, 0)')} AS inf, {_pillar('trans')} AS tr, prod FROM bd JOIN ir USING (book_id, text) LEFT JOIN iu USING (book_id, text) JOIN st USING (book_id, text) JOIN pr USING (book_id, text)),
im AS (SELECT *, ca + inf + tr AS score, 0.7 * ([0, 0.17, 0.33, 0.5, 0.67, 0.83, 1.0])[ca + inf + tr + 1] + 0.3 * prod AS importance FROM al2),
iq AS (SELECT *, CASE WHEN score >= 5 THEN 'core' WHEN score >= 3 THEN 'supporting' WHEN score >= 1 THEN 'candidate' ELSE 'archived' END AS story_tier,
       CASE WHEN importance >= 0.5 AND prod >= 0.5 THEN 'core' WHEN importance >= 0.5 THEN 'supporting' WHEN prod >= 0.5 THEN 'candidate' ELSE 'archived' END AS quadrant FROM im)"""


@query(f"WITH {_ENT}, {_IMPORTANCE} SELECT book_id, text, cast(ca AS BIGINT) AS causal_necessity, cast(inf AS BIGINT) AS information, cast(tr AS BIGINT) AS transition, cast(score AS BIGINT) AS story_score, round(importance::DOUBLE, 9) AS importance, story_tier, quadrant FROM iq")
def entity_importance(spark, sf):
    out = scoring.importance(*_entities(spark, sf))
    return out.select("book_id", "text", "causal_necessity", "information", "transition", "story_score", F.round("importance", 9).alias("importance"), "story_tier", "quadrant")


@query(f"""WITH {_CONFIDENCE}, {_IMPORTANCE}
SELECT book_id, text FROM iq JOIN co USING (book_id, text) WHERE importance >= 0.7 AND overall >= 0.3 OR importance >= 0.5 AND overall >= 0.2 OR importance >= 0.3""")
def selected_entities(spark, sf):
    """The working set: what is not routed to the archive; names with a known surname only."""
    ent, m, chaps = _entities(spark, sf)
    return scoring.selected(ent, scoring.importance(ent, m, chaps), scoring.confidence(ent, chaps), scanners.likely_frequent_name(F.col("text"))).select("book_id", "text")


@query("""WITH i AS (SELECT s_suppkey, (s_suppkey % 100) / 100.0 AS i, (s_suppkey % 7) / 10.0 AS c FROM supplier), t AS (SELECT *, CASE WHEN i >= 0.7 AND c >= 0.3 THEN 'core' WHEN i >= 0.5 AND c >= 0.2 THEN 'supporting' WHEN i >= 0.3 THEN 'candidate' ELSE 'archived' END AS tier FROM i)
SELECT cast(s_suppkey AS BIGINT) AS s_suppkey, tier, CASE WHEN tier IN ('core', 'supporting') THEN 'main' WHEN tier = 'candidate' THEN 'staging' ELSE 'archive' END AS route FROM t""")
def tier_and_route(spark, sf):
    tier = scoring.tier((F.col("s_suppkey") % 100) / 100.0, (F.col("s_suppkey") % 7) / 10.0)
    return _t(spark, sf, "supplier").select("s_suppkey", tier.alias("tier"), scoring.route(tier).alias("route"))


# Signals of names (``scoring.signals``) summed over aliases.
_SIGNALS = f"""{BOOKS}, w AS (SELECT unnest({list(_NAMES)}) AS name), al AS (SELECT unnest({[p for p, _ in _PAIRS]}) AS main, unnest({[a for _, a in _PAIRS]}) AS alias),
hh AS (SELECT book_id, chapter_index, name, (length(content) - length(replace(content, name, ''))) // length(name) AS c, len(regexp_extract_all(content, '[“「『"][^”」』"]*[”」』"]')) AS q FROM b, w WHERE contains(content, name)),
kk AS (SELECT book_id, chapter_index, count(*) AS k FROM hh GROUP BY ALL), sg AS (SELECT book_id, name, sum(c) AS m, sum(ceil(q / k)) AS d FROM hh JOIN kk USING (book_id, chapter_index) GROUP BY ALL),
al3 AS (SELECT bb.book_id, w.name, coalesce(al.main, w.name) AS main FROM (SELECT DISTINCT book_id FROM b) bb CROSS JOIN w LEFT JOIN al ON al.alias = w.name),
cc AS (SELECT DISTINCT a.book_id, coalesce(x.main, a.name) AS main, coalesce(y.main, o.name) AS other FROM hh a JOIN hh o ON a.book_id = o.book_id AND a.chapter_index = o.chapter_index AND a.name <> o.name LEFT JOIN al x ON x.alias = a.name LEFT JOIN al y ON y.alias = o.name),
ru AS (SELECT al3.book_id, al3.main AS name, cast(coalesce(sum(m), 0) AS BIGINT) AS mention_count, cast(coalesce(sum(d), 0) AS BIGINT) AS dialogue_count FROM al3 LEFT JOIN sg USING (book_id, name) GROUP BY ALL),
co2 AS (SELECT book_id, main AS name, string_agg(other, ',' ORDER BY other) AS others, count(*) AS n_others FROM cc WHERE main <> other GROUP BY ALL)"""


def _rolled(spark, sf) -> DataFrame:
    return scoring.rolled_up(scoring.signals(books(spark, sf), list(_NAMES)), _alias_table(spark).withColumnRenamed("primary", "canonical"))


@query(f"WITH {_SIGNALS} SELECT book_id, name, mention_count, dialogue_count, coalesce(others, '') AS co_characters FROM ru LEFT JOIN co2 USING (book_id, name)")
def rolled_up_signals(spark, sf):
    return _rolled(spark, sf).select("book_id", "name", "mention_count", "dialogue_count", F.array_join(F.array_sort("co_characters"), ",").alias("co_characters"))


@query(f"""WITH {_SIGNALS} SELECT book_id, name, round(least(1.0, round(0.3 * least(mention_count / 50, 1) + 0.4 * least(dialogue_count / 30, 1) + 0.3 * least(coalesce(n_others, 0) / 20, 1), 2) + CASE WHEN mention_count > 5 THEN 0.05 ELSE 0 END + CASE WHEN name = '欧阳锋' THEN 0.03 ELSE 0 END)::DOUBLE, 6) AS confidence
FROM ru LEFT JOIN co2 USING (book_id, name)""")
def signal_confidence(spark, sf):
    c = scoring.signal_confidence(F.col("mention_count"), F.col("dialogue_count"), F.size("co_characters"), F.col("mention_count") > 5, F.col("name") == "欧阳锋")
    return _rolled(spark, sf).select("book_id", "name", F.round(c, 6).alias("confidence"))


@query(f"""WITH {_ENT}, mo AS (SELECT DISTINCT book_id, unnest(['李伟', 'Nobody']) AS name, unnest([['张三'], ['王五', '欧阳锋']]) AS aliases FROM b),
h2 AS (SELECT mo.book_id, mo.name, e.tc, e.ch FROM mo JOIN e ON e.book_id = mo.book_id AND (e.text = mo.name OR list_contains(mo.aliases, e.text)))
SELECT mo.book_id, mo.name AS text, cast(coalesce(max(tc), 1) AS BIGINT) AS total_count, len(coalesce(list_distinct(flatten(list(ch))), [])) AS n_chapters, 0.7::DOUBLE AS confidence FROM mo LEFT JOIN h2 USING (book_id, name) GROUP BY ALL""")
def model_entities(spark, sf):
    ent, _, chaps = _entities(spark, sf)
    told = spark.createDataFrame([("李伟", ["张三"]), ("Nobody", ["王五", "欧阳锋"])], "name string, aliases array<string>")
    told = chaps.select("book_id").distinct().crossJoin(F.broadcast(told)).withColumns({"type": F.lit("character"), "confidence": F.lit(None).cast("double"), "first_chapter": F.lit(None).cast("int"), "chapter_appearances": F.lit(None).cast("array<int>")})
    return scoring.model_entities(told, ent).select("book_id", "text", "total_count", F.size("all_chapters").alias("n_chapters"), "confidence")


# -- text functions -------------------------------------------------------------

_ODD = "replace(replace(replace(replace(text, 'e', 'ｅ'), ' a', chr(8203) || ' a'), ', ', ',' || chr(12288)), '. ', '.   ' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10))"


def _odd_texts(spark, sf) -> DataFrame:
    """Conversations with wide letters, invisible and irregular characters and runs of blank lines put in."""
    c = F.col("text")
    for a, b in (("e", "ｅ"), (" a", "​ a"), (", ", ",　"), (". ", ".   \r\n\n\n\n")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return _t(spark, sf, "conversations").select("conv_id", "turn", c.alias("text"))


@query(f"""WITH o AS (SELECT conv_id, turn, {_ODD} AS text FROM conversations), a AS (SELECT *, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS x1 FROM o), b AS (SELECT *, replace(x1, chr(8203), '') AS x2 FROM a),
c AS (SELECT *, replace(x2, chr(12288), ' ') AS x3 FROM b), d AS (SELECT *, replace(x3, 'ｅ', 'e') AS x4 FROM c), e AS (SELECT *, regexp_replace(regexp_replace(x4, '[ \\t]+\\n', chr(10), 'g'), '[ \\t]+$', '') AS x5 FROM d)
SELECT conv_id, turn, md5(trim(regexp_replace(x5, '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10))) AS text_md5, length(text) - length(x1) AS crlf_fixed, length(x1) - length(x2) AS invisible_removed,
       length(x2) - length(replace(x2, chr(12288), '')) AS whitespace_fixed, length(x3) - length(replace(x3, 'ｅ', '')) AS fullwidth_fixed, length(x5) - length(regexp_replace(x5, '\\n{{3,}}', chr(10) || chr(10), 'g')) AS blank_compressed FROM e""")
def normalized_texts(spark, sf):
    report = T.normalization_report(F.col("text"))
    return _odd_texts(spark, sf).select("conv_id", "turn", F.md5(F.encode(T.normalized(F.col("text")), "utf-8")).alias("text_md5"), *[c.alias(k) for k, c in report.items()])


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(n, '[\\/:*?"<>|]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '-') AS slug, CASE WHEN p_partkey % 2 = 0 THEN substr(lower(hex(encode('李' || p_partkey || '山'))), 1, 16) ELSE trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') END AS part
FROM (SELECT p_partkey, p_name, ' ' || p_name || ': "' || p_brand || '" - ' AS n FROM part) WHERE p_partkey % 2 = 1
UNION ALL SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(n, '[\\/:*?"<>|]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '-'), substr(lower(hex(encode('李山'))), 1, 16) FROM (SELECT p_partkey, ' ' || p_name || ': "' || p_brand || '" - ' AS n FROM part) WHERE p_partkey % 2 = 0""")
def book_slugs(spark, sf):
    n = F.concat(F.lit(" "), "p_name", F.lit(': "'), "p_brand", F.lit('" - '))
    part = F.when(F.col("p_partkey") % 2 == 1, F.col("p_name")).otherwise(F.lit("李山"))
    return _t(spark, sf, "part").select("p_partkey", T.book_slug(n).alias("slug"), T.slug_part(part).alias("part"))


def _sentences(rx: str, how: str) -> str:
    return f"s AS (SELECT book_id, chapter_index, unnest({how}(content, '{rx}')) AS s FROM b)"


@query(f"WITH {BOOKS}, {_sentences('[^。！？!?；;' + chr(10) + ']{4,160}', 'regexp_extract_all')} SELECT book_id, chapter_index, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS told FROM s GROUP BY ALL")
def narrative_sentences(spark, sf):
    rows = books(spark, sf).select("book_id", "chapter_index", F.explode(T.narrative_sentences(F.col("content"))).alias("s"))
    return rows.groupBy("book_id", "chapter_index").agg(F.count("*").alias("n"), F.md5(F.encode(F.array_join(F.array_sort(F.collect_list("s")), "|"), "utf-8")).alias("told"))


_TRIMS = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(12288) || chr(160))"


@query(f"""WITH {BOOKS}, x AS (SELECT book_id, chapter_index, unnest(string_split(regexp_replace(regexp_replace(content, '([。！？!?])', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1))) AS s FROM b)
SELECT book_id, chapter_index, count(*) AS n, cast(sum(length({_TRIMS.format('s')})) AS BIGINT) AS chars FROM x WHERE {_TRIMS.format('s')} <> '' GROUP BY ALL""")
def description_sentences(spark, sf):
    rows = books(spark, sf).select("book_id", "chapter_index", F.explode(T.description_sentences(F.col("content"))).alias("s"))
    return rows.groupBy("book_id", "chapter_index").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))


@query(f"""WITH {BOOKS}, x AS (SELECT book_id, chapter_index, unnest(string_split(regexp_replace(content, '([，,；;、])', '\\1' || chr(1), 'g'), chr(1))) AS s FROM b), y AS (SELECT *, trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(12288) || chr(160) || '“”"''‘’') AS c FROM x)
SELECT book_id, chapter_index, count(*) AS n, cast(sum(length(c)) AS BIGINT) AS chars FROM y WHERE c <> '' GROUP BY ALL""")
def clauses(spark, sf):
    rows = books(spark, sf).select("book_id", "chapter_index", F.explode(T.clauses(F.col("content"))).alias("s"))
    return rows.groupBy("book_id", "chapter_index").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))


@query("""WITH t AS (SELECT c_custkey, c_mktsegment AS a, c_mktsegment || '，' || c_nationkey AS b, 'n' || c_nationkey AS c FROM customer)
SELECT c_custkey, b || '；' || c AS merged FROM t""")
def merged_descriptions(spark, sf):
    """Three descriptions, of which the second holds the first."""
    c = _t(spark, sf, "customer")
    parts = F.array("c_mktsegment", F.concat("c_mktsegment", F.lit("，"), F.col("c_nationkey").cast("string")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))
    return c.select("c_custkey", T.merged_descriptions(parts).alias("merged"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '面容清秀' WHEN 1 THEN '身穿黑袍，目光平静' WHEN 2 THEN NULL ELSE '一头长发' END AS cleaned FROM customer""")
def cleaned_descriptions(spark, sf):
    """Repeats beyond any fixed number of passes, hanging fragments one after the other, and what is nothing but one."""
    k = F.col("c_custkey") % 4
    many = F.repeat(F.lit("面容"), F.col("c_custkey").cast("int") % 300 + 1)
    text = F.when(k == 0, F.concat(many, F.lit("清秀"))).when(k == 1, F.concat(F.lit("身穿黑袍，目光平静"), F.repeat(F.lit("，他被"), F.col("c_custkey").cast("int") % 12 + 1))).when(k == 2, F.lit("却将，。")).otherwise(F.lit("  一头长发 "))
    return _t(spark, sf, "customer").select("c_custkey", T.cleaned_description(text).alias("cleaned"))


# -- lines and chapters ---------------------------------------------------------

_HEADED = "'第一卷 起' || chr(10) || '序章' || chr(10) || replace(replace(replace(coalesce(text, ''), '. ', '.' || chr(10) || '第' || (['一', '二', '十二', '二百零三'])[cast(doc_id % 4 + 1 AS BIGINT)] || '章 起点' || chr(10)), ' was ', chr(10) || 'Chapter 7: On' || chr(10)), '! ', '!' || chr(10) || '第二卷' || chr(10))"


def _headed(spark, sf) -> DataFrame:
    """Documents with headings of chapters and volumes put in behind sentences."""
    numeral = F.element_at(F.array(*[F.lit(x) for x in ("一", "二", "十二", "二百零三")]), (F.col("doc_id") % 4 + 1).cast("int"))
    c = F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.concat(F.lit(".\n第"), numeral, F.lit("章 起点\n")))
    c = F.replace(F.replace(c, F.lit(" was "), F.lit("\nChapter 7: On\n")), F.lit("! "), F.lit("!\n第二卷\n"))
    return _t(spark, sf, "documents").select("doc_id", F.concat(F.lit("第一卷 起\n序章\n"), c).alias("text"))


_CUT = f"""h AS (SELECT doc_id, {_HEADED} AS text FROM documents), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM h),
t AS (SELECT *, {_TRIMS.format('line')} AS t, length({_TRIMS.format("coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY n), '')")}) AS after FROM l),
m AS (SELECT *, CASE WHEN t <> '' AND NOT regexp_matches(t, '^[-=*_]{{5,}}$') THEN CASE
  WHEN regexp_matches(line, '^\\s*(?:第[{segmentation.NUMERAL}\\d]+部.+?)?(?:第[{segmentation.NUMERAL}\\d]+章|番外[{segmentation.NUMERAL}\\d篇]*|楔子|引子|序[言章曲]|后记|尾声|完本感言)') THEN 'chapter_zh'
  WHEN regexp_matches(line, '(?i)^\\s*chapter[\\s.:\\-]*(?:\\d+|[IVXLC]+)') THEN 'chapter_en'
  WHEN regexp_matches(line, '^\\s*[\\[【第]?\\d+[\\]】\\s.\\-_:：]') AND after > 10 THEN 'heuristic' END END AS md FROM t),
q AS (SELECT *, coalesce(md, CASE WHEN n = 1 THEN 'first' END) AS mode FROM m), g AS (SELECT *, count(mode) OVER (PARTITION BY doc_id ORDER BY n) AS c FROM q),
ch AS (SELECT doc_id, c, min(n) AS start_line, max(n) AS end_line, arg_min(line, n) AS heading, arg_min(mode, n) AS mode, string_agg(line, chr(10) ORDER BY n) AS content FROM g GROUP BY ALL),
cs AS (SELECT *, {_TRIMS.format('content')} AS body FROM ch),
cx AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c) - 1 AS chapter_index FROM cs WHERE body <> ''),
vo AS (SELECT doc_id, n AS line_num, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS volume_idx, CASE WHEN contains(t, '第一卷') THEN 1 ELSE 2 END AS number, CASE WHEN contains(t, '第一卷') THEN '起' END AS title FROM t WHERE regexp_matches(t, '^第[{segmentation.NUMERAL}\\d]+(?:卷|部|集|篇|季|辑)'))"""


@query(f"WITH {_CUT} SELECT doc_id, n AS line_num, mode FROM q WHERE mode IS NOT NULL")
def chapter_boundaries(spark, sf):
    return segmentation.boundaries(noise.lines(_headed(spark, sf))).filter("mode is not null").select("doc_id", "line_num", "mode")


@query(f"""WITH {_CUT} SELECT doc_id, chapter_index, mode, start_line, end_line, md5(body) AS content_md5, length(regexp_replace(body, '\\s|' || chr(12288) || '|' || chr(160), '', 'g')) AS word_count,
CASE WHEN mode = 'first' THEN '第一卷 起' WHEN heading = '序章' THEN '序章' WHEN mode = 'chapter_zh' THEN CASE WHEN regexp_extract({_TRIMS.format('heading')}, '章[\\s：:，,]*(.*)$', 1) <> '' THEN {_TRIMS.format("regexp_extract(heading, '章[\\s：:，,]*(.*)$', 1)")} ELSE {_TRIMS.format('heading')} END
     WHEN mode = 'chapter_en' THEN {_TRIMS.format("regexp_extract(heading, '(?i)chapter[\\s.:\\-]*(?:\\d+|[IVXLC]+)(.*)$', 1)")} ELSE {_TRIMS.format("regexp_extract(heading, '^\\s*[\\[【第]?\\d+[\\]】\\s.\\-_:：]*(.*)$', 1)")} END AS title FROM cx""")
def split_chapters(spark, sf):
    rows = segmentation.chapters(_headed(spark, sf))
    return rows.select("doc_id", "chapter_index", "mode", "start_line", "end_line", F.md5(F.encode("content", "utf-8")).alias("content_md5"), "word_count", "title")


@query(f"WITH {_CUT} SELECT doc_id, volume_idx, line_num, cast(number AS BIGINT) AS number, title FROM vo")
def volume_headings(spark, sf):
    return segmentation.volumes(_headed(spark, sf))


_TREE = f"""{_CUT}, av AS (SELECT cx.*, (SELECT max(volume_idx) FROM vo WHERE vo.doc_id = cx.doc_id AND vo.line_num <= cx.start_line) AS volume_idx FROM cx),
tr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY volume_idx IS NULL, volume_idx, chapter_index) - 1 AS flat_index FROM av)"""


@query(f"""WITH {_TREE} SELECT doc_id, chapter_index, volume_idx, flat_index, CASE WHEN heading = '序章' THEN 'sub' ELSE 'main' END AS line_type, chapter_index + 1 - CASE WHEN heading = '序章' THEN chapter_index + 2 ELSE 0 END AS number FROM tr""")
def chapter_tree(spark, sf):
    """Volumes, flat order, kind and number; headings tell their number apart from their title, which keeps none here."""
    docs = _headed(spark, sf)
    rows = segmentation.tree(segmentation.chapters(docs), segmentation.volumes(docs))
    return rows.select("doc_id", "chapter_index", "volume_idx", "flat_index", "line_type", "number")


@query(f"""WITH {_TREE} SELECT vo.doc_id, vo.volume_idx, vo.line_num, cast(coalesce(sum(length(regexp_replace(body, '\\s|' || chr(12288) || '|' || chr(160), '', 'g'))), 0) AS BIGINT) AS word_count, count(tr.doc_id) AS n_chapters
FROM vo LEFT JOIN tr ON tr.doc_id = vo.doc_id AND tr.volume_idx = vo.volume_idx GROUP BY ALL""")
def volume_totals(spark, sf):
    docs = _headed(spark, sf)
    vols = segmentation.volumes(docs)
    return segmentation.volume_totals(segmentation.tree(segmentation.chapters(docs), vols), vols).select("doc_id", "volume_idx", "line_num", "word_count", "n_chapters")


@query(f"""WITH {_CUT} SELECT doc_id, n AS line_num FROM t WHERE regexp_matches(line, '(?i)^\\s*chapter[\\s.:\\-]*(?:\\d+|[IVXLC]+)')""")
def english_headings(spark, sf):
    return segmentation.english_chapters(_headed(spark, sf)).select("doc_id", "line_num")


@query(f"""WITH {_CUT} SELECT cx.doc_id, cx.start_line, cx.end_line, md5(content) AS content_md5 FROM cx WHERE chapter_index = 1""")
def one_chapter(spark, sf):
    docs = _headed(spark, sf)
    return segmentation.chapter_text(docs, segmentation.chapters(docs), 1).select("doc_id", "start_line", "end_line", F.md5(F.encode("content", "utf-8")).alias("content_md5"))


@query("""WITH n AS (SELECT o_orderkey AS id, cast(o_orderkey % 10000 AS BIGINT) AS v FROM orders), d AS (SELECT id, v, v // 1000 AS a, (v // 100) % 10 AS b, (v // 10) % 10 AS c, v % 10 AS e FROM n)
SELECT id, CASE WHEN v = 0 THEN id ELSE v END AS number FROM d""")
def chapter_numbers(spark, sf):
    """Numbers below ten thousand written as Chinese numerals in titles, and read back (a title without one has its place)."""
    v = (F.col("o_orderkey") % 10_000).cast("int")
    digit = lambda x: F.element_at(F.array(*[F.lit(c) for c in "零一二三四五六七八九"]), x + 1)
    part = lambda d, unit: F.when(d > 0, F.concat(digit(d), F.lit(unit))).otherwise(F.lit(""))
    a, b, c, e = F.floor(v / 1000).cast("int"), F.floor(v / 100).cast("int") % 10, F.floor(v / 10).cast("int") % 10, v % 10
    told = F.concat(part(a, "千"), part(b, "百"), F.when((a > 0) & (b == 0) & (v % 100 > 0), F.lit("零")).otherwise(F.lit("")), part(c, "十"), F.when((c == 0) & (b > 0) & (e > 0), F.lit("零")).otherwise(F.lit("")), part(e, ""))
    title = F.when(v == 0, F.lit("无题")).otherwise(F.concat(F.lit("第"), told, F.lit("章 起")))
    return _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), segmentation.chapter_number(title, F.col("o_orderkey") - 1).alias("number"))


@query(f"""WITH {BOOKS}, l AS (SELECT book_id, chapter_index, unnest(string_split(content, chr(10))) AS line FROM b) SELECT book_id, count(*) AS n FROM l WHERE regexp_matches(line, '^[一-鿿]$') GROUP BY ALL UNION ALL SELECT 'all', count(*) FROM l WHERE {_TRIMS.format('line')} <> ''""")
def orphan_lines(spark, sf):
    rows = noise.lines(books(spark, sf).withColumn("id", F.concat_ws("/", "book_id", "chapter_index")), "id", "content")
    fires, _ = noise.candidates(F.col("line"))["orphan"]
    one = rows.filter(fires).groupBy(F.split_part("doc_id", F.lit("/"), F.lit(1)).alias("book_id")).agg(F.count("*").alias("n"))
    return one.unionByName(rows.filter(F.length(T.trimmed(F.col("line"))) > 0).agg(F.lit("all").alias("book_id"), F.count("*").alias("n")))


_NOTED = "replace(replace(coalesce(text, ''), '. ', '.' || chr(10) || '作者的话：今天' || chr(10)), ', ', ',' || chr(10) || '以上' || chr(10))"


@query(f"""WITH RECURSIVE l AS (SELECT doc_id, {_TRIMS.format('line')} AS t, n FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS n FROM (SELECT doc_id, {_NOTED} AS x FROM documents))),
f AS (SELECT doc_id, n, t, t <> '' AND length(t) < 80 AND contains(t, '作者的话') AS st, regexp_matches(t, '^(?:以上|完毕|结束|over|就这样|谢谢|感谢)[\\s。.]*$') AS en FROM l),
w AS (SELECT doc_id, n, CASE WHEN st THEN n END AS began, CASE WHEN st THEN 0.9 END AS c FROM f WHERE n = 1
  UNION ALL SELECT f.doc_id, f.n, CASE WHEN f.t = '' THEN w.began WHEN w.began IS NULL THEN CASE WHEN f.st THEN f.n END WHEN f.en OR f.n - w.began >= 30 THEN NULL ELSE w.began END,
         CASE WHEN f.t = '' THEN NULL WHEN w.began IS NULL THEN CASE WHEN f.st THEN 0.9 END ELSE 0.7 END FROM w JOIN f ON f.doc_id = w.doc_id AND f.n = w.n + 1)
SELECT doc_id, count(*) FILTER (c = 0.9) AS n_starts, count(*) FILTER (c = 0.7) AS n_inside FROM w GROUP BY doc_id""")
def author_notes(spark, sf):
    """Notes that start behind sentences and end at marks."""
    c = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n作者的话：今天\n")), F.lit(", "), F.lit(",\n以上\n"))
    docs = noise.with_notes(_t(spark, sf, "documents").select("doc_id", c.alias("text")), "text", "note")
    return docs.select("doc_id", F.size(F.filter("note", lambda x: x == 0.9)).alias("n_starts"), F.size(F.filter("note", lambda x: x == 0.7)).alias("n_inside"))


# -- relations and coreference --------------------------------------------------

_SENT = f"{BOOKS}, s AS (SELECT book_id, chapter_index, s, i FROM (SELECT book_id, chapter_index, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (SELECT book_id, chapter_index, list_filter(regexp_split_to_array(content, '[。！？；.!?;\\n]+'), lambda x: {_TRIMS.format('x')} <> '') AS ss FROM b)))"


def _level(kind: str) -> str:
    words = lambda level: " OR ".join(f"contains(low, '{w.lower()}')" for w in dict.fromkeys(relations.INDICATORS[kind][level]))
    return f"CASE WHEN {words('explicit')} THEN 0.85 WHEN {words('dialogue')} THEN 0.65 WHEN {words('action')} THEN 0.6 ELSE 0.3 END"


_RELATED = f"""{_SENT}, fn AS (SELECT *, lower(s) AS low, list_filter({list(_NAMES)}, lambda x: contains(lower(s), x)) AS names FROM s),
lv AS (SELECT book_id, chapter_index, i, names, {', '.join(f"{_level(k)} AS {k}" for k in relations.INDICATORS)} FROM fn WHERE len(names) >= 2),
ty AS ({' UNION ALL '.join(f"SELECT book_id, chapter_index, i, names, '{k}' AS type, {k} AS c FROM lv" for k in relations.INDICATORS)}),
so AS (SELECT book_id, chapter_index, i, names, type, c, unnest(names) AS source FROM ty), ed0 AS (SELECT book_id, chapter_index, i, type, c, source, unnest(names) AS target FROM so),
ed AS (SELECT book_id, source, target, type, least(0.99, arg_min(c, chapter_index * 100000 + i) + 0.1 * (count(*) - 1)) AS confidence, min(chapter_index) AS chapter_first, max(chapter_index) AS chapter_last, count(*) AS n FROM ed0 WHERE source <> target GROUP BY ALL)"""


def _edges_of(spark, sf) -> DataFrame:
    return relations.edges(relations.evidence(relations.sentence_mentions(books(spark, sf), list(_NAMES))))


@query(f"WITH {_RELATED} SELECT book_id, source, target, type, round(confidence::DOUBLE, 9) AS confidence, chapter_first, chapter_last, n FROM ed")
def relation_edges(spark, sf):
    """With the full word lists of all types."""
    return _edges_of(spark, sf).withColumn("confidence", F.round("confidence", 9))


@query(f"""WITH {_RELATED}, bo AS (SELECT * FROM ed WHERE confidence >= 0.5 UNION ALL SELECT book_id, target, source, type, confidence, chapter_first, chapter_last, n FROM ed WHERE confidence >= 0.5)
SELECT book_id, source, target, type, round(max(confidence)::DOUBLE, 9) AS confidence, min(chapter_first) AS chapter_first, max(chapter_last) AS chapter_last FROM bo GROUP BY ALL""")
def merged_edges(spark, sf):
    """Sure edges, both ways, duplicates merged."""
    return relations.merged(relations.both_ways(relations.confident(_edges_of(spark, sf), 0.5))).withColumn("confidence", F.round("confidence", 9))


@query(f"""WITH {_RELATED}, nd AS (SELECT DISTINCT book_id, unnest(['李伟', '欧阳锋', '李伟']) AS name, unnest(['n1', 'n2', 'n9']) AS id, unnest([1, 2, 9]) AS seq FROM b), fi AS (SELECT book_id, name, arg_min(id, seq) AS id FROM nd GROUP BY ALL)
SELECT ed.book_id, coalesce(x.id, source) AS source, coalesce(y.id, target) AS target, type, n FROM ed LEFT JOIN fi x ON x.book_id = ed.book_id AND x.name = source LEFT JOIN fi y ON y.book_id = ed.book_id AND y.name = target""")
def edges_with_ids(spark, sf):
    nodes = books(spark, sf).select("book_id").distinct().crossJoin(F.broadcast(spark.createDataFrame([("李伟", "n1", 1), ("欧阳锋", "n2", 2), ("李伟", "n9", 9)], "name string, id string, seq int")))
    return relations.with_ids(_edges_of(spark, sf), nodes).select("book_id", "source", "target", "type", "n")


@query("""WITH a AS (SELECT c_nationkey AS book_id, c_custkey, unnest(['C' || (c_custkey % 50), 'x' || (c_custkey % 90)]) AS n FROM customer) SELECT cast(book_id AS BIGINT) AS book_id, lower(n) AS key, arg_max(c_custkey, c_custkey) AS id FROM a GROUP BY ALL""")
def name_index(spark, sf):
    k = F.col("c_custkey")
    nodes = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("book_id"), k.alias("id"), k.alias("seq"), F.concat(F.lit("C"), (k % 50).cast("string")).alias("name"), F.array(F.concat(F.lit("x"), (k % 90).cast("string"))).alias("aliases"))
    return relations.name_index(nodes)


def _at(parts: list[tuple[str, str, str, str]], extra: str = "") -> str:
    """SQL of offset rows: (what stands before, the text, what follows, kind) at every place; a text's first character may not go on one of the same part."""
    out = []
    for before, rx, after, kind in parts:
        full = f"^({before})({rx})(?:{after})".replace("'", "''")
        out.append(f"SELECT book_id, chapter_index, regexp_extract(s, '{full}', 2) AS text, i - 1 + length(regexp_extract(s, '{full}', 1)) AS position, '{kind}' AS kind FROM p WHERE regexp_matches(s, '{full}')")
    return f"{BOOKS}, p AS (SELECT book_id, chapter_index, i, substr(content, i, 60) AS s FROM (SELECT book_id, chapter_index, content, unnest(range(1, length(content) + 1)) AS i FROM b)), m AS ({' UNION ALL '.join(out)})"


_MARK = r"[，。！？；：、\"“”‘’\s]"


@query(f"""WITH {BOOKS}, c AS (SELECT book_id, chapter_index, ' ' || content AS t FROM b),
x AS ({' UNION ALL '.join(f"SELECT book_id, chapter_index, '{g}' AS gender, unnest(regexp_extract_all(t, '{_MARK}({_or(w)})', 1)) AS text FROM c" for g, w in coreference.PRONOUNS_ZH.items())}
UNION ALL {' UNION ALL '.join(f"SELECT book_id, chapter_index, '{g}', unnest(regexp_extract_all(regexp_replace(content, '([^0-9A-Za-z_])', '\\1\\1', 'g'), '(?i)(?:^|[^0-9A-Za-z_])({_or(w)})(?:$|[^0-9A-Za-z_])', 1)) FROM b" for g, w in coreference.PRONOUNS_EN.items())})
SELECT book_id, chapter_index, gender, lower(text) AS text, count(*) AS n FROM x GROUP BY ALL""")
def pronouns_by_gender(spark, sf):
    out = coreference.pronouns(books(spark, sf))
    return out.groupBy("book_id", "chapter_index", F.col("kind").alias("gender"), F.lower("text").alias("text")).agg(F.count("*").alias("n"))


@query(f"""WITH {_at([('', n, '', n) for n in _NAMES[:3]])}, q AS (SELECT book_id, chapter_index, i - 1 AS position FROM (SELECT book_id, chapter_index, i, content FROM (SELECT book_id, chapter_index, content, unnest(range(1, length(content) + 1)) AS i FROM b)) WHERE regexp_matches(substr(content, i, 1), '[他她它]') AND (i = 1 OR regexp_matches(substr(content, i - 1, 1), '{_MARK}'))),
d AS (SELECT book_id, chapter_index, position, kind, position - near AS gap FROM (SELECT q.book_id, q.chapter_index, q.position, m.kind, max(m.position) AS near FROM q JOIN m ON m.book_id = q.book_id AND m.chapter_index = q.chapter_index AND m.position <= q.position GROUP BY ALL)),
w AS (SELECT *, CASE WHEN gap > 500 THEN 0.5 WHEN gap > 200 THEN 0.7 WHEN gap > 100 THEN 0.85 WHEN gap > 50 THEN 0.95 ELSE 1.0 END AS c, list_position({list(_NAMES[:3])}, kind) AS o FROM d),
r AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY book_id, chapter_index, position ORDER BY c DESC, o) = 1)
SELECT q.book_id, q.chapter_index, q.position, r.kind AS name, cast(coalesce(c, 0) AS DOUBLE) AS confidence FROM q LEFT JOIN r USING (book_id, chapter_index, position)""")
def antecedents(spark, sf):
    """The surest of three names before each Chinese pronoun."""
    chaps, names = books(spark, sf), list(_NAMES[:3])
    found = coreference.pronouns(chaps).filter(F.col("text").rlike("^[他她它]"))
    return coreference.antecedents(found, coreference.names_found(chaps, names), names).select("book_id", "chapter_index", "position", "name", "confidence")


@query(f"""WITH {BOOKS}, x AS ({' UNION ALL '.join(f"SELECT book_id, chapter_index, unnest(regexp_extract_all(content, '{p}', {1 if '(' in p.removeprefix('(?i)') else 0})) AS text FROM b" for p in coreference.DESCRIPTORS)}) SELECT book_id, chapter_index, text, count(*) AS n FROM x WHERE text <> '' GROUP BY ALL""")
def descriptors(spark, sf):
    return coreference.descriptors(books(spark, sf)).groupBy("book_id", "chapter_index", "text").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT c_custkey, lower('the ' || c_mktsegment || ' ' || (c_custkey % 9)) AS d FROM customer)
SELECT c_custkey, CASE WHEN contains(d, 'building 3') THEN 'Building 3' WHEN contains(d, 'building') THEN 'Building 3' WHEN contains(d, 'house') THEN 'old house' END AS name, CASE WHEN contains(d, 'building 3') THEN 0.9::DOUBLE WHEN contains(d, 'building') OR contains(d, 'house') THEN 0.6::DOUBLE END AS confidence FROM d""")
def descriptor_matches(spark, sf):
    d = F.concat(F.lit("the "), "c_mktsegment", F.lit(" "), (F.col("c_custkey") % 9).cast("string"))
    m = _t(spark, sf, "customer").select("c_custkey", coreference.descriptor_match(d, ["Building 3", "old house"]).alias("m"))
    return m.select("c_custkey", "m.name", "m.confidence")


@query(f"""WITH {BOOKS}, x AS ({' UNION ALL '.join(f"SELECT book_id, chapter_index, '{h}' AS kind, unnest(regexp_extract_all(content, '{h}\\s*([^\\s，。！？、；：\"''【】（）]{{1,4}})', 1)) AS text FROM b" for h in coreference.HONORIFICS_ZH)}) SELECT book_id, chapter_index, kind, text, count(*) AS n FROM x WHERE text <> '' GROUP BY ALL""")
def honorifics(spark, sf):
    zh = coreference.honorifics(books(spark, sf)).filter(F.col("kind").rlike("[一-鿿]"))
    return zh.groupBy("book_id", "chapter_index", "kind", "text").agg(F.count("*").alias("n"))


@query(f"""WITH {BOOKS}, x AS (SELECT book_id, chapter_index, unnest(regexp_extract_all(content, '{_COMPOUND}{CJK}{{1,2}}')) AS text, 0.9::DOUBLE AS confidence FROM b UNION ALL SELECT book_id, chapter_index, unnest(regexp_extract_all(content, '[{lex.SURNAMES}]{CJK}{{1,2}}')), 0.7::DOUBLE FROM b)
SELECT book_id, chapter_index, text, confidence, count(*) AS n FROM x WHERE {_NAME} GROUP BY ALL""")
def surname_names(spark, sf):
    return coreference.surname_names(books(spark, sf)).groupBy("book_id", "chapter_index", "text", "confidence").agg(F.count("*").alias("n"))


_NICK = "replace(replace(text, ', ', ', known as \"'), '. ', '\" x. ')"


@query(f"""WITH b AS (SELECT cast(conv_id AS VARCHAR) AS book_id, turn AS chapter_index, {_NICK} AS content FROM conversations),
x AS ({' UNION ALL '.join(f"SELECT book_id, chapter_index, unnest(regexp_extract_all(content, '{p}', 1)) AS name, unnest(regexp_extract_all(content, '{p}', 2)) AS alias FROM b" for p in coreference.ALIASES[:-1])})
SELECT DISTINCT book_id, chapter_index, {_TRIMS.format('name')} AS name, {_TRIMS.format('alias')} AS alias FROM x""")
def alias_pairs(spark, sf):
    c = F.replace(F.replace("text", F.lit(", "), F.lit(", known as \"")), F.lit(". "), F.lit("\" x. "))
    rows = _t(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("book_id"), F.col("turn").cast("int").alias("chapter_index"), c.alias("content"))
    return coreference.alias_pairs(rows)


@query("""WITH p AS (SELECT o_custkey, 'c' || o_custkey AS name, o_orderpriority AS alias FROM orders), m AS (SELECT name, list_sort(list(DISTINCT alias)) AS more FROM p GROUP BY name)
SELECT 'c' || c_custkey AS name, array_to_string(list_concat([c_mktsegment], list_filter(coalesce(more, []), lambda x: x <> c_mktsegment)), ',') AS aliases FROM customer LEFT JOIN m ON m.name = 'c' || c_custkey""")
def extended_aliases(spark, sf):
    name = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    rows = _t(spark, sf, "customer").select(F.lit(0).alias("book_id"), name("c_custkey").alias("name"), F.array("c_mktsegment").alias("aliases"))
    pairs = _t(spark, sf, "orders").select(F.lit(0).alias("book_id"), name("o_custkey").alias("name"), F.col("o_orderpriority").alias("alias"))
    return coreference.extended(rows, pairs).select("name", F.array_join("aliases", ",").alias("aliases"))


# -- resolution and matching ----------------------------------------------------

_FORMS = "(['', '老', '小', '阿'])[cast(c_custkey % 4 + 1 AS BIGINT)] || (['李伟', '欧阳锋', '张三丰'])[cast(c_custkey % 3 + 1 AS BIGINT)] || (['', '哥', '少爷', '儿', '大人'])[cast(c_custkey % 5 + 1 AS BIGINT)]"


def _formed() -> F.Column:
    pick = lambda words, k: F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("c_custkey") % k + 1).cast("int"))
    return F.concat(pick(("", "老", "小", "阿"), 4), pick(("李伟", "欧阳锋", "张三丰"), 3), pick(("", "哥", "少爷", "儿", "大人"), 5))


@query(f"""SELECT c_custkey, {_FORMS} AS name, (['李伟', '欧阳锋', '张三丰'])[cast(c_custkey % 3 + 1 AS BIGINT)] AS bare FROM customer""")
def address_forms(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", _formed().alias("name")).withColumn("bare", resolution.address_free_column(F.col("name")))


@query(f"""WITH m AS (SELECT c_nationkey AS book_id, c_custkey AS seq, {_FORMS} AS name FROM customer WHERE c_custkey % 2 = 0), s AS (SELECT c_nationkey AS book_id, c_custkey AS sid, {_FORMS} AS name, c_custkey % 40 AS total FROM customer WHERE c_custkey % 2 = 1),
f AS (SELECT m.book_id, seq, sid, CASE WHEN m.name = s.name THEN 0 ELSE 1 END AS o FROM m JOIN s ON m.book_id = s.book_id AND (['李伟', '欧阳锋', '张三丰'])[cast(seq % 3 + 1 AS BIGINT)] = (['李伟', '欧阳锋', '张三丰'])[cast(sid % 3 + 1 AS BIGINT)]),
g AS (SELECT book_id, seq, arg_min(sid, o * 1000000000 + sid) AS sid FROM f GROUP BY ALL)
SELECT cast(m.book_id AS BIGINT) AS book_id, m.seq, m.name, greatest(3, coalesce(total, 0)) AS mention_count, CASE WHEN s.name IS NOT NULL AND s.name <> m.name THEN s.name ELSE '' END AS aliases FROM m LEFT JOIN g USING (book_id, seq) LEFT JOIN s ON s.sid = g.sid""")
def fused_characters(spark, sf):
    """A model's people (even keys) and scanned ones (odd keys), matched by name or form of address."""
    c = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("book_id"), F.col("c_custkey").alias("seq"), _formed().alias("name"), F.array().cast("array<string>").alias("aliases"), (F.col("c_custkey") % 40).alias("total_count"), F.array(F.lit(1)).alias("all_chapters"))
    told = c.filter("seq % 2 = 0").drop("total_count", "all_chapters").withColumn("mention_count", F.lit(3))
    return resolution.fused(told, c.filter("seq % 2 = 1")).select("book_id", "seq", "name", F.col("mention_count").cast("long").alias("mention_count"), F.array_join("aliases", ",").alias("aliases"))


@query("""WITH a AS (SELECT c_mktsegment || (c_custkey % 100) AS name, arg_max(c_acctbal, c_custkey) AS v FROM customer GROUP BY ALL), s AS (SELECT 'BUILDING' || (s_suppkey % 200) AS name, arg_max(s_acctbal, s_suppkey) AS w FROM supplier GROUP BY ALL)
SELECT coalesce(a.name, s.name) AS name, v, w FROM a FULL OUTER JOIN s ON a.name = s.name""")
def outer_by_name(spark, sf):
    a = _t(spark, sf, "customer").select(F.concat("c_mktsegment", (F.col("c_custkey") % 100).cast("string")).alias("name"), F.col("c_custkey").alias("seq"), F.col("c_acctbal").alias("v"))
    s = _t(spark, sf, "supplier").select(F.concat(F.lit("BUILDING"), (F.col("s_suppkey") % 200).cast("string")).alias("name"), F.col("s_suppkey").alias("seq"), F.col("s_acctbal").alias("w"))
    return resolution.outer_by_name(a, s)


@query("""WITH e AS (SELECT s_nationkey AS book_id, 'S' || s_suppkey AS name, ['s' || (s_suppkey + 25), 'T' || (s_suppkey % 5)] AS al FROM supplier), k AS (SELECT book_id, name, lower(unnest(list_concat([name], al))) AS k FROM e),
p AS (SELECT DISTINCT a.book_id, a.name, o.name AS pack_name FROM k a JOIN k o USING (book_id, k))
SELECT cast(book_id AS BIGINT) AS book_id, name, pack_name FROM p WHERE lower(name) = lower(pack_name) OR NOT EXISTS (SELECT 1 FROM e WHERE e.book_id = p.book_id AND lower(e.name) = lower(pack_name))""")
def packs_by_names(spark, sf):
    k = F.col("s_suppkey")
    e = _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("book_id"), F.concat(F.lit("S"), k.cast("string")).alias("name"), F.array(F.concat(F.lit("s"), (k + 25).cast("string")), F.concat(F.lit("T"), (k % 5).cast("string"))).alias("aliases"))
    return assembly.packs_of(e, e)


@query("""WITH o AS (SELECT c_nationkey AS book_id, 'i' || (c_custkey % 20) AS item, c_custkey AS p, CASE WHEN c_custkey % 2 = 0 THEN ' ' || c_mktsegment ELSE lower(c_mktsegment) END AS owner, c_custkey % 30 AS a, c_custkey % 30 + 3 AS z FROM customer)
SELECT cast(book_id AS BIGINT) AS book_id, item, lower(trim(owner)) AS owner, min(a) AS first_chapter, max(z) AS last_chapter FROM o GROUP BY ALL""")
def owners_of_items(spark, sf):
    k = F.col("c_custkey")
    owner = F.struct(F.when(k % 2 == 0, F.concat(F.lit(" "), "c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("name"), (k % 30).alias("first_chapter"), (k % 30 + 3).alias("last_chapter"))
    items = _t(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("book_id"), F.concat(F.lit("i"), (k % 20).cast("string")).alias("item")).agg(F.collect_list(owner).alias("owners"))
    return resolution.merged_owners(items).select("book_id", "item", F.lower(F.trim("owner")).alias("owner"), "first_chapter", "last_chapter")


@query("""WITH e AS (SELECT s_nationkey AS book_id, 'S' || s_suppkey AS name, unnest(['s' || (s_suppkey + 25), 'T' || (s_suppkey % 5), '少年', 'x', 'S' || s_suppkey]) AS alias FROM supplier)
SELECT cast(book_id AS BIGINT) AS book_id, name, alias FROM e WHERE length(alias) >= 2 AND alias <> '少年' AND NOT EXISTS (SELECT 1 FROM supplier t WHERE t.s_nationkey = e.book_id AND lower('S' || t.s_suppkey) = lower(trim(alias)))""")
def aliases_without_collisions(spark, sf):
    k, name = F.col("s_suppkey"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    e = _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("book_id"), name.alias("name"), F.array(F.concat(F.lit("s"), (k + 25).cast("string")), F.concat(F.lit("T"), (k % 5).cast("string")), F.lit("少年"), F.lit("x"), name).alias("aliases"))
    return resolution.without_collisions(e)


@query("""WITH RECURSIVE r AS (SELECT s_nationkey AS book_id, s_suppkey AS seq, 'k' || (s_suppkey % 70) AS a, 'k' || (s_suppkey * 7 % 90) AS z FROM supplier),
j AS (SELECT DISTINCT x.book_id, x.seq AS s, y.seq AS t FROM r x JOIN r y ON x.book_id = y.book_id AND (x.a IN (y.a, y.z) OR x.z IN (y.a, y.z))), c(book_id, s, t) AS (SELECT * FROM j UNION SELECT c.book_id, c.s, j.t FROM c JOIN j ON j.book_id = c.book_id AND j.s = c.t)
SELECT cast(book_id AS BIGINT) AS book_id, s AS seq, min(t) AS cluster FROM c GROUP BY ALL""")
def connected_names(spark, sf):
    k = F.col("s_suppkey")
    rows = _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("book_id"), k.alias("seq"), F.concat(F.lit("k"), (k % 70).cast("string")).alias("name"), F.array(F.concat(F.lit("k"), (k * 7 % 90).cast("string"))).alias("aliases"))
    return resolution.connected(rows)


@query(f"""WITH r AS (SELECT c_custkey, {_FORMS} AS name, (c_custkey % 10) / 10.0 AS confidence FROM customer) SELECT c_custkey, confidence >= 0.4 AND length(name) BETWEEN 2 AND 8 AS valid, regexp_matches(name, '[的了着过0-9]') AS warned FROM r""")
def entity_rules(spark, sf):
    rows = _t(spark, sf, "customer").select("c_custkey", _formed().alias("name"), ((F.col("c_custkey") % 10) / 10.0).alias("confidence"))
    out = validation.validate(rows, validation.ENTITY_ERRORS, validation.ENTITY_WARNINGS)
    return out.select("c_custkey", "valid", (F.col("warnings") != "").alias("warned"))


@query("""SELECT c_custkey, c_custkey % 3 = 0 AS alias_is_name, c_custkey % 4 <> 0 AND c_acctbal >= 0.3 AS valid FROM customer WHERE c_custkey % 4 <> 0 AND c_acctbal >= 0.3 UNION ALL SELECT c_custkey, c_custkey % 3 = 0, false FROM customer WHERE NOT (c_custkey % 4 <> 0 AND c_acctbal >= 0.3)""")
def split_characters(spark, sf):
    """Valid and rejected people, with the warning that an alias equals the name."""
    k = F.col("c_custkey")
    rows = _t(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_acctbal").alias("confidence"), F.array(F.when(k % 3 == 0, F.concat(F.lit(" "), F.lower("c_name"))).otherwise(F.lit("x"))).alias("aliases"), F.when(k % 4 != 0, F.lit("d")).alias("description"), F.array(F.lit(1)).alias("chapter_appearances"))
    good, bad = validation.split(rows)
    return good.unionByName(bad).select("c_custkey", (F.col("warnings") != "").alias("alias_is_name"), "valid")


# -- narrative ------------------------------------------------------------------

_EVENTS = ("解除婚约", "萧炎写下休书", "药老从戒指里现身", "李伟追杀欧阳锋", "紫金丹")
_ALONE = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{r}'" for p, r in narrative.RULES.types)
_FUNCTION = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{r}'" for p, r in narrative.RULES.functions)
_BY_TYPE = " ".join(f"WHEN ty = '{k}' THEN '{r}'" for k, r in narrative.RULES.by_type)
_RESULT = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{r}'" for p, r in narrative.RULES.consequences)
_CUES = " || ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {list(c)} ELSE [] END" for p, c in narrative.RULES.cues)
_STORY = f"""{BOOKS}, w AS (SELECT unnest({list(_EVENTS)}) AS text), m0 AS (SELECT book_id, chapter_index, content, text, instr(content, text) - 1 AS position FROM b, w WHERE contains(content, text)),
m1 AS (SELECT *, CASE {_ALONE} ELSE 'other' END AS ty, {_CUES} AS cu0, 0.7 + length(text) / 100.0 AS confidence FROM m0), m2 AS (SELECT *, CASE WHEN len(cu0) > 0 THEN cu0 ELSE [substr(text, 1, 2)] END AS cu FROM m1),
ev AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter_index, position, text) AS ordinal, CASE {_FUNCTION} ELSE CASE {_BY_TYPE} ELSE 'escalation' END END AS fn, CASE {_RESULT} END AS consequence,
       (list_filter(list_transform(regexp_extract_all(content, '[^。！？!?；;\\n]{{4,160}}'), lambda s: {_TRIMS.format('s')}), lambda s: len(list_filter(cu, lambda c: contains(s, c))) > 0))[1] AS hit FROM m2),
ee AS (SELECT *, substr(coalesce(hit, substr({_TRIMS.format('content')}, 1, 120)), 1, 160) AS evidence FROM ev)"""


def _event_rows(spark, sf) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in _EVENTS], "text string")
    return books(spark, sf).crossJoin(F.broadcast(names)).filter(F.contains("content", F.col("text"))).select("book_id", "chapter_index", (F.instr("content", F.col("text")) - 1).alias("position"), "text", (0.7 + F.length("text") / 100.0).alias("confidence"), F.lit("regex").alias("source"))


def _story(spark, sf) -> DataFrame:
    return narrative.events(_event_rows(spark, sf), books(spark, sf))


@query(f"""WITH {_STORY} SELECT book_id, chapter_index, text, ordinal, ty AS event_type, fn AS function, cu[1] AS trigger, consequence, md5(evidence) AS evidence_md5 FROM ee""")
def enriched_events(spark, sf):
    return _story(spark, sf).select("book_id", "chapter_index", "text", "ordinal", "event_type", "function", "trigger", "consequence", F.md5(F.encode("evidence", "utf-8")).alias("evidence_md5"))


@query(f"""WITH {_STORY}, pe AS (SELECT book_id, chapter_index, who FROM b, (SELECT unnest(['李伟', '欧阳锋', '药老', '萧炎']) AS who) WHERE contains(content, who))
SELECT ee.book_id, ordinal, coalesce(string_agg(DISTINCT who, ',' ORDER BY who), '') AS participants FROM ee LEFT JOIN pe ON pe.book_id = ee.book_id AND pe.chapter_index = ee.chapter_index AND (contains(text, who) OR contains(evidence, who)) GROUP BY ALL""")
def event_participants(spark, sf):
    chaps = books(spark, sf)
    people = chaps.crossJoin(F.broadcast(spark.createDataFrame([(n,) for n in ("李伟", "欧阳锋", "药老", "萧炎")], "text string"))).filter(F.contains("content", F.col("text"))).select("book_id", "chapter_index", "text")
    return narrative.events(_event_rows(spark, sf), chaps, people).select("book_id", "ordinal", F.array_join("participants", ",").alias("participants"))


_ARC_TITLE = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{r}'" for p, r, _ in narrative.RULES.arcs)
_ARC_KIND = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{k}'" for p, _, k in narrative.RULES.arcs)
_ARCS = f"""{_STORY}, ar0 AS (SELECT *, lag(chapter_index) OVER o AS pc, lag(ty) OVER o AS pt FROM ee WINDOW o AS (PARTITION BY book_id ORDER BY ordinal)),
ar1 AS (SELECT *, sum(CASE WHEN pc IS NULL OR chapter_index - pc > 2 OR (ty = 'reveal' AND pt <> 'reveal') THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY ordinal) AS arc FROM ar0),
ar2 AS (SELECT book_id, cast(arc AS BIGINT) AS arc, min(chapter_index) AS start_chapter, max(chapter_index) AS end_chapter, count(*) AS n_events, avg(confidence) AS a, string_agg(text, ' ' ORDER BY ordinal) AS t, arg_min(text, ordinal) AS first, arg_min(text, ordinal) FILTER (ty = 'conflict') AS conflict, list(text ORDER BY ordinal) AS texts FROM ar1 GROUP BY ALL),
ar AS (SELECT *, CASE {_ARC_TITLE} ELSE first END AS title, CASE {_ARC_KIND} ELSE 'other' END AS arc_type, coalesce(conflict, first) AS core_conflict, least(0.95, greatest(0.55, a + CASE WHEN n_events > 1 THEN 0.04 ELSE 0 END)) AS c FROM ar2)"""


@query(f"WITH {_ARCS} SELECT book_id, arc, start_chapter, end_chapter, n_events, title, arc_type, core_conflict, abs(c - round(c::DOUBLE, 2)) <= 0.00500001 AS rounded FROM ar")
def story_arcs(spark, sf):
    out = narrative.arcs(_story(spark, sf))
    again = F.transform("events", lambda e: 0.7 + F.length(e["text"]) / 100.0)
    mean = F.aggregate(again, F.lit(0.0), lambda x, y: x + y) / F.size(again)
    c = F.least(F.lit(0.95), F.greatest(F.lit(0.55), mean + F.when(F.col("n_events") > 1, 0.04).otherwise(0.0)))
    return out.select("book_id", "arc", "start_chapter", "end_chapter", "n_events", "title", "arc_type", "core_conflict", (F.abs(c - F.col("confidence")) <= 0.00500001).alias("rounded"))


_SEGMENTS = f"""{_ARCS}, tx AS (SELECT ar.book_id, ar.arc, string_agg(b.content, chr(10) || chr(10) ORDER BY chapter_index) AS src FROM ar JOIN b ON b.book_id = ar.book_id AND b.chapter_index BETWEEN start_chapter AND end_chapter GROUP BY ALL),
pm AS (SELECT book_id, chapter_index, who, length(who) / 10.0 AS confidence FROM b, (SELECT unnest({list(_NAMES)}) AS who) WHERE contains(content, who)),
po AS (SELECT ar.book_id, arc, who, row_number() OVER (PARTITION BY ar.book_id, arc ORDER BY confidence DESC, chapter_index, who) AS ord FROM ar JOIN pm ON pm.book_id = ar.book_id AND pm.chapter_index BETWEEN start_chapter AND end_chapter),
pn AS (SELECT po.book_id, po.arc, who, min(ord) AS ord FROM po GROUP BY ALL), pc AS (SELECT pn.*, (length(src) - length(replace(src, who, ''))) // length(who) AS n FROM pn JOIN tx USING (book_id, arc)),
pr2 AS (SELECT *, row_number() OVER (PARTITION BY book_id, arc ORDER BY n DESC, ord) AS rank FROM pc)"""


@query(f"WITH {_SEGMENTS} SELECT book_id, arc, who AS text, n, rank FROM pr2")
def ranked_people(spark, sf):
    """People of each arc's range by how often they stand in its text."""
    chaps = books(spark, sf)
    arc = narrative.arcs(_story(spark, sf))
    texts = chaps.join(arc.select("book_id", "arc", "start_chapter", "end_chapter"), "book_id").filter(F.col("chapter_index").between(F.col("start_chapter"), F.col("end_chapter")))
    texts = texts.groupBy("book_id", "arc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter_index", "content"))), lambda x: x["content"]), "\n\n").alias("source_text"))
    return narrative.ranked_names(narrative.in_chapters(_people(spark, sf), arc, "arc"), texts, "arc").select("book_id", "arc", "text", "n", "rank")


def _people(spark, sf) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in _NAMES], "text string")
    return books(spark, sf).crossJoin(F.broadcast(names)).filter(F.contains("content", F.col("text"))).select("book_id", "chapter_index", "text", (F.length("text") / 10.0).alias("confidence"))


_PROPS = "|".join(narrative.RULES.props.split("|"))


@query(f"""WITH {_SEGMENTS}, ca AS (SELECT book_id, arc, max(who) FILTER (rank = 1) AS main, coalesce(string_agg(who, ',' ORDER BY rank) FILTER (rank BETWEEN 2 AND 9), '') AS supporting FROM pr2 GROUP BY ALL),
tu AS (SELECT ar.book_id, ar.arc, title, texts, regexp_extract_all(src, '{_PROPS}') AS ps, src FROM ar JOIN tx USING (book_id, arc)),
td AS (SELECT *, list_filter(texts || list_filter(ps, lambda x, i: list_position(ps, x) = i)[1:3], lambda x, i: list_position(texts || list_filter(ps, lambda y, j: list_position(ps, y) = j)[1:3], x) = i)[1:8] AS tp FROM tu)
SELECT td.book_id, td.arc, main, coalesce(supporting, '') AS supporting, array_to_string(tp, ',') AS turning_points, coalesce(main, '主角') || '卷入“' || title || '”：' || array_to_string(tp[1:3], '、') || '。' AS summary, md5(src) AS text_md5 FROM td LEFT JOIN ca USING (book_id, arc)""")
def arc_segments(spark, sf):
    out = narrative.arc_segments(narrative.arcs(_story(spark, sf)), books(spark, sf), _people(spark, sf))
    return out.select("book_id", "arc", "main", F.array_join(F.coalesce("supporting", F.array().cast("array<string>")), ",").alias("supporting"), F.array_join("turning_points", ",").alias("turning_points"), "summary", F.md5(F.encode("source_text", "utf-8")).alias("text_md5"))


@query(f"""WITH {BOOKS}, t AS (SELECT *, CASE WHEN chapter_index % 3 = 0 THEN '书名：某' WHEN chapter_index % 3 = 1 THEN '世界观' ELSE title END AS ti, {_TRIMS.format('content')} AS c FROM b), k AS (SELECT *, length(c) >= 200 AS long FROM t WHERE c <> '' AND NOT regexp_matches(ti, '^(?:书名|作者|简介|序言?)[:：]')),
a AS (SELECT *, max(long::INT) OVER (PARTITION BY book_id) AS hv FROM k) SELECT book_id, chapter_index, ti = '世界观' AS setting FROM a WHERE long OR hv = 0""")
def narrative_chapters(spark, sf):
    """Chapters that tell the story, those of the setting marked by their title."""
    k = F.col("chapter_index") % 3
    rows = books(spark, sf).withColumn("title", F.when(k == 0, "书名：某").when(k == 1, "世界观").otherwise(F.col("title")))
    kept = narrative.narrative_chapters(rows, least=200)
    setting = narrative.worldbuilding(kept).select("book_id", "chapter_index", F.lit(True).alias("setting"))
    return kept.join(setting, ["book_id", "chapter_index"], "left").select("book_id", "chapter_index", F.coalesce("setting", F.lit(False)).alias("setting"))


@query("""WITH s AS (SELECT user_id AS book_id, event_id, row_number() OVER w AS c, ['p' || (event_id % 3), 'q' || (event_id % 4)] AS mc, (event_id % 40) / 40.0 AS bc FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(CASE WHEN event_id % 3 = 0 AND c > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY book_id ORDER BY c) AS g FROM s)
SELECT book_id, arg_min(event_id, c) AS segment_id, min(c) AS start_chapter, max(c) AS end_chapter, max(bc) AS boundary_confidence, count(*) = 1 AS approved, len(list_distinct(flatten(list(mc)))) AS n_people FROM g GROUP BY book_id, g.g""")
def merged_segments(spark, sf):
    """Segments whose key is divisible by three join the one before (at most eight people are kept, of seven)."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = F.col("event_id")
    seg = _t(spark, sf, "events").select(F.col("user_id").alias("book_id"), e.alias("segment_id"), n.alias("start_chapter"), n.alias("end_chapter"), ((e % 40) / 40.0).alias("boundary_confidence"), F.array(F.concat(F.lit("p"), (e % 3).cast("string")), F.concat(F.lit("q"), (e % 4).cast("string"))).alias("main_characters"), F.array(F.lit("t")).alias("turning_points"))
    out = narrative.merged_with_previous(seg, seg.filter("segment_id % 3 = 0").select("book_id", "segment_id"))
    return out.select("book_id", "segment_id", "start_chapter", "end_chapter", "boundary_confidence", "approved", F.size("main_characters").alias("n_people"))


@query(f"""WITH {BOOKS}, r AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY chapter_index) - 1 AS i, count(*) OVER (PARTITION BY book_id) AS n, content FROM b),
h AS (SELECT book_id, i, 0 AS k FROM r WHERE i < 0.15 * n AND contains(content, '突然') UNION ALL SELECT book_id, min(i), 1 FROM r WHERE i >= 0.4 * n AND i <= 0.6 * n AND contains(content, '戒指') GROUP BY book_id UNION ALL SELECT book_id, i, 2 FROM r WHERE i >= 0.7 * n AND contains(content, '好')),
nr AS (SELECT r.book_id, r.i, n, (SELECT arg_min(k, h.i * 10 + k) FROM h WHERE h.book_id = r.book_id AND abs(h.i - r.i) <= 1) AS k FROM r)
SELECT book_id, i, CASE WHEN i / n < 0.1 THEN 'ACT_1_SETUP' WHEN i / n < 0.25 THEN CASE WHEN k = 0 THEN 'ACT_1_INCITING' ELSE 'ACT_1_SETUP' END WHEN i / n < 0.4 THEN 'ACT_2_RISING' WHEN i / n < 0.5 THEN CASE WHEN k = 1 THEN 'ACT_2_MIDPOINT' ELSE 'ACT_2_COMPLICATIONS' END
  WHEN i / n < 0.65 THEN 'ACT_2_CLIMAX_PREP' WHEN i / n < 0.75 THEN CASE WHEN k = 2 THEN 'ACT_3_CLIMAX' ELSE 'ACT_2_CLIMAX_PREP' END WHEN i / n < 0.9 THEN 'ACT_3_FALLING' ELSE 'ACT_3_RESOLUTION' END AS act_type, CASE WHEN k IS NULL THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM nr""")
def acts_near_turns(spark, sf):
    chaps = books(spark, sf)
    turns = narrative.turning_points(chaps, {"INCITING": ("突然",), "MIDPOINT": ("戒指",), "CLIMAX": ("好",)})
    return narrative.acts(chaps, turns).select("book_id", "i", "act_type", "confidence")


# -- descriptions and boards ----------------------------------------------------

# The only character with evidence in the phrases is 欧阳锋; its clauses follow one another within one sentence.
@query(f"""WITH {BOOKS}, x AS (SELECT book_id, chapter_index, len(regexp_extract_all(content, '欧阳锋身穿黑袍，面容清秀。')) AS n FROM b), e AS (SELECT book_id, cast(sum(n) AS BIGINT) AS n FROM x GROUP BY book_id)
SELECT book_id, n > 0 AS clothed, n > 0 AS shown, n AS n_evidence FROM e""")
def evidence_packs(spark, sf):
    """Packs of a person from all sentences of a book (``n_evidence`` of those with its robe and face alone)."""
    chaps = books(spark, sf)
    who = chaps.select("book_id").distinct().withColumns({"name": F.lit("欧阳锋"), "aliases": F.array().cast("array<string>")})
    packs = assembly.packs(who, chaps, "character")
    found = assembly.evidence(who, chaps, "character").filter("field = 'clothing' and clause = '欧阳锋身穿黑袍'").groupBy("book_id").agg(F.count("*").alias("n"))
    rows = packs.join(found, "book_id", "left")
    return rows.select("book_id", F.coalesce(F.element_at("fields", F.lit("clothing")), F.lit("")).contains("身穿黑袍").alias("clothed"), F.coalesce(F.element_at("fields", F.lit("appearance")), F.lit("")).contains("面容清秀").alias("shown"), F.coalesce("n", F.lit(0)).cast("long").alias("n_evidence"))


@query()
def char_segments(spark, sf):
    """Stretches of dialogue, transition and description of each chapter (the tests compare them with a walk over the characters)."""
    return segmentation.segments(books(spark, sf).select("book_id", "chapter_index", "content"))


@query("""WITH RECURSIVE r AS (SELECT c_nationkey AS book_id, c_custkey AS seq, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE abs(c_acctbal)::BIGINT END AS size, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer),
f AS (SELECT book_id, seq, n, size AS used, 1 AS c, 0 AS g FROM r WHERE n = 1
  UNION ALL SELECT r.book_id, r.seq, r.n, CASE WHEN used + size > 9000 OR c >= 5 THEN size ELSE used + size END, CASE WHEN used + size > 9000 OR c >= 5 THEN 1 ELSE c + 1 END, CASE WHEN used + size > 9000 OR c >= 5 THEN g + 1 ELSE g END
  FROM f JOIN r ON r.book_id = f.book_id AND r.n = f.n + 1)
SELECT book_id, seq, g AS "group" FROM f""")
def budget_groups(spark, sf):
    """A nation's customers in groups of at most 9000 in size and five in number (some of no size, some of more than the budget allows together)."""
    size = F.when(F.col("c_custkey") % 7 == 0, None).otherwise(F.round(F.abs("c_acctbal")).cast("long"))
    rows = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("book_id"), F.col("c_custkey").alias("seq"), size.alias("size"))
    return model.budget_groups(rows, "size", 9000, 5).select("book_id", "seq", "group")


#: Sentences about whom a clause speaks of.
_OWNED = (
    "欧阳锋身穿黑袍，面容清秀", "李伟看着欧阳锋，目光平静，身材高大", "欧阳锋盯着李伟，神色冷漠", "李伟一身白衣，对着欧阳锋怒意翻涌，剑光闪烁", "欧阳锋看到少女，容貌清秀", "他背影高大，欧阳锋拔出长剑", "面具之下，李伟与欧阳锋并肩", "对着欧阳锋的长老，神情从容", "李伟走了，欧阳锋气质阴沉",
)
_OWNED_IN = ((" the ", (0,)), (" and ", (1, 3)), (" of ", (2, 5)), (" la ", (4, 6)), (" de ", (7,)), (" und ", (8, 4)), (" der ", (3, 2)), (" die ", (6,)), (" el ", (5, 1)))
_owned_put = {w: "。" + "".join(_OWNED[k] + "。" for k in ks) for w, ks in _OWNED_IN}
_OW = "text"
for _w, _p in _owned_put.items():
    _OW = f"replace({_OW}, '{_w}', '{_p}')"
_FIELD_ROWS = ", ".join(f"('{f}', '{p}')" for f, p in assembly.FIELDS["character"].items())


@query(f"""WITH b AS (SELECT conv_id AS book_id, turn AS chapter_index, {_OW} AS content FROM conversations),
s AS (SELECT book_id, chapter_index, unnest(string_split(content, '。')) AS s, generate_subscripts(string_split(content, '。'), 1) AS n FROM b),
c AS (SELECT *, contains(s, '李伟') AS others, regexp_split_to_array(s, '，') AS cl FROM s WHERE s IN {_in(_OWNED)}),
k AS (SELECT *, list_transform(cl, lambda x: CASE
   WHEN contains(x, '欧阳锋') AND contains(x, '李伟') THEN CASE WHEN regexp_matches(x, '李伟.*(看着|盯着).*欧阳锋') THEN 'T' WHEN regexp_matches(x, '欧阳锋.*(看着|盯着).*李伟') THEN 'O' ELSE 'U' END
   WHEN contains(x, '李伟') THEN 'O' WHEN contains(x, '欧阳锋看到少女') THEN 'O' WHEN contains(x, '对着欧阳锋') THEN 'R' WHEN contains(x, '欧阳锋') THEN 'T' ELSE 'K' END) AS st FROM c),
o AS (SELECT *, list_transform(range(1, len(cl) + 1), lambda i: right(list_reduce(list_prepend('U', st[1 : i]), lambda a, x: CASE WHEN x = 'K' THEN a WHEN x = 'R' THEN CASE a WHEN 'O' THEN 'O' ELSE 'T' END ELSE x END), 1)) AS ow FROM k),
u AS (SELECT book_id, chapter_index, n, others, unnest(cl) AS clause, unnest(ow) AS owner, generate_subscripts(cl, 1) AS i FROM o),
f AS (SELECT * FROM (VALUES {_FIELD_ROWS}) v(field, p)),
e AS (SELECT u.*, field FROM u JOIN f ON regexp_matches(clause, p) WHERE owner = 'T' OR (owner = 'U' AND NOT others)),
t AS (SELECT book_id, field, clause, min(struct_pack(c := chapter_index, n := n, i := i)) AS first FROM e GROUP BY ALL),
m AS (SELECT book_id, field, string_agg(clause, '；' ORDER BY first) AS text FROM t GROUP BY ALL),
g AS (SELECT book_id, count(*) AS filled, string_agg(field || '=' || text, '|' ORDER BY field) AS fields FROM m GROUP BY book_id),
x AS (SELECT book_id, count(DISTINCT struct_pack(c := chapter_index, n := n)) AS n_evidence FROM e GROUP BY book_id)
SELECT b.book_id::VARCHAR AS book_id, coalesce(fields, '') AS fields, coalesce(n_evidence, 0) AS n_evidence, CASE WHEN n_evidence IS NULL THEN 'none' WHEN n_evidence >= 2 AND filled >= 4 THEN 'strong' ELSE 'partial' END AS coverage,
       coalesce(round(0.7 * filled / 7 + 0.3 * least(n_evidence / 4, 1), 2), 0)::DOUBLE AS confidence
FROM (SELECT DISTINCT book_id FROM b) b LEFT JOIN g USING (book_id) LEFT JOIN x USING (book_id)""")
def owned_packs(spark, sf):
    """Whole packs of one person: the fields that its own clauses tell, their evidence, coverage and confidence."""
    c = F.col("text")
    for a, b in _owned_put.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    chaps = _t(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("book_id"), F.col("turn").cast("int").alias("chapter_index"), c.alias("content"))
    none = F.array().cast("array<string>")
    who = chaps.select("book_id").distinct().withColumn("name", F.explode(F.array(F.lit("欧阳锋"), F.lit("李伟")))).withColumn("aliases", none)
    rows = assembly.packs(who, chaps, "character").filter("name = '欧阳锋'")
    fields = F.array_join(F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
    return rows.select("book_id", fields.alias("fields"), F.col("n_evidence").cast("long").alias("n_evidence"), F.col("source_coverage").alias("coverage"), "confidence")


@query("""WITH d AS (SELECT c_custkey, c_mktsegment AS one, CASE c_custkey % 5 WHEN 0 THEN c_mktsegment || '；' || c_name WHEN 1 THEN repeat('长', 221) WHEN 2 THEN NULL WHEN 3 THEN '；；' || c_name ELSE c_name END AS d FROM customer)
SELECT c_custkey, c_custkey % 5 IN (0, 1) AND d <> '' AS fuse FROM d""")
def needs_fusion(spark, sf):
    k = F.col("c_custkey") % 5
    d = F.when(k == 0, F.concat("c_mktsegment", F.lit("；"), "c_name")).when(k == 1, F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(221)), lambda i: F.element_at(F.array(*[F.lit(x) for x in "甲乙丙丁戊己庚辛壬癸子"]), i % 11 + 1)))).when(k == 3, F.concat(F.lit("；；"), "c_name")).when(k == 4, F.col("c_name"))
    return _t(spark, sf, "customer").select("c_custkey", assembly.needs_fusion(d).alias("fuse"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new ' || c_custkey ELSE c_mktsegment END AS description FROM customer""")
def fused_or_kept(spark, sf):
    c = _t(spark, sf, "customer")
    rows = c.select(F.lit(0).alias("book_id"), F.col("c_custkey").cast("string").alias("name"), "c_custkey", F.col("c_mktsegment").alias("description"))
    answers = c.filter("c_custkey % 2 = 0").select(F.lit(0).alias("book_id"), F.col("c_custkey").cast("string").alias("name"), F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("new "), F.col("c_custkey").cast("string"))).otherwise(F.lit("  ")).alias("description"))
    return assembly.fused_or_kept(rows, answers).select("c_custkey", "description")


@query("""SELECT s_suppkey, s_suppkey % 3 = 0 OR s_suppkey % 40 >= 20 AS person, s_suppkey % 3 = 0 OR s_suppkey % 40 >= 5 OR (s_suppkey % 100) / 100.0 >= 0.38 OR s_suppkey % 7 >= 3 AS item, s_suppkey % 3 = 0 OR s_suppkey % 40 >= 5 OR (s_suppkey % 100) / 100.0 >= 0.34 OR s_suppkey % 7 >= 2 AS location FROM supplier""")
def major_entities(spark, sf):
    k = F.col("s_suppkey")
    rows = _t(spark, sf, "supplier").select("s_suppkey", F.when(k % 3 == 0, "core").when(k % 3 == 1, "candidate").alias("tier"), (k % 40).alias("mention_count"), ((k % 100) / 100.0).alias("importance_score"), (k % 7).alias("story_score"))
    return rows.select("s_suppkey", assembly.is_major("character").alias("person"), assembly.is_major("item").alias("item"), assembly.is_major("location").alias("location"))


@query("""WITH v AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'short' WHEN 2 THEN repeat('l', 130) ELSE '' END AS s, CASE c_custkey % 3 WHEN 0 THEN 'told' WHEN 1 THEN NULL ELSE ' ' END AS t FROM customer),
n AS (SELECT c_custkey, nullif(trim(coalesce(s, '')), '') AS s, nullif(trim(coalesce(t, '')), '') AS t FROM v)
SELECT c_custkey, CASE WHEN s IS NULL THEN t WHEN length(s) > 120 THEN coalesce(t, substr(s, 1, 120)) ELSE s END AS body, s IS NULL AND t IS NOT NULL AS inferred, coalesce(length(s) > 120 AND t IS NOT NULL, false) AS summarized FROM n""")
def visual_fields(spark, sf):
    k3, k4 = F.col("c_custkey") % 3, F.col("c_custkey") % 4
    source = F.create_map(F.lit("body"), F.when(k4 == 1, "short").when(k4 == 2, F.repeat(F.lit("l"), F.lit(130))).when(k4 == 3, ""))
    told = F.create_map(F.lit("body"), F.when(k3 == 0, "told").when(k3 == 2, " "))
    f = assembly.visual_fields(source, told, ("body",))
    return _t(spark, sf, "customer").select("c_custkey", F.element_at(f["fields"], F.lit("body")).alias("body"), (F.size(f["inferred"]) > 0).alias("inferred"), (F.size(f["summarized"]) > 0).alias("summarized"))


@query("""WITH s AS (SELECT c_nationkey AS story_id, 'c' || c_custkey AS name, 'c' || c_custkey || (['', ' walks', ' walks over the long road today'])[cast(c_custkey % 3 + 1 AS BIGINT)] AS said FROM customer), a AS (SELECT story_id, name, 'character' AS asset_type, 'main_characters' AS role, 0.9::DOUBLE AS confidence, said FROM s UNION ALL SELECT story_id, name, 'prop', 'props', 0.7::DOUBLE, said FROM s)
SELECT 's' || story_id AS story_id, asset_type, name, role, confidence, CASE WHEN length(said) < 18 THEN 'thin' ELSE 'good' END AS quality, CASE WHEN confidence >= 0.75 THEN 'confirmed' ELSE 'candidate' END AS status FROM a""")
def story_assets(spark, sf):
    return assembly.story_assets(_stories(spark, sf)).select("story_id", "asset_type", "name", "role", "confidence", "quality", "status")


def _stories(spark, sf) -> DataFrame:
    """A story for each nation, told of by one sentence a customer."""
    name = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    said = F.concat(name, F.element_at(F.array(F.lit(""), F.lit(" walks"), F.lit(" walks over the long road today")), (F.col("c_custkey") % 3 + 1).cast("int")))
    rows = _t(spark, sf, "customer").select("c_nationkey", "c_custkey", name.alias("name"), said.alias("said"))
    people = F.transform(F.array_sort(F.collect_list(F.struct(F.length("name").alias("l"), "name", "said"))), lambda x: x["name"])
    # Longer names first, so that no sentence of another name holds one before its own.
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.length("name").alias("l"), F.col("c_custkey").alias("k"), "said"))), lambda x: x["said"]), "!\n")
    none = F.array().cast("array<string>")
    return rows.groupBy(F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("story_id")).agg(people.alias("main_characters"), text.alias("source_text")).withColumns({"approved": F.lit(True), "supporting_characters": none, "locations": none, "props": F.col("main_characters")})


@query("""WITH q AS (SELECT 's' || c_nationkey AS story_id, 'c' || c_custkey AS name, length('c' || c_custkey || (['', ' walks', ' walks over the long road today'])[cast(c_custkey % 3 + 1 AS BIGINT)]) < 18 AS thin FROM customer)
SELECT story_id, 'character' AS asset_type, name, 'thin_description' AS issue FROM q WHERE thin UNION ALL SELECT story_id, 'prop', name, 'thin_description' FROM q WHERE thin UNION ALL SELECT story_id, 'prop', name, 'low_confidence' FROM q""")
def asset_warnings(spark, sf):
    return assembly.asset_warnings(assembly.story_assets(_stories(spark, sf)))


@query("""SELECT 's' || c_nationkey AS story_id, 'c' || c_custkey AS name, 'c' || c_custkey || '，四视图角色设定图' || chr(10) || '外貌描写：' || 'c' || c_custkey || (['', ' walks', ' walks over the long road today'])[cast(c_custkey % 3 + 1 AS BIGINT)] || chr(10) || '仅使用原文支持的细节，未确认的维度保持空白' ||
CASE WHEN length('c' || c_custkey || (['', ' walks', ' walks over the long road today'])[cast(c_custkey % 3 + 1 AS BIGINT)]) < 18 THEN chr(10) || '⚠ 描写不足，以下维度需要重点补写' ELSE '' END AS prompt FROM customer""")
def asset_prompts(spark, sf):
    return assembly.asset_prompts(assembly.story_assets(_stories(spark, sf)), supplement=False).filter("asset_type = 'character'").select("story_id", "name", F.regexp_replace("prompt", "!\n", "\n").alias("prompt"))


_PLAN = """s AS (SELECT o_orderkey AS story_id, o_orderkey % 2 = 0 AS approved, 'T' || o_orderkey AS title, o_orderpriority AS cc, o_orderstatus AS trig, CASE o_orderkey % 3 WHEN 0 THEN [] WHEN 1 THEN ['a'] ELSE ['a', 'b'] END AS tp FROM orders)"""


def _planned(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    turns = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return _t(spark, sf, "orders").select(k.alias("story_id"), (k % 2 == 0).alias("approved"), F.concat(F.lit("T"), k.cast("string")).alias("title"), F.col("o_orderpriority").alias("core_conflict"), F.col("o_orderstatus").alias("trigger"), turns.alias("turning_points"))


@query(f"WITH {_PLAN} SELECT story_id, 1::BIGINT AS episode_no, title || '：' || coalesce(tp[1], trig) AS title, cc AS conflict, trig AS hook, coalesce(tp[1], trig) AS turning_point, coalesce(tp[2], '冲突尚未解决，新的选择逼近。') AS ending, 90::BIGINT AS duration_s FROM s WHERE approved")
def episode_plans(spark, sf):
    return assembly.episode_plan(_planned(spark, sf))


@query(f"""WITH {_PLAN} SELECT story_id FROM s WHERE approved AND story_id % 5 <> 0 AND trim(trig) <> ''""")
def gated_stories(spark, sf):
    """Approved stories whose first episode has a hook, an ending and scenes (none where the key is divisible by five)."""
    st = _planned(spark, sf)
    ep = assembly.episode_plan(st).withColumns({"story_conflict": F.col("conflict"), "n_scenes": (F.col("story_id") % 5).cast("int")})
    return assembly.gated(st, assembly.script_review(ep)).select("story_id")


@query("""SELECT c_nationkey::BIGINT AS book_id, md5(string_agg('## ' || c_name || chr(10) || chr(10) || c_mktsegment, chr(10) || chr(10) ORDER BY CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, c_name)) AS value_md5 FROM customer GROUP BY ALL""")
def prompt_summary(spark, sf):
    k = F.col("c_custkey") % 3
    rows = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("book_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("prompt"), F.when(k == 0, "high").when(k == 1, "medium").otherwise("low").alias("quality"))
    return assembly.prompt_summary(rows).select("book_id", F.md5(F.encode("value", "utf-8")).alias("value_md5"))


# -- files, tables, exports -----------------------------------------------------


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'gb18030' ELSE 'utf-8' END AS encoding, md5(CASE WHEN doc_id % 3 = 0 THEN '李伟说好' || doc_id ELSE coalesce(text, '') END) AS text_md5 FROM documents""")
def decoded_files(spark, sf):
    """Documents as bytes: every third in GB18030, every third of UTF-8 ones behind a byte order mark."""
    k = F.col("doc_id") % 3
    gb = F.concat(F.unhex(F.lit("李伟说好".encode("gb18030").hex())), F.encode(F.col("doc_id").cast("string"), "utf-8"))
    content = F.when(k == 0, gb).when(k == 1, F.encode(F.concat(F.lit("﻿"), F.coalesce("text", F.lit(""))), "utf-8")).otherwise(F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    out = text_files.decoded(_t(spark, sf, "documents").select("doc_id", content.alias("content")))
    return out.select("doc_id", "encoding", F.md5(F.encode("text", "utf-8")).alias("text_md5"))


_REPORT_COLUMNS = "printf('%.3f', (s_suppkey % 10) / 10.0)"


@query(f"""SELECT cast(s_nationkey AS BIGINT) AS book_id, 's' || s_suppkey || '|' || (s_suppkey % 7) || '|' || {_REPORT_COLUMNS} || '|1|1|0|' || {_REPORT_COLUMNS} || '|' || {_REPORT_COLUMNS} || '|' || {_REPORT_COLUMNS} || '|' || {_REPORT_COLUMNS} || '|' || (s_suppkey % 40) || '|core|main' AS line FROM supplier""")
def report_lines(spark, sf):
    return text_files.report_lines(_scored(spark, sf)).select("book_id", "line")


def _scored(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    x = (k % 10) / 10.0
    one = {"story_score": k % 7, "story_value": x, "causal_necessity": F.lit(1), "information": F.lit(1), "transition": F.lit(0), "writing_completeness": x, "adaptation_usability": x, "production": x, "importance": x, "mention_count": k % 40, "tier": F.lit("core"), "route": F.lit("main")}
    return _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("book_id"), F.lit("item").alias("type"), F.concat(F.lit("s"), k.cast("string")).alias("text"), *[c.alias(n) for n, c in one.items()])


@query("""SELECT cast(s_nationkey AS BIGINT) AS doc, 'item' AS type, 's' || s_suppkey AS text, cast(s_suppkey % 40 AS VARCHAR) AS mention_count, 'main' AS route FROM supplier""")
def parsed_reports(spark, sf):
    """Report lines below a heading, with summaries between, parsed back."""
    lines = text_files.report_lines(_scored(spark, sf)).select(F.col("book_id").alias("doc"), (F.row_number().over(Window.partitionBy("book_id").orderBy("line")) + 1).alias("n"), "line")
    head = lines.select("doc").distinct().select("doc", F.lit(0).alias("n"), F.lit("## item report").alias("line"))
    total = lines.select("doc").distinct().select("doc", F.lit(1).alias("n"), F.lit("total: many").alias("line"))
    return text_files.parsed_report(head.unionByName(total).unionByName(lines)).select("doc", "type", "text", "mention_count", "route")


@query("""WITH t AS (SELECT s_nationkey, s_suppkey, (['core', 'supporting', 'candidate', 'archived'])[cast(s_suppkey % 4 + 1 AS BIGINT)] AS tier, (['main', 'staging', 'archive'])[cast(s_suppkey % 3 + 1 AS BIGINT)] AS route FROM supplier)
SELECT cast(s_nationkey AS BIGINT) AS book_id, count(*) FILTER (tier = 'core') AS n_core, count(*) FILTER (tier = 'supporting') AS n_supporting, count(*) FILTER (tier = 'candidate') AS n_candidate, count(*) FILTER (tier = 'archived') AS n_archived,
count(*) FILTER (route = 'main') AS n_main, count(*) FILTER (route = 'staging') AS n_staging, count(*) FILTER (route = 'archive') AS n_archive FROM t GROUP BY ALL""")
def report_counts(spark, sf):
    k = F.expr("cast(substring(text, 2) as long)")
    pick = lambda *words: F.element_at(F.array(*[F.lit(w) for w in words]), (k % len(words) + 1).cast("int"))
    rows = _scored(spark, sf).withColumns({"tier": pick("core", "supporting", "candidate", "archived"), "route": pick("main", "staging", "archive")})
    return text_files.report_counts(rows).drop("type")


@query("""SELECT cast(n_nationkey AS BIGINT) AS book_id, '{"book":{"book_id":' || n_nationkey || ',"title":"' || n_name || '"},"kind":"item","kindLabel":"Items"' || coalesce(',"items":[' || string_agg('{"name":"s' || s_suppkey || '","n":' || (s_suppkey % 9) || '}', ',' ORDER BY s_suppkey) || ']', '') || '}' AS value
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name""")
def json_export(spark, sf):
    return exports.export(_suppliers(spark, sf), "item", "json", _nations(spark, sf))


def _nations(spark, sf) -> DataFrame:
    return _t(spark, sf, "nation").select(F.col("n_nationkey").alias("book_id"), F.col("n_name").alias("title"))


def _suppliers(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    return _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("book_id"), k.alias("seq"), F.concat(F.lit("s"), k.cast("string")).alias("name"), (k % 9).alias("n"))


@query("""WITH b AS (SELECT s_nationkey, s_suppkey, '### s' || s_suppkey || chr(10) || chr(10) || '**Aliases:** a, b' || chr(10) || chr(10) || 'D' || chr(10) || chr(10) || '| Property | Value |' || chr(10) || '|----------|-------|' || chr(10) || '| Confidence | ' || printf('%.1f%%', (s_suppkey % 10) * 10.0) || ' |' || chr(10) || '| Status | ok |' || chr(10) ||
  CASE WHEN s_suppkey % 9 > 0 THEN '| Mentions | ' || (s_suppkey % 9) || ' |' || chr(10) ELSE '' END || chr(10) || '---' || chr(10) AS block FROM supplier)
SELECT cast(n_nationkey AS BIGINT) AS book_id, '# ' || n_name || chr(10) || chr(10) || '## Characters (' || count(s_suppkey) || ')' || chr(10) || chr(10) || coalesce(string_agg(block, chr(10) ORDER BY s_suppkey), '') AS value FROM nation LEFT JOIN b ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name""")
def markdown_export(spark, sf):
    rows = _suppliers(spark, sf).withColumns({"aliases": F.array(F.lit("a"), F.lit("b")), "description": F.lit("D"), "confidence": (F.col("seq") % 10) / 10.0, "status": F.lit("ok"), "mention_count": F.col("n")}).drop("n")
    return exports.export(rows, "character", "markdown", _nations(spark, sf))


@query("""SELECT cast(s_nationkey AS BIGINT) AS book_id, 'item' AS type, count(*) AS n, string_agg('s' || s_suppkey, ',' ORDER BY 's' || s_suppkey) AS names FROM supplier GROUP BY ALL""")
def run_summaries(spark, sf):
    out = exports.run_summary(_suppliers(spark, sf).withColumn("type", F.lit("item")))
    return out.select("book_id", "type", "n", F.array_join("names", ",").alias("names"))


@query("""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN 'APPROVED' ELSE o_orderstatus END AS status FROM orders) SELECT id, status FROM r""")
def batch_review(spark, sf):
    rows = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), "o_custkey")
    return tables.review(rows.drop("o_custkey"), rows.filter("o_custkey % 2 = 0").select("id"), "approve", "APPROVED", "u")[0]


@query("""SELECT o_orderkey AS entity_id, 'u' AS user_id, 'approve' AS action, o_orderstatus AS previous_value, 'APPROVED' AS new_value FROM orders WHERE o_custkey % 2 = 0""")
def review_log(spark, sf):
    rows = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), "o_custkey")
    return tables.review(rows.drop("o_custkey"), rows.filter("o_custkey % 2 = 0").select("id"), "approve", "APPROVED", "u")[1]


def _sorted_search(order: str, sql_order: str):
    @query(f"""WITH r AS (SELECT c_custkey AS id, c_name AS name, [c_mktsegment] AS aliases, c_acctbal AS confidence, c_custkey % 50 AS mention_count, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 20 END AS first_chapter FROM customer WHERE contains(lower(c_mktsegment), 'build') OR contains(lower(c_name), 'build')) SELECT id, row_number() OVER (ORDER BY {sql_order}, id) AS place FROM r""")
    def run(spark, sf):
        k = F.col("c_custkey")
        rows = _t(spark, sf, "customer").select(k.alias("id"), F.col("c_name").alias("name"), F.array("c_mktsegment").alias("aliases"), F.col("c_acctbal").alias("confidence"), (k % 50).alias("mention_count"), F.when(k % 3 > 0, k % 20).alias("first_chapter"))
        return tables.numbered(tables.searched(rows, "BUILD", order), tables.search_order(order)).select("id", "place")

    for store in (catalog.QUERIES, catalog.ORACLE_SQL):
        store[f"search_by_{order}"] = store.pop("run")


for _order, _sql in (("confidence", "confidence DESC"), ("mentions", "mention_count DESC"), ("first_chapter", "first_chapter ASC NULLS LAST"), ("name", "name")):
    _sorted_search(_order, _sql)


@query("""SELECT o_orderkey AS id, o_orderdate AS created_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O'""")
def books_by_user(spark, sf):
    """Open orders of each customer as the books of a user, the newest first."""
    rows = tables.by_book(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status")), status="O", order=[F.desc("created_at"), F.col("id")])
    return rows.select("id", "created_at", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("created_at"), "id")).alias("place"))


@query("""SELECT p_partkey AS id, p_size::BIGINT AS size FROM part WHERE p_brand = 'Brand#13' AND p_size % 5 = 0 UNION ALL SELECT -count(*), 0::BIGINT FROM part WHERE p_brand = 'Brand#13'""")
def items_by_tier(spark, sf):
    rows = _t(spark, sf, "part").select(F.col("p_brand").alias("book_id"), F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 == 0, "MED BAG").otherwise("").alias("tier"), F.col("p_size").cast("long").alias("size"))
    some = tables.by_book(rows, "Brand#13", [F.desc("size")], tier="MED BAG").select("id", "size")
    return some.unionByName(tables.by_book(rows, "Brand#13", tier=None).agg((-F.count("*")).alias("id")).withColumn("size", F.lit(0).cast("long")))


@query("""WITH d AS (SELECT doc_id, n_chars FROM documents), l AS (SELECT doc_id FROM labels) SELECT (SELECT count(*) FROM d) AS "left", (SELECT count(*) FROM l) AS "right", (SELECT count(*) FROM d WHERE doc_id NOT IN (SELECT doc_id FROM l)) AS only_left, (SELECT count(*) FROM l WHERE doc_id NOT IN (SELECT doc_id FROM d)) AS only_right""")
def table_parity(spark, sf):
    told = tables.parity(_t(spark, sf, "documents").select("doc_id"), _t(spark, sf, "labels").select("doc_id"))
    return spark.createDataFrame([tuple(told[k] for k in ("left", "right", "only_left", "only_right"))], '`left` long, `right` long, only_left long, only_right long')


@query("""SELECT user_id AS book_id, event_type AS type, count(*) AS n, count(DISTINCT event_id % 3) AS n_status FROM events GROUP BY ALL""")
def entity_report(spark, sf):
    """Counts by book, type and status, and how many statuses there are."""
    rows = _t(spark, sf, "events").select(F.col("user_id").alias("book_id"), F.col("event_type").alias("type"), (F.col("event_id") % 3).alias("status"))
    return tables.count_report(rows, ["book_id", "type"], "status")


@query("""WITH w AS (SELECT unnest(['click', 'view', 'purchase']) AS stage, unnest([25, 10, 15]) AS w), e AS (SELECT CAST(user_id AS VARCHAR) AS book_id, event_type AS stage, arg_max(CASE event_id % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'RUNNING' ELSE 'FAILED' END, struct_pack(ts := ts, s := CASE event_id % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'RUNNING' ELSE 'FAILED' END)) AS status FROM events GROUP BY ALL)
SELECT book_id, sum(CASE status WHEN 'COMPLETED' THEN coalesce(w, 0) WHEN 'RUNNING' THEN coalesce(w, 0) / 2.0 ELSE 0 END)::DOUBLE AS progress, max(status = 'FAILED' AND w IS NOT NULL) AS failed FROM e LEFT JOIN w USING (stage) GROUP BY book_id""")
def progress_of_events(spark, sf):
    """The streaming state machine in its batch form: the last status of each stage, weighed."""
    k = F.col("event_id") % 3
    rows = _t(spark, sf, "events").select(F.col("user_id").cast("string").alias("book_id"), F.col("event_type").alias("stage"), F.when(k == 0, "COMPLETED").when(k == 1, "RUNNING").otherwise("FAILED").alias("status"), "ts")
    return progress.progress(rows, {"click": 25, "view": 10, "purchase": 15})


@query("""SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type AS status, count(*) AS n FROM events GROUP BY ALL""")
def windowed_events(spark, sf):
    return progress.windowed_counts(_t(spark, sf, "events").select("ts", F.col("event_type").alias("status")))


_CATEGORY_SQL = catalog._SUSPECTS


@query(f"WITH {_CATEGORY_SQL}, chx AS (SELECT doc_id, c AS chapter_index, c * 20 + 1 AS a, c * 20 + 20 AS z FROM (SELECT doc_id, unnest(range(0, (len(string_split(coalesce(text, ''), chr(10))) + 19) // 20)) AS c FROM documents)) SELECT b.doc_id, chapter_index, line_num, category FROM b JOIN chx ON chx.doc_id = b.doc_id AND line_num BETWEEN a AND z")
def noise_by_chapter(spark, sf):
    docs = _t(spark, sf, "documents")
    n_chapters = F.ceil(F.size(F.split(F.coalesce("text", F.lit("")), "\n")) / 20).cast("int")
    chaps = docs.select("doc_id", F.explode(F.sequence(F.lit(0), n_chapters - 1)).alias("chapter_index")).withColumns({"start_line": F.col("chapter_index") * 20 + 1, "end_line": F.col("chapter_index") * 20 + 20})
    return noise.in_range(noise.detect(docs, lex=catalog.LATIN), chaps).select("doc_id", "chapter_index", "line_num", "category")


_TAILS = "repeat(chr(10) || chr(10) || chr(10) || 'one more line' || chr(10) || 'the same tail', 4)"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || " + " || ".join(f"chr({ord(c)})" for c in T.IRREGULAR_SPACES + "\ufeff")


@query(f"""WITH o AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN repeat(chr(10) || chr(10) || chr(10) || 'section', (doc_id % 9)::INTEGER) ELSE '' END || {_TAILS} AS t FROM documents),
s AS (SELECT doc_id, unnest(string_split(t, chr(10) || chr(10) || chr(10))) AS s FROM o),
b AS (SELECT doc_id, string_split(trim(s, {_BLANKS}), chr(10)) AS l FROM s WHERE trim(s, {_BLANKS}) <> ''),
n AS (SELECT doc_id, count(*) AS sections FROM b GROUP BY doc_id),
u AS (SELECT doc_id, trim(unnest(l[greatest(len(l) - 4, 1) :]), {_BLANKS}) AS tail FROM b),
r AS (SELECT doc_id, tail FROM u JOIN n USING (doc_id) WHERE length(tail) > 3 AND sections >= 4 GROUP BY doc_id, tail, sections HAVING 2 * count(*) >= sections),
x AS (SELECT doc_id, trim(unnest(string_split(t, chr(10))), {_BLANKS}) AS line FROM o)
SELECT o.doc_id, (SELECT count(*) FROM x WHERE x.doc_id = o.doc_id AND line IN ('the same tail', 'one more line') AND (x.doc_id, line) IN (SELECT doc_id, tail FROM r)) AS n_tails,
       (SELECT count(*) FROM r WHERE r.doc_id = o.doc_id) AS n_kinds FROM o""")
def aggressive_cleaning(spark, sf):
    """Each document, some with more sections, and four sections of one tail behind it: where these are half of all, aggressive cleaning alone takes their lines."""
    more = F.when(F.col("doc_id") % 3 == 0, F.repeat(F.lit("\n\n\nsection"), (F.col("doc_id") % 9).cast("int"))).otherwise("")
    text = F.concat(F.coalesce("text", F.lit("")), more, F.repeat(F.lit("\n\n\none more line\nthe same tail"), F.lit(4)))
    docs = _t(spark, sf, "documents").select("doc_id", text.alias("text"))
    some, none = noise.cleaned(docs, aggressive=True), noise.cleaned(docs)
    left = lambda c: F.regexp_count(c, F.lit("(?m)^(?:the same tail|one more line)$")).cast("long")
    kinds = noise.repeated_tails(docs).groupBy("doc_id").agg(F.count("*").alias("n_kinds"))
    both = none.select("doc_id", left("text").alias("n")).join(some.select("doc_id", left("text").alias("m")), "doc_id").join(kinds, "doc_id", "left")
    return both.select("doc_id", (F.col("n") - F.col("m")).alias("n_tails"), F.coalesce("n_kinds", F.lit(0)).cast("long").alias("n_kinds"))


_MIGRATED = "SELECT o_orderkey AS id, o_custkey, CASE WHEN o_orderkey % 997 = 0 THEN 'changed' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 1499 <> 0 UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 2003 = 0 AND o_orderkey % 1499 <> 0"


@query(f"""WITH a AS (SELECT o_orderkey AS id, o_custkey, o_orderstatus AS status FROM orders), b AS ({_MIGRATED}),
x AS (SELECT *, count(*) AS n FROM a GROUP BY ALL), y AS (SELECT *, count(*) AS n FROM b GROUP BY ALL),
d AS (SELECT DISTINCT coalesce(x.id, y.id) // 100 AS range FROM x FULL JOIN y ON x.id = y.id AND x.o_custkey = y.o_custkey AND x.status = y.status AND x.n = y.n WHERE x.id IS NULL OR y.id IS NULL)
SELECT range, (SELECT count(*) FROM a WHERE id // 100 = range) AS "left", (SELECT count(*) FROM b WHERE id // 100 = range) AS "right" FROM d""")
def differing_ranges(spark, sf):
    """Orders after a migration that lost, doubled and changed some rows: the key ranges that do not match."""
    rows = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_orderstatus").alias("status"))
    held = rows.filter("id % 1499 <> 0")
    moved = held.withColumn("status", F.when(F.col("id") % 997 == 0, "changed").otherwise(F.col("status"))).unionByName(held.filter("id % 2003 = 0"))
    return tables.differing_ranges(rows, moved, "id", 100)


# -- whole scans and resolution -------------------------------------------------

_HINTED = " OR ".join(f"contains(s, '{h}')" for h in lex.EVENT_HINTS)


@query(f"""WITH {BOOKS}, s AS (SELECT book_id, chapter_index, unnest(regexp_extract_all(content, '[^。！？!?；;\\n]{{4,120}}')) AS s FROM b), t AS (SELECT *, contains(s, '追杀') AND ({_HINTED}) AS traced FROM s)
SELECT DISTINCT book_id, chapter_index, CASE WHEN contains(s, '萧炎写下休书') THEN '萧炎写下休书' ELSE '药老从戒指中现身' END AS text, CASE WHEN contains(s, '萧炎写下休书') THEN 0.86::DOUBLE ELSE 0.84::DOUBLE END AS confidence
FROM t WHERE NOT traced AND (contains(s, '萧炎写下休书') OR (contains(s, '药老') AND regexp_matches(s, '戒指|现身|苏醒')))""")
def scan_events(spark, sf):
    """Of the phrases two tell an event; a chase whose hunter is unknown tells none, and hides what else its sentence tells."""
    return scanners.scan_events(books(spark, sf)).select("book_id", "chapter_index", "text", "confidence")


#: Sentences put in for frequent words: what they say, what is told of it (or nothing), and how surely.
_TOLD = (
    ("许七安追杀魏渊", "许七安追杀魏渊", 0.85), ("李玉春死亡，原因不明", "李玉春死亡", 0.85), ("宋廷风失踪了", "宋廷风失踪", 0.85), ("魏渊派遣许七安前往云州调查案情", "魏渊派遣许七安前往云州", 0.85), ("圣上下令，周立于菜市口斩首", "圣上下令斩首周立", 0.85),
    ("许七安破获税银案，大喜", "许七安破获税银案", 0.85), ("许七安调查衣袖", None, 0.0), ("许七安救下苏苏", "许七安救下苏苏", 0.85), ("纳兰嫣然来解除婚约", "纳兰嫣然要求解除婚约", 0.86), ("萧战取出聚气散", "萧战拿出聚气散", 0.84), ("药老苏醒", "药老从戒指中现身", 0.84),
    ("萧炎，为了炼药去借钱", "萧炎为炼药筹钱", 0.78), ("三年之后，少年要挑战云岚宗", None, 0.0),
)
_PUT_IN = ((" the ", (0, 1, 2, 12)), (" and ", (3, 4, 6)), (" of ", (5, 7, 8)), (" in ", (9, 10)), (" to ", (11,)), (" la ", (0, 3, 5, 9)), (" de ", (1, 4, 7, 12)), (" el ", (2, 8, 10)), (" und ", (0, 1, 2, 3, 4)), (" der ", (5, 6, 7)), (" die ", (8, 9, 12)))
_put = {w: "。" + "".join(_TOLD[k][0] + "。" for k in ks) for w, ks in _PUT_IN}
_EV = "text"
for _w, _p in _put.items():
    _EV = f"replace({_EV}, '{_w}', '{_p}')"


@query(f"""WITH b AS (SELECT cast(conv_id AS VARCHAR) AS book_id, turn AS chapter_index, {_EV} AS content FROM conversations),
p AS (SELECT unnest({[x for x, t, _ in _TOLD if t]}) AS phrase, unnest({[t for _, t, _ in _TOLD if t]}) AS text, unnest({[c for _, t, c in _TOLD if t]}::DOUBLE[]) AS confidence),
own AS (SELECT book_id, chapter_index, '萧炎立下三年之约' AS text, instr(content, '三年之后') - 1 AS position, 0.88::DOUBLE AS confidence FROM b WHERE contains(content, '三年之后')),
f AS (SELECT b.book_id, b.chapter_index, p.text, instr(content, '。' || phrase) AS position, p.confidence, (SELECT count(*) FROM own WHERE own.book_id = b.book_id AND own.chapter_index = b.chapter_index) AS n_own FROM b, p WHERE contains(content, '。' || phrase)),
k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY book_id, chapter_index ORDER BY position) <= 8 - n_own),
u AS (SELECT * EXCLUDE n_own FROM k UNION ALL SELECT * FROM own)
SELECT *, row_number() OVER (PARTITION BY book_id, chapter_index ORDER BY position) AS place FROM u""")
def told_events(spark, sf):
    """Events by triggers, narrative rules and whole chapters, each once, of which a chapter tells eight at most."""
    c = F.col("text")
    for a, b in _put.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    rows = _t(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("book_id"), F.col("turn").cast("int").alias("chapter_index"), c.alias("content"))
    out = scanners.scan_events(rows)
    return out.select("book_id", "chapter_index", "text", F.col("position").cast("long").alias("position"), "confidence", (F.pmod("seq", F.lit(1_000_000)) + 1).alias("place"))


@query()
def prescan_entities(spark, sf):
    """The whole scan over all books: patterns, frequent and given names, a model's completion, aliases, confidence, importance, selection (the tests compare it with its steps)."""
    chaps = books(spark, sf)
    answers = chaps.select("book_id", F.floor(F.col("chapter_index") / 10).cast("int").alias("batch")).distinct().withColumns({"type": F.lit("item"), "text": F.lit("古玉盒"), "confidence": F.lit(0.8)})
    out = prescan.scan(chaps, _alias_table(spark), least=2, names=spark.createDataFrame([(n,) for n in _NAMES], "name string"), answers=answers)
    score = out["importance"].select("book_id", "type", "text", "importance", "story_tier").join(out["confidence"].select("book_id", "type", "text", "overall"), ["book_id", "type", "text"])
    return out["selected"].select("book_id", "type", "text", "total_count").join(score, ["book_id", "type", "text"])


@query("""WITH p AS (SELECT s_nationkey % 5 AS book_id, s_suppkey AS seq, CASE WHEN s_suppkey % 2 = 0 THEN 'S' ELSE 's' END || (s_suppkey % 9) AS name, s_acctbal / 10000 AS confidence, s_suppkey % 30 AS f, s_suppkey % 30 + 5 AS l FROM supplier)
SELECT cast(book_id AS VARCHAR) AS book_id, min(seq) AS seq, arg_min(name, seq) AS name, max(confidence)::DOUBLE AS confidence, min(f) AS first_chapter, max(l) AS last_chapter, count(*) AS mention_count, count(*) - 1 AS merged FROM p GROUP BY ALL, lower(name)""".replace("GROUP BY ALL, lower(name)", "GROUP BY book_id, lower(name)"))
def resolved_people(spark, sf):
    """People of one name in either case are one."""
    return resolution.resolve(_people_rows(spark, sf)).select("book_id", "seq", "name", "confidence", "first_chapter", "last_chapter", "mention_count", "merged")


def _people_rows(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.concat(F.when(k % 2 == 0, "S").otherwise("s"), (k % 9).cast("string"))
    strings = F.array().cast("array<string>")
    robe = F.struct(F.concat(F.lit("robe "), F.repeat(F.lit("x"), (k % 4).cast("int"))).alias("description"), F.lit("court").alias("scene"), (k % 30).cast("int").alias("first_chapter"), (k % 30 + 5).cast("int").alias("last_chapter"))
    return _t(spark, sf, "supplier").select(
        (F.col("s_nationkey") % 5).cast("string").alias("book_id"), k.alias("seq"), name.alias("name"), strings.alias("aliases"), F.lit(None).cast("string").alias("description"), (F.col("s_acctbal") / 10000).alias("confidence"), (k % 30).cast("int").alias("first_chapter"),
        (k % 30 + 5).cast("int").alias("last_chapter"), F.array(F.lit(1)).alias("chapter_appearances"), F.lit(1).cast("long").alias("mention_count"), F.lit(0).cast("long").alias("dialogue_count"), strings.alias("co_characters"), F.array(robe).alias("outfits"),
    )


@query("""WITH p AS (SELECT s_nationkey % 5 AS book_id, s_suppkey AS seq, CASE WHEN s_suppkey % 2 = 0 THEN 'S' ELSE 's' END || (s_suppkey % 9) AS name, s_suppkey % 4 AS x, s_suppkey % 30 AS f FROM supplier)
SELECT cast(book_id AS VARCHAR) AS book_id, arg_min(name, seq) AS name, 'robe ' || repeat('x', max(x)) AS description, min(f) AS first_chapter, max(f) + 5 AS last_chapter FROM p GROUP BY book_id, lower(p.name)""")
def merged_outfits(spark, sf):
    """Outfits of one scene become one, with the longest text and the whole range."""
    out = resolution.resolve(_people_rows(spark, sf)).select("book_id", "name", F.explode("outfits").alias("o"))
    return out.select("book_id", "name", "o.description", F.col("o.first_chapter").cast("long").alias("first_chapter"), F.col("o.last_chapter").cast("long").alias("last_chapter"))


@query("""WITH p AS (SELECT s_nationkey % 5 AS book_id, s_suppkey AS seq, CASE WHEN s_suppkey % 2 = 0 THEN 'S' ELSE 's' END || (s_suppkey % 9) AS name, s_acctbal / 10000 AS confidence FROM supplier)
SELECT cast(book_id AS VARCHAR) AS book_id, arg_max(name, struct_pack(c := confidence, s := -seq)) AS name, max(confidence)::DOUBLE AS confidence, count(*) AS mention_count FROM p GROUP BY book_id, lower(p.name)""")
def extracted_people(spark, sf):
    """The extractor's walk: of one name's rows the surest gives the spelling."""
    return resolution.extracted(_people_rows(spark, sf)).select("book_id", "name", "confidence", "mention_count")


@query("""SELECT cast(c_custkey AS VARCHAR) AS book_id, unnest(['萧炎', '药老', '张三', '张三丰']) AS name, unnest(['炎儿,萧炎哥', '药尘', '', '']) AS aliases, unnest([2, 1, 1, 1]::BIGINT[]) AS mention_count FROM customer""")
def resolved_names(spark, sf):
    """A book each customer: forms of address are merged and become aliases, generic words and collectives go, a name within another stays apart."""
    strings = "array<string>"
    rows = [(1, "萧炎", ["炎儿", "他"]), (2, "萧炎哥", ["那位少年"]), (3, "药老", ["药尘"]), (4, "张三", []), (5, "几名护卫", []), (6, "张三丰", ["大长老"])]
    told = spark.createDataFrame(rows, f"seq long, name string, aliases {strings}")
    rest = {"description": F.lit(None).cast("string"), "confidence": F.lit(0.5), "first_chapter": F.lit(1), "last_chapter": F.lit(2), "chapter_appearances": F.array(F.lit(1)), "mention_count": F.lit(1).cast("long"), "dialogue_count": F.lit(0).cast("long"), "co_characters": F.array().cast(strings), "outfits": F.array().cast("array<struct<description: string, scene: string, first_chapter: int, last_chapter: int>>")}
    people = _t(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("book_id")).crossJoin(F.broadcast(told)).withColumns(rest)
    return resolution.resolve(people).select("book_id", "name", F.array_join("aliases", ",").alias("aliases"), "mention_count")


@query(f"""WITH {BOOKS}, n AS (SELECT *, (length(content) - length(replace(content, '欧阳锋', ''))) // 3 + (length(content) - length(replace(content, '李伟', ''))) // 2 AS k FROM b) SELECT book_id, chapter_index, CASE WHEN k < 2 OR starts_with(title, 'user') AND false THEN 'sub' ELSE 'main' END AS line_type FROM n""")
def line_types(spark, sf):
    return books(spark, sf).select("book_id", "chapter_index", segmentation.line_type(F.col("title"), F.col("content"), ["欧阳锋", "李伟"], 2).alias("line_type"))


@query("""WITH d AS (SELECT doc_id, replace(coalesce(text, ''), '. ', '.' || chr(10) || '第12章 ') AS t FROM documents), p AS (SELECT doc_id, unnest(string_split(replace(t, chr(10) || '第12章', chr(10) || chr(1) || '第12章'), chr(1))) AS s FROM d)
SELECT doc_id, count(*) AS n, cast(sum(length(s)) AS BIGINT) AS chars FROM p WHERE trim(s, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)) <> '' GROUP BY doc_id""")
def simple_chapters(spark, sf):
    c = F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n第12章 "))
    rows = _t(spark, sf, "documents").select("doc_id", F.explode(segmentation.simple_chapters(c)).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT -c_custkey, 'new' FROM customer""")
def replaced_rows(spark, sf):
    """A migration's upsert: known keys are replaced, new ones added."""
    old = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    new = old.filter("id % 3 = 0").select("id", F.lit("new").alias("status")).unionByName(_t(spark, sf, "customer").select((-F.col("c_custkey")).alias("id"), F.lit("new").alias("status")))
    return tables.replaced(old, new, ["id"])


@query(f"""WITH {BOOKS}, k AS (SELECT book_id, list_distinct(flatten(list(list_filter({list(_NAMES)}, lambda x: contains(content, x))))) AS names FROM b GROUP BY book_id)
SELECT book_id, unnest(list_distinct(list_concat(names, ['李伟', '新人']))) AS name FROM k""")
def known_and_potential_names(spark, sf):
    """Known names, and potential ones that are no known name's form of address (老李伟 and 欧阳锋哥 are, 新人 is not; 小张 is not sure enough)."""
    chaps = books(spark, sf)
    names = spark.createDataFrame([(n,) for n in _NAMES], "name string")
    known = chaps.crossJoin(F.broadcast(names)).filter(F.contains("content", F.col("name"))).select("book_id", "name").unionByName(chaps.select("book_id", F.lit("李伟").alias("name"))).distinct()
    potential = chaps.select("book_id").distinct().crossJoin(F.broadcast(spark.createDataFrame([("老李伟", 0.9), ("李伟哥", 0.9), ("新人", 0.7), ("小张", 0.3)], "name string, confidence double")))
    return coreference.with_potentials(known, potential)


NAMES = [n for n in catalog.QUERIES if n not in _known]
