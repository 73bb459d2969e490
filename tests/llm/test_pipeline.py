import warnings

from pyspark.sql import functions as F

import corpus_pipeline as P
from loomwright.llm import exact_dedup, langid, mixing
from loomwright.llm.common import written

from .test_dedup import near_by_force


def kept(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    extra = spark.createDataFrame([(90_001, "12 34 !!", None, "x", 1), (90_002, None, None, None, None), (90_003, "", "en", "x", 0), (None, "The of and to in that", "en", "x", 3)], docs.schema)
    docs = written(docs.unionByName(extra), "docs")

    one = written(P.language_id(spark, docs, sf), "one")
    assert one.columns == columns and set(kept(docs.filter("doc_id < 90000"))) <= set(kept(one.filter("doc_id is not null")))
    assert not {90_001, 90_002, 90_003} & {r["doc_id"] for r in one.collect()}

    two = written(P.exact_duplicates(spark, one, sf), "two")
    want = {r["keep_id"] for r in exact_dedup.deduplicate(one).collect()}
    assert two.columns == columns and {r["doc_id"] for r in two.collect()} == want

    three = written(P.near_duplicates(spark, two, sf), "three")
    force = near_by_force([(r["doc_id"], r["text"]) for r in two.filter("doc_id is not null").collect()], 80)
    assert kept(three.filter("doc_id is not null")) == sorted(i for i, _, _, k in force if k) and three.columns == columns

    four = written(P.mixed(spark, three, sf), "four")
    times = {}
    for r in four.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert four.columns == columns and set(times) == {r["doc_id"] for r in three.collect()} and 1.02 * three.count() < four.count() < 1.3 * three.count()

    five = P.packed(spark, four, sf).collect()
    pieces = {}
    for r in five:
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + (r["piece"] == 0)
    assert pieces == times


def test_rejects_long_foreign_text(spark):
    rows = [(k, t * 200, "en" if t == "the cat and the dog " else "de", "s", 1) for k, t in enumerate(["the cat and the dog ", "der hund und die katze "] * 10)] + [(99, "щжф цчш гъй " * 200, None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    out = kept(P.language_id(spark, docs, ""))
    assert 99 not in out and len(out) == 20 and langid.UNKNOWN == "und"


def test_rejects_short_and_same_script_foreign_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    pl = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem."
    fi = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto."
    ru = "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью."
    foreign = [(90_000 + k, t, None, "x", len(t)) for k, t in enumerate([pl, fi * 2, ru, pl * 20, fi * 20, ru * 20])]
    out = {r["doc_id"] for r in P.language_id(spark, docs.unionByName(spark.createDataFrame(foreign, docs.schema)), "").select("doc_id").collect()}
    assert not out & set(range(90_000, 90_006)) and len(out) >= 0.999 * docs.count()


def test_repeated_ids(spark):
    rows = [(1, "same text here", "en", "s", 1)] * 3 + [(1, "other text", "en", "s", 1), (2, "x y", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    out = P.exact_duplicates(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [(1, "other text"), (1, "same text here"), (2, "x y")]


def test_repeated_ids_keep_the_chosen_rows(spark):
    near = " ".join(f"w{k}" for k in range(60))
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    rows = [(i, t, "en", "s", 1) for i, t in [(1, "same text here")] * 3 + [(1, "other text"), (2, "x y"), (None, "x y"), (None, "a b c"), (None, "a b c"), (None, None)]]
    out = P.exact_duplicates(spark, spark.createDataFrame(rows, schema), "")
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect()) == [("1", "other text"), ("1", "same text here"), ("2", "x y"), ("None", "None"), ("None", "a b c")]
    # the longer near-copy under the same id must not take the place of the unique one, and of a group one row stays
    rows = [(i, t, "en", "s", 1) for i, t in [(3, near), (5, near + " and more"), (5, "quite another text of few words"), (7, near + " x"), (7, near + " x y"), (9, ""), (9, ""), (None, near + " z")]]
    out = P.near_duplicates(spark, spark.createDataFrame(rows, schema), "")
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(3, near), (5, "quite another text of few words"), (9, ""), (9, "")] and out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = [(4, near + " b", "en", "s", 1), (4, near, "en", "s", 1)]
    assert P.near_duplicates(spark, spark.createDataFrame(rows, schema), "").count() == 1


def test_mixture_reaches_its_shares(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bad = labels.filter("toxic = 1 or quality = 0").select("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    third = docs.join(bad, "doc_id").unionByName(docs.join(bad, "doc_id", "left_anti").filter("doc_id % 2 = 0")).select(*docs.columns)
    for some in (docs, third):
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            out = P.mixed(spark, some, sf)
        assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in some.select("doc_id").collect()}
        rated = mixing.mix(some, mixing.domains_of(labels), mixing.DOMAINS, P.SHARES, least=1.0)
        assert rated.filter("rate < 1").isEmpty() and all(abs(x - P.SHARES[d]) < 1e-3 for d, x in mixing.shares(rated, mixing.DOMAINS).items())
        drawn = mixing.shares(out.groupBy("doc_id").count().join(rated, "doc_id").withColumn("rate", F.col("count").cast("double")), mixing.DOMAINS)
        assert all(abs(x - P.SHARES[d]) < 0.03 for d, x in drawn.items())


def test_clashing_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    more = docs.selectExpr("*", "1 as _i", "2 as _rank", "3 as kept", "4 as rate", "5 as posteriors", "6 as _lang_pred", "7 as uid", "8 as n_tokens")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, more, sf)
        assert out.columns == more.columns and out.count() > 0


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("false")
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_run(spark, sf):
    assert P.run(spark, sf).count() >= 150
