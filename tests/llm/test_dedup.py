import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import exact_dedup as X, near_dedup as N

WHITE = re.compile("[\x20\x09-\x0d]")


def exact_by_force(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(WHITE.sub("", t or ""), []).append((-len(t or ""), i))
    out = []
    for i, t in rows:
        g = groups[WHITE.sub("", t or "")]
        out.append((i, min(g)[1], len(g), i == min(g)[1], hashlib.sha256(WHITE.sub("", t or "").encode()).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    long = " ".join(word() for _ in range(9000))
    base = [long, long.replace(" ", "\n"), long + "x", "x" + long, "", None, " \t", "a b", "ab", "a b", "ß", "a" * 40_000, "a" * 40_001]
    base += [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(30)]
    return [(k, rng.choice(base)) for k in range(120)]


def test_exact(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("recipe", F.lit(1)).withColumn("uid", F.lit(2))
    assert rows_of(X.deduplicate(df)) == exact_by_force(rows)


@pytest.mark.parametrize("width", [1, 2])
def test_colliding_identifiers_are_settled_by_bytes(spark, width):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(X.deduplicate(df, digest=lambda b: hashlib.sha256(b).digest()[:width] if width == 2 else bytes([len(b) % 2]))) == exact_by_force(rows)


def test_exact_edges(spark):
    assert X.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(5, "a"), (5, "a"), (None, "a"), (None, None)], "doc_id long, text string")
    out = X.deduplicate(df).collect()
    assert sum(r["kept"] for r in out) == 2 and {r["group_size"] for r in out} == {3, 1}
    assert {r["keep_id"] for r in out if r["group_size"] == 3} == {5}


def test_chunks_follow_content():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 123, 200_000, dtype=np.uint8).tobytes()
    a, b = X.cut(data), X.cut(b"prefix" + data)
    assert b"".join(a) == data and b"".join(b) == b"prefix" + data
    assert len(set(a) & set(b)) > 0.9 * len(a) and all(X.LEAST <= len(c) <= X.MOST for c in a[:-1])
    assert X.cut(b"") == [] and X.cut(b"x") == [b"x"]


# -- near duplicates ------------------------------------------------------------


def near_by_force(rows, percent):
    sets = {}
    for i, t in rows:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            inter = len(x & y)
            if inter and 100 * inter >= percent * (len(x) + len(y) - inter):
                p, q = sorted((root(ids[a]), root(ids[b])))
                parent[q] = p
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def near_corpus(n_copies=70):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    base = [word() for _ in range(150)]
    rows = []
    for k in range(n_copies):  # a ball: most copies link to the base only, some to each other
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(150)] = word()
        rows.append((1000 + k, " ".join(w)))
    rows.append((7, " ".join(base).upper()))
    chain = [word() for _ in range(200)]
    for k in range(6):
        chain = chain[6:] + [word() for _ in range(6)]
        rows.append((50 + k, " ".join(chain)))
    rows += [(1, "one two"), (2, "ONE  two"), (3, ""), (4, None), (5, " \n"), (6, "a b c d e"), (8, "é É x y z"), (9, "é é x y z")]
    rows += [(200 + k, " ".join(word() for _ in range(rng.randint(1, 80)))) for k in range(40)]
    return rows


def near_rows(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


@pytest.mark.parametrize("percent", [80, 85])
def test_near(spark, percent):
    rows = near_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x"))
    assert near_rows(N.near_duplicates(df, percent=percent)) == near_by_force(rows, percent)


@pytest.mark.parametrize("elements", [1 << 22, 900])
def test_near_in_blocks(spark, monkeypatch, elements):
    monkeypatch.setattr(N, "BLOCK", 7)
    monkeypatch.setattr(N, "ELEMENTS", elements)
    rows = near_corpus(60)
    assert near_rows(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == near_by_force(rows, 80)


def test_colliding_band_keys(spark):
    """Buckets of classes that share no band: of all bands' keys only two values are left."""
    rows = near_corpus(25)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_rows(N.near_duplicates(df, band_key=lambda regs, k: F.pmod(F.xxhash64(regs), F.lit(2)))) == near_by_force(rows, 80)


def test_ids_are_whole_numbers(spark):
    df = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    for run in (N.near_duplicates, X.deduplicate):
        with pytest.raises(TypeError, match="whole numbers"):
            run(df)


def test_bands_and_likelihood_keep_linked_pairs():
    """Pairs just at the threshold, of sets of 20 to 2000: each shares a band and is not excluded."""
    rng = np.random.default_rng(4)
    seen = 0
    for n in (20, 60, 200, 700, 2000):
        for _ in range(120):
            inter = -(-2 * n * 85 // 185)  # the least intersection of two sets of n at 0.85
            pool = rng.integers(0, 2**63, 2 * n - inter).astype(np.uint64)
            a, b = N.sketch(pool[:n]), N.sketch(pool[n - inter :])
            assert len(pool[n - inter :]) == n and 100 * inter >= 85 * (2 * n - inter)
            assert (a.reshape(N.BANDS, N.ROWS) == b.reshape(N.BANDS, N.ROWS)).all(axis=1).any()
            assert N.similarity(a[None], b[None], np.array([n]), np.array([n]), 0.85)[1][0]
            seen += 1
    assert seen == 600


def test_words_do_not_collide_by_construction():
    from loomwright.llm.common import word_hashes

    morse = "a"
    while len(morse) < 4096:  # collides in any polynomial hash modulo 2**64
        morse += morse.translate(str.maketrans("ab", "ba"))
    other = morse.translate(str.maketrans("ab", "ba"))
    a, b = word_hashes(f"{morse} {other} {morse}".encode(), 5)[:2]
    assert a != b and word_hashes(morse.encode(), 5)[0] == a != word_hashes(morse.encode(), 6)[0]
    assert word_hashes(b"word", 5)[0] != word_hashes(b"word", 6)[0]


def test_near_by_shuffle_join(spark, monkeypatch):
    monkeypatch.setattr(N, "BROADCAST_ROWS", 0)
    rows = near_corpus(20)
    assert near_rows(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == near_by_force(rows, 80)


def test_near_edges(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    out = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in N.near_duplicates(df).collect()]
    assert sorted(out, key=str) == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (None, 0, None)], key=str)


def test_sketches():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 3000).astype(np.uint64), rng.integers(0, 2**63, 700).astype(np.uint64)
    assert (N.merge(N.sketch(a), N.sketch(b)) == N.sketch(np.concatenate((a, b)))).all()
    for shared in (500, 800, 950):
        x, y = a[:1000], np.concatenate((a[:shared], b[: 1000 - shared])) if shared >= 300 else None
        j = shared / (2000 - shared)
        est, possible = N.similarity(N.sketch(x)[None], N.sketch(y)[None], np.array([1000]), np.array([1000]), 0.8)
        assert abs(est[0] - j) < 0.12 and (j < 0.8 or possible[0])
    _, possible = N.similarity(N.sketch(a[:100])[None], N.sketch(a[:200])[None], np.array([100]), np.array([200]), 0.85)
    assert not possible[0]


def test_long_texts_hash_like_short_ones():
    from loomwright.llm.common import word_hashes

    text = (b"alpha beta\tgamma " * 60_000) + b"z" * 700_000 + b" end"
    h = word_hashes(text)
    assert len(h) == 180_002 and (h[:3] == word_hashes(b"alpha beta gamma")).all() and h[-1] == word_hashes(b"end")[0] and len(set(h.tolist())) == 5


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(25)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    turns = []
    got = {r["v"]: r["c"] for r in N.components(spark.createDataFrame(edges, "a long, b long"), turns).collect()}
    assert got == {v: root(v) for e in edges if e[0] != e[1] for v in e}
    assert N.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_sorted_chain(spark):
    edges, turns = [(k, k + 1) for k in range(1000)], []
    got = N.components(spark.createDataFrame(edges, "a long, b long"), turns).collect()
    assert len(got) == 1001 and {r["c"] for r in got} == {0}
    assert len(turns) <= 10 and max(turns) <= 5


def test_components_of_a_star(spark):
    edges, turns = [(k, 500) for k in range(300) if k != 500] + [(500, 600 + k) for k in range(300)], []
    assert {r["c"] for r in N.components(spark.createDataFrame(edges, "a long, b long"), turns).collect()} == {0} and len(turns) <= 2


def test_pages_of_one_template(spark):
    """More classes than a block in hot bands, few of them linked: they meet by their prefixes, as brute force has it."""
    r = random.Random(1)
    words = lambda n: [f"w{r.randint(0, 5000)}" for _ in range(n)]
    head, pool = words(140), [words(10) for _ in range(30)]
    docs = [(k, " ".join(head + [x for p in r.sample(pool, 6) for x in p])) for k in range(400)]
    docs += [(1000 + k, docs[7 * k][1] + " z" * (1 + k % 3)) for k in range(40)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in docs}
    least = {i: i for i in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    out = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=85).collect()}
    assert out == {i: root(i) for i in sets} and len(set(out.values())) < 410
