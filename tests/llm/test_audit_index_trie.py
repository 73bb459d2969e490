"""Filter audit, nearest neighbours and prefix trie against plain computations."""

import hashlib
import random
import re
import zlib
from contextlib import contextmanager
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import filter_audit, multi_index, prefix_trie


@contextmanager
def settings_of(spark, **values):
    values = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# -- filter audit ---------------------------------------------------------------


def plain_audit(rows, labels):
    """Every order is walked for every document."""
    good, toxic = ({i for i, q, t in labels if x(q, t)} for x in (lambda q, t: q == 1, lambda q, t: t == 1))
    told = []
    for part, i, text in rows:
        text = text or ""
        words = [w for w in re.split(r"[ \t\n\x0b\f\r]", text) if w]
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": i is not None and any(j is not None and j < i and (t or "") == text for _, j, t in rows),
        }
        told.append((part or "", fails, i in good and i is not None, i in toxic and i is not None))
    out, shapley = {}, {}
    for part in {t[0] for t in told}:
        mine = [t[1:] for t in told if t[0] == part]
        for p in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(p, 1):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                redundant = sum(d[0][f] and any(d[0][x] for x in p[: step - 1]) for d in mine)
                unique = sum(d[0][f] and sum(d[0].values()) == 1 for d in mine)
                out[part, "".join(p), step] = [len(left), len(gone), redundant, unique, sum(d[1] for d in gone), sum(d[2] for d in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "source string, doc_id long, text string, n int")
    out = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in out}, len(out)


def test_audit_against_walking_all_orders(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(90)]
    texts = [None, "", "AB", "a # b", " ".join(words), " ".join(words[:20] * 4), " ".join(w.upper() for w in words), " ".join(words) + " |", "é ü " * 60, "x\x0by\x0cz\r\n" * 30]
    rows = [(r.choice(["a", "b", None, ""]), r.choice([None, *range(40)]), r.choice(texts)) for _ in range(120)]
    rows += [("hot", 1000 + k, texts[4]) for k in range(80)] + [("hot", 1000, texts[4])] * 3
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(0, 1040)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    merged = {}
    for i, q, t in labels:
        a, b = merged.get(i, (0, 0))
        merged[i] = (max(a, q == 1), max(b, t == 1))
    got, n = audited(spark, rows, labels)
    assert n == len(got) == 600 * 4 and got == plain_audit(rows, [(i, int(a), int(b)) for i, (a, b) in merged.items()])


def test_audit_edges(spark):
    assert audited(spark, [], []) == ({}, 0)
    got, n = audited(spark, [("p", 1, None)], [])
    assert n == 600 and got["p", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120) and got["p", "BACDE", 1] == (1, 0, 0, 0, 0, 0, 0)
    clash = spark.createDataFrame([("p", 2, "x " * 9, 1, 2, 3)], "source string, doc_id long, text string, w int, bits int, n int")
    assert filter_audit.audit(clash, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 600
    long = " ".join(f"v{k}" for k in range(300_000))
    assert audited(spark, [("p", 1, long), ("p", 2, long)], [])[0]["p", "ABCDE", 5][:4] == (1, 1, 0, 1)


# -- nearest neighbours ---------------------------------------------------------


def nearest(rows, k, query):
    """Of all rows, in double precision."""
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for q, v in rows:
        if query(q):
            near = sorted({(-float((x * v).sum()), i) for i, x in rows if i != q})[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def searched(spark, rows, schema="vec_id long, embedding array<double>, label int", **more):
    told, query = [], F.col("id") % 20 == 0
    out = multi_index.search(spark.createDataFrame([(*r, 1) for r in rows], schema), query, told=told, **more).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got, told


def test_recall_over_whole_tables(spark):
    for sf in ("/root/testdata/sf0.01",):
        table = spark.read.parquet(f"{sf}/embeddings.parquet")
        rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
        told = []
        out = multi_index.search(table, F.col("id") % 20 == 0, told=told).collect()
        want = nearest(rows, 20, lambda q: q % 20 == 0)
        vectors = {i: np.array(v, float) for i, v in rows}
        assert len(out) == 20 * len(want) and all(abs(r["score"] - float(vectors[r["query_id"]] @ vectors[r["vec_id"]])) < 1e-12 for r in out)
        hits = sum(r["vec_id"] in dict(want[r["query_id"]]) for r in out)
        assert hits / len(out) >= 0.9 and told[0].recall >= 0.95 and told[0].budget < len(rows)


def test_clusters_need_little_of_the_index(spark):
    r = np.random.default_rng(1)
    middles = r.normal(size=(40, 16))
    rows = [(k, (middles[k % 40] + 0.05 * r.normal(size=16)).tolist()) for k in range(4000)]
    got, told = searched(spark, rows, k=10)
    want = nearest(rows, 10, lambda q: q % 20 == 0)
    hits = sum(len(dict(want[q]).keys() & dict(got[q]).keys()) for q in want) / (10 * len(want))
    assert hits >= 0.9 and told[0].budget < 1000 and len(got) == len(want)


def test_equal_vectors_ties_and_shards(spark):
    r = np.random.default_rng(2)
    rows = [(k, [1.0, 0.5, -1.0, 2.0]) for k in range(300)] + [(1000 + k, r.integers(-2, 3, 4).astype(float).tolist()) for k in range(500)]
    rows = [x for x in rows if any(x[1])]
    got, told = searched(spark, rows, aimed=1.0, per_shard=16, per_cell=4)
    assert told[0].recall == 1.0 and told[0].shard.max() > 5
    told_all, _ = searched(spark, rows, aimed=1.0, per_cell=10**9)  # one cell holds all entries: exact
    want = nearest(rows, 20, lambda q: q % 20 == 0)
    assert set(got) == set(want) and told_all == {q: [(i, pytest.approx(s)) for i, s in near] for q, near in want.items()}
    one_cell, index = searched(spark, rows, aimed=1.0, per_cell=10**9, per_shard=16)  # a large cell over many shards
    assert one_cell == told_all and index[0].parts.max() > 5


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, None), (3, [0.0, -0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0]), (None, [1.0, 1.0]), (20, [1.0, 2.0]), (40, [nan, 1.0]), (20, [1.0, 2.0])]
    got, _ = searched(spark, rows)
    assert got == {0: [(20, 5.0), (1, 4.0)], 20: [(0, 5.0), (1, 4.0)]}
    assert searched(spark, [])[0] == {} and searched(spark, [(0, [1.0])])[0] == {}
    assert searched(spark, [(k, [1.0 + k]) for k in range(0, 45, 5)], schema="vec_id int, embedding array<float>, c int")[0][20][0] == (40, 861.0)
    clash = spark.createDataFrame([(0, [1.0, 2.0], 5, 6), (1, [1.0, 1.0], 5, 6)], "vec_id long, embedding array<double>, id int, v int")
    assert [tuple(r) for r in multi_index.search(clash, F.col("id") % 20 == 0).collect()] == [(0, 1, 1, 3.0)]


def test_walk_is_in_the_order_of_sums():
    r = np.random.default_rng(4)
    index = multi_index.Index(r.normal(size=(7, 3)), r.normal(size=(5, 4)))
    q = r.normal(size=7)
    sums = (index.first @ q[:3])[:, None] + (index.second @ q[3:])[None, :]
    walked = list(index.walk(q))
    assert sorted(walked) == list(range(35)) and np.all(np.diff(sums.ravel()[walked]) <= 1e-12)


# -- prefix trie ----------------------------------------------------------------


def plain_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = convs.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + own[h:]
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for n in members:
        if n:
            kids.setdefault(n[:-1], []).append(n)

    def below(n):
        todo, found = [n], []
        while todo:
            found.append(todo.pop())
            todo += kids.get(found[-1], [])
        return found

    out = []
    for n, cs in members.items():
        sub = below(n)
        ends = ",".join(str(c) for c in sorted(cs) if len(made[c]) == len(n))
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in sub if x)
        out.append((min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), len(kids.get(n, [])), sum(x not in kids for x in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def built(spark, rows, schema="conv_id long, turn long, role string, text string, x int"):
    df = spark.createDataFrame([(*r, 1) for r in rows], schema)
    return sorted((tuple(r[c] for c in TRIE) for r in prefix_trie.trie(df).collect()), key=str)


def conversations(seed, n, most, kinds):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-150, 3 * n), n):
        for t in range(r.randint(1, most)):
            role, text = r.choice(kinds)
            rows.append((c, t if r.random() < 0.95 or t else None, role, text))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("blocks, ids", [(1, 8192), (9, 3)])
def test_trie_against_sets_of_prefixes(spark, monkeypatch, blocks, ids):
    """Few kinds of turns make long common prefixes and classes over several blocks; many make a wide root."""
    monkeypatch.setattr(prefix_trie, "IDS", ids)
    with settings_of(spark, spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions=str(blocks)):
        for seed, n, most, kinds in ((1, 150, 9, [("user", "a"), ("bot", "bcd")]), (2, 120, 12, [("user", "same")]), (3, 100, 8, [(None, None), ("", "x"), ("user", ""), *[("u", f"t{k}" * k) for k in range(30)]])):
            rows = conversations(seed, n, most, kinds)
            assert built(spark, rows) == plain_trie(rows), (seed, blocks)


def test_trie_edges(spark):
    assert built(spark, []) == []
    assert built(spark, [(None, 1, "user", "x")]) == []
    assert built(spark, [(7, 0, "user", "x")]) == plain_trie([(7, 0, "user", "x")])
    rows = [(5, None, "u", "first"), (5, 0, "u", "then"), (5, 0, "u", "then"), (105, 1, "user", "x" * 100_000), (100, 1, None, None), (9, 3, "a", "bc"), (10, 3, "ab", "c")]
    assert built(spark, rows) == plain_trie(rows)
    clash = spark.createDataFrame([(1, 0, "u", "t", 9, 9)], "conv_id int, turn int, role string, text string, conv int, key int")
    assert prefix_trie.trie(clash).count() >= 1


def test_long_conversations(spark):
    rows = [(c, t, "user", f"turn {t}") for c in (0, 1) for t in range(1500 if c else 1400)]
    assert built(spark, rows) == plain_trie(rows)
