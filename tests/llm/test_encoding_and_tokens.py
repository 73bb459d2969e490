import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwright.llm import packing, token_output
from loomwright.llm.encoding import encoder

VOCABULARIES = {"byte_bpe_50k.json": True, "word_bpe_49k.json": False}
ODD = ["", " ", "a", "a\tb", "  x  y ", "x y", "a\n\nb", "A'S 'T don't we'll", "\x00a b", "ſtoken K", "a ́b", "<|endoftext|> hi", "a <|endoftext|> b", "x<|startoftext|>y <|ENDOFTEXT|>", "<|endoftext", "a <|endoftext|><|endoftext|>\nb ", "ab　cd e", "\x1ca b", "1 23 4!? ...", "x​y z", "ΣΑΣ x", "İstanbul ß Straße, ÀÉÎ µ", "'s a's, '", "été été, naïve;", "w" * 5000, "a" * 47 + ", " + "b" * 49]


@pytest.fixture(scope="module", params=VOCABULARIES)
def both(request):
    path = public_tokenizers.path(request.param)
    return encoder(path, VOCABULARIES[request.param]), Tokenizer.from_file(path)


def ids(enc, text):
    return np.frombuffer(enc.encode(text), "<u4").tolist()


def test_whole_texts(both, spark, sf):
    enc, lib = both
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ODD
    for t in texts:
        assert ids(enc, t) == lib.encode(t, add_special_tokens=False).ids, t[:60]


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(st.one_of(st.sampled_from(" \n\t'.,é—ß三aBc1"), st.characters(codec="utf-8")), max_size=40))
def test_any_text(both, t):
    enc, lib = both
    assert ids(enc, t) == lib.encode(t, add_special_tokens=False).ids


def test_special_strings_as_text(both):
    from loomwright.llm.encoding import Encoder

    enc, lib = both
    path = public_tokenizers.path("byte_bpe_50k.json" if enc.spaces_matter else "word_bpe_49k.json")
    plain, lib = Encoder(path, enc.spaces_matter, specials_as_text=True), Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    for t in ("a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>"):
        assert ids(plain, t) == lib.encode(t, add_special_tokens=False).ids
    assert ids(plain, "<|endoftext|>") != ids(enc, "<|endoftext|>")


def test_full_memo_starts_from_its_core(both):
    from loomwright.llm.encoding import Encoder

    enc, lib = both
    small = Encoder(public_tokenizers.path("byte_bpe_50k.json" if enc.spaces_matter else "word_bpe_49k.json"), enc.spaces_matter, memo=6)
    for k in range(40):
        t = f"word{k} some thing{k % 3}, x"
        assert ids(small, t) == lib.encode(t, add_special_tokens=False).ids and len(small.first) <= 6


def batch(enc, texts):
    return enc.encode_array(pa.array(texts, pa.string()), 2).to_pylist()


def test_batches_of_texts(both, spark, sf):
    enc, lib = both
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    edges = ["x\n", "\nx", "a \n b", "a\n b", "", "b, c.d, e?! f's. (g), h", "3, x", "\u00e9, \u00e9.", ""]
    for some in (ODD + edges, (ODD + edges)[::-1], texts, [], [""], ["", ""], [" "]):
        assert batch(enc, some) == [[*lib.encode(t, add_special_tokens=False).ids, 2] for t in some]
    part = pa.array(ODD + edges, pa.string()).slice(3, 20)
    assert enc.encode_array(part, 2).to_pylist() == batch(enc, part.to_pylist())


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'.,\u00e9\u2014\u00df\u4e09aBc1"), st.characters(codec="utf-8")), max_size=20), max_size=6))
def test_any_batch(both, texts):
    enc, lib = both
    assert batch(enc, texts) == [[*lib.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_a_batch_looks_up_each_piece_once():
    from loomwright.llm.encoding import Encoder

    enc, asked = Encoder(public_tokenizers.path("byte_bpe_50k.json"), True), []

    class Asked(dict):
        def __missing__(self, piece):
            asked.append(piece)
            return memo[piece]

    memo, enc.units = enc.units, Asked()
    batch(enc, ["word of a word, word of"] * 50 + ["of a word.\nword"] * 50)
    assert sorted(asked) == sorted(["word", " of", " a", " word", ",", "of", ".", "\n"])


ROWS = [(3, "b c", "x"), (1, None, "y"), (2, "", "z"), (None, "n", "z"), (3, "b c", "x"), (7, "long " * 3000, "w")]


def test_token_files(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, ids string")
    path, vocab = str(tmp_path / "t"), public_tokenizers.path("byte_bpe_50k.json")
    token_output.write(df, path, vocab)
    out = token_output.read(spark, path).orderBy("start").collect()
    lib = Tokenizer.from_file(vocab)
    assert [r["doc_id"] for r in out] == [None, 1, 2, 3, 3, 7]
    at = 0
    for r in out:
        text = next(t for i, t, _ in ROWS if i == r["doc_id"]) or ""
        want = [*lib.encode(text, add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids"]) == (at, len(want), want)
        at += len(want)
    crc = {r["start"]: r["ids_crc32"] for r in token_output.digest(token_output.read(spark, path)).collect()}
    assert crc == {r["start"]: zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in out}


def test_parts_by_bytes(spark, monkeypatch):
    """Parts have about equal bytes though a few documents in the middle hold most of them."""
    rows = [(k, ("word " * (4000 if 480 <= k < 520 else 3))) for k in range(1000)] + [(None, "n"), (999, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    total = sum(len(t) for _, t in rows)
    for most, parts in ((total // 8, 9), (1 << 30, 1)):
        monkeypatch.setattr(token_output, "PART_BYTES", most)
        cuts = token_output._cuts(df)
        assert len(cuts) + 1 <= parts and (most > total or len(cuts) >= 6)
        sizes = {}
        for r in token_output._with_part(df, cuts).collect():
            assert r["part"] == sum(c < r["doc_id"] for c in cuts) if r["doc_id"] is not None else r["part"] == 0
            sizes[r["part"]] = sizes.get(r["part"], 0) + len(r["text"])
        assert max(sizes.values()) <= 2 * most


def test_token_files_have_pages_and_encodings(spark, tmp_path, sf):
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "t")
    token_output.write(spark.read.parquet(f"{sf}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    meta = pq.ParquetFile(max(glob.glob(f"{path}/*.parquet"))).metadata
    chunks = {meta.row_group(0).column(k).path_in_schema: meta.row_group(0).column(k) for k in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in chunks["first"].encodings and chunks["ids.list.element"].has_dictionary_page
    assert all(c.has_column_index and c.has_offset_index for c in chunks.values())


def test_tokens_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_output.round_trip(df, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert packing.pack_documents(df, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_starts_over_a_table(spark, sf):
    from loomwright.llm.queries import QUERIES

    rows = QUERIES["op10_token_output"](spark, sf).orderBy("doc_id").collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lib, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    assert [r["doc_id"] for r in rows] == sorted(docs)
    for r in rows:
        want = [*lib.encode(docs[r["doc_id"]], add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)


# -- packing --------------------------------------------------------------------


def test_packing_is_whole_and_tight(spark, sf):
    from loomwright.llm.queries import QUERIES

    rows = QUERIES["op6_best_fit_packing"](spark, sf).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lib, pieces, seqs = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(docs)
    total = 0
    for i, text in docs.items():
        want = [*lib.encode(text, add_special_tokens=False).ids, 1]
        total += len(want)
        mine = sorted(pieces[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in mine] == [(k, at, len(want[at : at + 4096])) for k, at in enumerate(range(0, len(want), 4096))]
        assert [r["ids_crc32"] for r in mine] == [zlib.crc32(np.array(want[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in mine]
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(seqs) <= -(-total // 4096) + 1


def test_levels_join_the_groups_remainders(spark):
    rng = random.Random(1)
    sizes = [rng.randint(1, 2500) for _ in range(1500)]
    items = spark.createDataFrame(list(enumerate(sizes)), "pid long, length long")
    out = packing.pack(items, group=100).collect()
    assert sorted(r["pid"] for r in out) == list(range(1500))
    fills = {}
    for r in out:
        fills[r["sequence_id"]] = fills.get(r["sequence_id"], 0) + sizes[r["pid"]]
    assert max(fills.values()) <= 4096 and len(fills) <= -(-sum(sizes) // 4096) * 1.02 + 1


def triplets(n, seed, capacity):
    """Pieces that fill ``n`` bins by threes without a gap; best fit by decreasing size leaves gaps."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        a = rng.randint(380, 490)
        b = rng.randint(250, (capacity - a) // 2)
        out += [a, b, capacity - a - b]
    rng.shuffle(out)
    return out


def whole(bins, sizes, capacity):
    return sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= capacity for b in bins)


@pytest.mark.parametrize("seed", range(5))
def test_evolution_beats_best_fit_decreasing(seed):
    sizes = triplets(20, seed, 1000)
    plain = packing.decreasing(sizes, 1000)
    told = packing.evolve(sizes, seed, [], 1000, population=30, generations=1500)
    assert whole(told.elite, sizes, 1000) and told.children == 1500 and told.gains > 0
    assert len(told.elite) <= 22 < len(plain) and len(told.elite) < told.seed[0] or len(told.elite) == 21


def test_operators_of_the_evolution():
    rng = random.Random(3)
    sizes = [rng.choice((1500, 1400, 1300, 1196, 2600, 1496)) for _ in range(60)]
    first = []
    packing.best_fit(sizes, list(range(60)), first, 4096)
    told = packing.evolve(sizes, 1, [first], generations=40)
    assert whole(told.elite, sizes, 4096) and packing.fitness(sizes, told.elite, 4096) <= packing.fitness(sizes, first, 4096)
    for _ in range(20):
        assert whole(packing.crossover(sizes, first, told.elite, 4096, rng), sizes, 4096) and whole(packing.mutate(sizes, first, 4096, rng), sizes, 4096)


def test_packing_comes_from_the_evolution(spark):
    """Over all of a table: every group makes children, some become the elite, and no group ends above best fit decreasing."""
    docs, report = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), []
    packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), report=report).count()
    rows = [r for t in report for r in t.collect()]
    assert len(rows) == packing.ISLANDS * packing.EPOCHS * len({(r["level"], r["g"]) for r in rows}) > 0
    assert all(r["children"] == packing.GENERATIONS and (r["n"], r["fill"]) <= (r["seed_n"], r["seed_fill"]) for r in rows)
    assert sum(r["gains"] for r in rows) > 0
    for g in {(r["level"], r["g"]) for r in rows}:
        mine = [r for r in rows if (r["level"], r["g"]) == g]
        best = min((r["n"], r["fill"]) for r in mine if r["epoch"] == packing.EPOCHS - 1)
        assert best < min((r["seed_n"], r["seed_fill"]) for r in mine if r["epoch"] == 0)


def test_repeated_rows_are_packed_one_by_one(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string").withColumn("pid", F.lit("clash"))
    out = packing.pack_documents(df, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in out) == [(0, 1), (1, 3), (1, 3)] and len({r["offset"] for r in out}) == 3
