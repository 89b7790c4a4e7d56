import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vicinage.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def tokens(text):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def check(rows, size):
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_bin.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by_bin)


def test_best_fit_fills_bins():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 2049, 5000)
    bins, offsets, fills = packing.best_fit(lengths, 2048)
    assert (np.bincount(bins, lengths) == fills).all() and fills.max() <= 2048
    assert len(fills) <= 1.03 * max(-(-lengths.sum() // 2048), (lengths > 1024).sum())
    assert (fills <= 1024).sum() <= 1


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]


def test_awkward_rows(spark, awkward, nothing):
    rows = packing.pack_documents(spark, awkward, PATH, size=512).collect()
    check(rows, 512)
    want = {}
    for r in awkward.collect():
        ids = tokens(r.text)
        for p, (s, n) in enumerate(packing.cut(len(ids), 512)):
            key = (r.doc_id, p, s, n, zlib.crc32(ids[s : s + n].tobytes()))
            want[key] = want.get(key, 0) + 1
    got = {}
    for r in rows:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
    assert got == want
    assert packing.pack_documents(spark, nothing, PATH).count() == 0


@pytest.mark.parametrize("leaf,most", [(2048, 1.05), (1, 1.3)])
def test_tree_over_many_partitions(spark, leaf, most):
    """Sorted lengths in tiny partitions, the worst order: near the optimum; leaves of four pieces cost some room."""
    docs = spark.range(0, 300, 1, 70).selectExpr("id AS doc_id", "repeat('hello world ', CAST(20 + id % 90 AS INT)) AS text")
    rows = packing.pack_documents(spark, docs, PATH, size=256, fan_in=4, leaf_pieces=leaf).collect()
    n = check(rows, 256)
    total = sum(r.length for r in rows)
    assert sorted({r.doc_id for r in rows}) == list(range(300)) and n <= most * -(-total // 256)


@pytest.mark.parametrize("leaf", [2048, 1])
def test_many_levels_keep_every_piece(spark, leaf):
    docs = spark.range(0, 64, 1, 64).selectExpr("id AS doc_id", "repeat('a b ', 10) AS text")
    rows = packing.pack_documents(spark, docs, PATH, size=256, fan_in=2, leaf_pieces=leaf).collect()
    total = sum(r.length for r in rows)
    assert len(rows) == 64 and check(rows, 256) <= -(-total // 256) + 2


@pytest.mark.parametrize("leaf,many", [(1, 4), (1000, 2500)])
def test_pieces_of_other_subtrees_fill_up(spark, leaf, many):
    """Pieces of 18 tokens in the first partitions, the pieces of 14 that fill them up in the last ones."""
    words = lambda n: f"repeat('the ', {n - 2}) || 'the'"
    docs = spark.range(0, 8 * many, 1, 8).selectExpr("id AS doc_id", f"{words(17 + 1)} AS text").union(spark.range(10**6, 10**6 + 8 * many, 1, 8).selectExpr("id AS doc_id", f"{words(13 + 1)} AS text"))
    rows = packing.pack_documents(spark, docs, PATH, size=32, nearly=0, fan_in=2, leaf_pieces=leaf).collect()
    assert {r.length for r in rows} == {18, 14} and len(rows) == 16 * many
    assert check(rows, 32) == 8 * many


def test_count_hardly_depends_on_partitions(spark, small):
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    got = [check(packing.pack_documents(spark, docs.repartition(n), PATH).collect(), 2048) for n in (1, 32, 256)]
    assert max(got) <= 1.01 * min(got)


@pytest.mark.parametrize("emit,open_below", [(0, 8), (-4, 1), (-4, 8), (1, 0), (1, 8)])
def test_round_equals_best_fit(emit, open_below):
    rng = np.random.default_rng(1)
    for size, lengths in [(2048, rng.integers(1, 2049, 20000)), (64, rng.integers(1, 20, 3000)), (64, np.full(100, 7)), (8, np.array([8, 8, 1])), (2048, np.minimum(rng.geometric(0.004, 30000), 2048))]:
        values, counts = np.unique(lengths, return_counts=True)
        least = 0 if not emit else size + emit
        whole = size * (8 - open_below) // 8
        runs, left = packing.round_of(dict(zip(values.tolist(), counts.tolist(), strict=True)), size, least, whole)
        bins = {}
        for n, first, each, many, made, fill, offset in runs:
            for j in range(many):
                for r in range(each):
                    bins.setdefault((fill >= least, 0 if fill >= least else fill, made + j), []).append((offset + r * n, n, fill, first + j * each + r))
        for parts in bins.values():
            at = 0
            for offset, n, _, _ in sorted(parts):
                assert offset == at
                at += n
            assert {x[2] for x in parts} == {at}
        dealt = sorted((n, number) for parts in bins.values() for _, n, _, number in parts)
        assert dealt == [(n, k) for n, c in zip(values.tolist(), counts.tolist(), strict=True) for k in range(c)]
        if not whole or not least:
            assert sorted(sum(x[1] for x in parts) for parts in bins.values()) == sorted(packing.best_fit(lengths, size)[2])
        assert left == {f: sum(1 for k in bins if not k[0] and k[1] == f) for f in left}


def twins(n):
    """The Thue-Morse word of n letters and its complement, which polynomial hashes confuse."""
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomial_hashes_confuse(spark):
    texts = [*twins(1024), *twins(2048), *twins(4096)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in packing.pack_documents(spark, docs, PATH).collect():
        assert r.ids_crc32 == zlib.crc32(tokens(texts[r.doc_id])[r.start : r.start + r.length].tobytes())


def test_very_long_text(spark):
    """A text of 2 MB among short ones: every piece has the library's ids, pieces follow each other without a gap."""
    rng = np.random.default_rng(3)
    words = np.array(["lorem", "ipsum", "Straße", "été", "x", "2048", "don't", "\n\n", "  ", "¿qué?"])
    texts = [" ".join(rng.choice(words, 400_000).tolist()), "short", "z" * 300_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack_documents(spark, docs, PATH).collect()
    check(rows, 2048)
    for i, text in enumerate(texts):
        ids, at = tokens(text), 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
