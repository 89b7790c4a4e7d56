import random
import re

import numpy as np
import pytest

from vicinage.llm import neardup
from vicinage.llm.common import Scratch
from vicinage.llm.graph import connected_components, least_labels

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(rows, width, percent=80):
    """{id: (size, component)} of rows with distinct ids."""
    sets = {i: shingle_set(t, width) for i, t in rows}
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                p, q = sorted((find(i), find(j)))
                label[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(n=160, seed=1):
    rng = random.Random(seed)
    words = ["Wort", "ÉTÉ", "été", "a", "b'c", "x y", "Z", "tree", "house", "sea", "sky", "blue", "red", "green"]
    rows = []
    for i in range(n):
        if i and rng.random() < 0.7:
            w = rows[rng.randrange(len(rows))][1].split(" ")
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))))
    return rows


@pytest.mark.parametrize("width,block", [(2, 1024), (5, 1024), (2, 8)])
def test_components_equal_brute_force(spark, width, block):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.components(spark, df, width=width, block=block, pivots=2).collect()
    want = brute(rows, width)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_texts_joined_by_id_when_there_are_many_candidates(spark):
    rows = corpus(60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.components(spark, df, width=2, small_ids=0).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 2)


def test_awkward(spark, awkward, nothing):
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id, r.kept) for r in neardup.components(spark, awkward, width=2).collect())
    long = len(shingle_set("word" * 3 + " " + "lorem ipsum dolor sit amet, " * 4000, 2))
    assert got == [(-1, 4, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, long, 3, True), (4, 2, 4, True), (4, 2, 4, True), (5, 2, 4, False), (6, 0, 6, True), (7, 1, 7, True)]
    assert neardup.components(spark, nothing).count() == 0


def test_one_of_each_keeps_one_row_of_every_group(spark, awkward):
    left = neardup.one_of_each(spark, awkward, width=2)
    assert left.columns == awkward.columns
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, 1, 2, 3, 4, 6, 7]


def test_groups_inside_another_are_left_out(spark):
    rows = [(1, 1), (1, 2), (1, 3), (1, 4), (2, 2), (2, 3), (2, 4), (3, 3), (3, 4), (4, 4), (4, 5), (6, 6), (6, 7), (7, 7), (7, 8)]
    left = {tuple(r) for r in neardup.without_subsets(spark.createDataFrame(rows, "lead long, rep long")).collect()}
    assert left == {(1, 1), (1, 2), (1, 3), (1, 4), (4, 4), (4, 5), (6, 6), (6, 7), (7, 7), (7, 8)}
    rng = random.Random(4)
    groups = [sorted(rng.sample(range(30), rng.randrange(2, 9))) for _ in range(60)]
    rows = {(min(g), x) for g in groups for x in g}
    pairs = lambda rows: {(x, y) for a, x in rows for b, y in rows if a == b and x < y}
    left = {tuple(r) for r in neardup.without_subsets(spark.createDataFrame(list(rows), "lead long, rep long")).collect()}
    assert left <= rows and pairs(left) == pairs(rows)


def test_linked_sets_equal_counting():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40)).astype(np.uint64)) for _ in range(30)]
    got = neardup.linked_sets(np.concatenate(sets), np.array([len(s) for s in sets]), 60, columns=7)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            assert got[i, j] == (i != j and 100 * both >= 60 * (len(a) + len(b) - both))


def test_miss_rate_is_small():
    assert neardup.miss_rate(0.8, 20) < 1e-4


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 200, 2)] + [(i, i + 1) for i in range(1001, 1060)] + [(5000, k) for k in range(5001, 5300)]
    rng.shuffle(edges)
    got = {r.id: r.component for r in connected_components(Scratch(spark, "t"), spark.createDataFrame([(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges] + [(9, 9)], "a long, b long")).collect()}
    assert all(got[i] == i and got[i + 1] == i for i in range(0, 200, 2))
    assert all(got[i] == 1001 for i in range(1001, 1061)) and all(got[k] == 5000 for k in range(5000, 5300))
    assert connected_components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_least_labels():
    link = np.zeros((5, 5), bool)
    for a, b in ((0, 3), (3, 4)):
        link[a, b] = link[b, a] = True
    assert least_labels(link, np.array([9, 1, 7, 5, 3])).tolist() == [3, 1, 7, 3, 3]


def test_repeated_ids_with_different_texts(spark):
    """Id 1 has two texts; each has a near copy of its own."""
    one, two = " ".join(f"a{k}" for k in range(200)), " ".join(f"b{k}" for k in range(200))
    rows = [(1, one), (1, two), (1, one), (2, one + " x"), (3, two + " x"), (4, "c d e f g h"), (3, "g h i j k l m"), (5, None), (5, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.components(spark, docs).collect())
    assert got == [(1, 196, 1, True)] * 3 + [(2, 197, 1, False), (3, 3, 3, True), (3, 197, 1, False), (4, 2, 4, True), (5, 0, 5, True), (5, 0, 5, True)]
    left = sorted((r.doc_id, r.text) for r in neardup.one_of_each(spark, docs).collect())
    assert left == sorted([(1, one), (1, two), (3, "g h i j k l m"), (4, "c d e f g h"), (5, " ")])


def test_words_that_polynomial_hashes_confuse(spark):
    """A Thue-Morse word and its complement, each before the same words, are no near copies of each other."""
    rows = []
    for n in (1024, 2048, 4096):
        s = "a"
        while len(s) < n:
            s += s.translate(str.maketrans("ab", "ba"))
        rows += [f"{s} c", f"{s.translate(str.maketrans('ab', 'ba'))} c"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in neardup.components(spark, docs, width=2).collect()} == {(i, i) for i in range(6)}
