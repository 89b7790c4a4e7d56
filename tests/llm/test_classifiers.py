import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from vicinage.llm import quality, toxicity
from vicinage.llm.common import Scratch, text_bytes


def poor(rng, words):
    kind = rng.randrange(3)
    if kind == 0:
        return " | ".join(rng.choice(words) for _ in range(120))
    if kind == 1:
        return " ".join([rng.choice(words)] * 150)
    return " ".join(rng.choice(words).upper() + "!!" for _ in range(100))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(0)
    words = ["".join(rng.choice("aeioulrstn") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    rude = ["grumph", "grumphy", "blarg", "blarger"]
    docs, labels = [], []
    for i in range(1500):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.25
        w = (poor(rng, words) if bad else ". ".join(" ".join(rng.choice(words) for _ in range(rng.randrange(4, 12))) for _ in range(12)).capitalize() + ".").split(" ")
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(rude) + rng.choice(["", ",", "."]))
        docs.append((i, " ".join(w), "en", "s"))
        if i % 10:
            labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module,target,cut", [(quality, "quality", 0.3), (toxicity, "toxic", 0.5)])
def test_held_out_accuracy(spark, corpus, module, target, cut):
    docs, labels = corpus
    got = module.score_documents(spark, docs, labels, target).join(labels, "doc_id").where("held_out").collect()
    right = sum((r.score >= cut) == bool(r[target]) for r in got)
    assert len(got) > 200 and right >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("module,keep,target", [(quality, "good_documents", "quality"), (toxicity, "clean_documents", "toxic")])
def test_filters_agree_with_scores(spark, corpus, module, keep, target):
    docs, labels = corpus
    scores = {r.doc_id: r.score for r in module.score_documents(spark, docs, labels).collect()}
    left = getattr(module, keep)(spark, docs, labels)
    assert left.columns == docs.columns
    want = {i for i, s in scores.items() if (s >= 0.3 if target == "quality" else s < 0.5)}
    assert {r.doc_id for r in left.collect()} == want


@pytest.mark.parametrize("module", [quality, toxicity])
def test_awkward(spark, corpus, awkward, nothing, module):
    _, labels = corpus
    both = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (4, 0, 1), (4, 1, 0)], labels.schema))
    got = module.score_documents(spark, awkward, both).collect()
    assert sorted((r.doc_id or -1) for r in got) == [-1, 1, 2, 3, 4, 4, 5, 6, 7]
    assert len({r.score for r in got if r.doc_id == 4}) == 1 and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert all(r.held_out for r in got if r.doc_id is None)
    assert module.score_documents(spark, nothing, both).count() == 0
    alone = module.score_documents(spark, awkward, labels.where("false")).collect()
    assert len({r.score for r in alone}) == 1


def test_labels_of_held_out_rows_do_not_matter(spark, corpus):
    docs, labels = corpus
    flipped = spark.createDataFrame([(r.doc_id, 1 - r.quality, r.toxic) if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else tuple(r) for r in labels.collect()], labels.schema)
    a, b = ({r.doc_id: (r.held_out, round(r.score, 9)) for r in quality.score_documents(spark, docs, x).collect()} for x in (labels, flipped))
    assert a == b and all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, (h, _) in a.items())


def test_pool_adjacent():
    assert quality.pool_adjacent(np.array([0.1, 0.5, 0.3, 0.9]), np.array([1.0, 1.0, 3.0, 1.0])).round(3).tolist() == [0.1, 0.35, 0.35, 0.9]


def test_statistics_do_not_depend_on_neighbours():
    texts = ["", "One two. Two!", "é ü | |", None, "x" * 5000, "A B\nC d"]
    a, offsets = text_bytes(pa.array(texts, pa.string()))
    together = quality.statistics(a, offsets)
    for k, t in enumerate(texts):
        assert np.allclose(quality.statistics(*text_bytes(pa.array([t], pa.string())))[0], together[k])


def test_network_does_not_depend_on_neighbours():
    texts = ["", "One two. Two!", "é ü the of and", None, "x" * 5000, "... ,, !"]
    net = toxicity.Net.fresh(1 << 10, 8, 4, 0)
    net.embed[:] = np.random.default_rng(0).standard_normal(net.embed.shape)
    together = net.logit(toxicity.read_words(*text_bytes(pa.array(texts, pa.string())), 1 << 10))
    for k, t in enumerate(texts):
        assert np.isclose(net.logit(toxicity.read_words(*text_bytes(pa.array([t], pa.string())), 1 << 10))[0], together[k], atol=1e-5)


@pytest.mark.parametrize("partitions", [1, 40])
def test_quality_fit_equals_a_direct_solution(spark, corpus, partitions):
    """Features, ridge weights and calibration of the distributed fit against numpy on the collected rows."""
    docs, labels = corpus
    stats = quality.statistics_table(docs).repartition(partitions)
    k = quality.fit(Scratch(spark, "t"), stats, labels, "quality", n_features=64)
    known = {r.doc_id: r.quality for r in labels.collect()}
    hold = {r.doc_id for r in spark.range(1500).selectExpr("id AS doc_id", "pmod(xxhash64(id), 4) = 0 AS h").where("h").collect()}
    rows = [(r.doc_id, r.stats) for r in stats.collect() if r.doc_id in known and zlib.crc32(str(r.doc_id).encode()) % 5]
    x, y = np.array([s for _, s in rows]), np.array([known[i] for i, _ in rows], float)
    held = np.array([i in hold for i, _ in rows])
    assert np.allclose(k.mean, x.mean(0)) and np.allclose(k.scale, np.maximum(x.std(0), 1e-6))
    z = np.hstack([np.cos(np.clip((x - x.mean(0)) / k.scale, -8, 8) @ k.freq + k.phase) * np.sqrt(2 / 64), np.ones((len(x), 1))])
    direct = np.linalg.solve(z[~held].T @ z[~held] + 1e-3 * len(x) * np.eye(65), z[~held].T @ y[~held])
    assert np.allclose(k.weights, direct, atol=1e-6)
    raw = z @ direct
    bins = np.clip(np.floor((raw[held] + 0.5) / 2 * 400), 0, 399).astype(int)
    at = np.unique(bins)
    fitted = quality.pool_adjacent(np.array([y[held][bins == b].mean() for b in at]), np.array([(bins == b).sum() for b in at], float))
    assert np.allclose(k.score(x), np.interp(raw, (at + 0.5) / 200 - 0.5, fitted).clip(0, 1), atol=1e-6)


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    d, n = len(quality.STATS), 20_000
    freq, phase = rng.standard_normal((d, n)) / 3, rng.uniform(0, 2 * np.pi, n)
    k = quality.Kernel(np.zeros(d), np.ones(d), freq, phase, np.zeros(n + 1), np.zeros(1), np.zeros(1))
    x = rng.standard_normal((12, d))
    z = k.features(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 2 / 9)
    assert np.abs(z @ z.T - exact).max() < 0.05


def small_net(dim=5, filters=3):
    net = toxicity.Net.fresh(1 << 8, dim, filters, 1)
    rng = np.random.default_rng(2)
    net.embed = rng.standard_normal(net.embed.shape)
    net.filters = [rng.standard_normal(f.shape) for f in net.filters]
    net.bias = [rng.standard_normal(b.shape) for b in net.bias]
    net.out = rng.standard_normal(net.out.shape)
    return net, toxicity.read_words(*text_bytes(pa.array(["", "one", "one two three, four", "a b c d e f g h i a b", "x y"])), 1 << 8)


def test_convolution_equals_loops():
    net, words = small_net()
    vectors = net.embed[words.features].sum(1)  # a row for each distinct word
    at = 0
    for text, n in enumerate(words.counts.tolist()):
        seen = np.vstack([vectors[words.index[at : at + n]], np.zeros((2 * toxicity.PAD, vectors.shape[1]))])
        at += n
        pooled = []
        for f, b in zip(net.filters, net.bias, strict=True):
            pooled.append(np.max([sum(seen[s + j] @ f[j] for j in range(len(f))) + b for s in range(n + 1)], axis=0))
        assert np.allclose(np.maximum(np.concatenate(pooled), 0), net.pooled(words)[0][text], atol=1e-5)


def test_gradients_equal_differences():
    net, words = small_net()
    y = np.array([0, 1, 0, 1, 1])

    def loss():
        z = net.pooled(words)[0].astype(float) @ net.out + net.out_bias
        return float((np.log1p(np.exp(z)) - y * z).sum())

    z = net.pooled(words)[0].astype(float) @ net.out + net.out_bias
    g_out, g_bias, g_filters, g_filter_bias, touched, g_embed = toxicity.gradients(net, words, net.pooled(words), 1 / (1 + np.exp(-z)) - y)

    def slope(array, at, step=1e-4):
        kept = array[at]
        array[at] = kept + step
        up = loss()
        array[at] = kept - step
        down = loss()
        array[at] = kept
        return (up - down) / (2 * step)

    for k in range(len(net.out)):
        assert np.isclose(slope(net.out, k), g_out[k], atol=1e-3)
    for c in range(len(net.filters)):
        for at in np.ndindex(*net.filters[c].shape):
            assert np.isclose(slope(net.filters[c], at), g_filters[c][at], atol=1e-3)
        for k in range(len(net.bias[c])):
            assert np.isclose(slope(net.bias[c], k), g_filter_bias[c][k], atol=1e-3)
    for row, g in zip(touched.tolist(), g_embed, strict=True):
        for d in range(net.embed.shape[1]):
            assert np.isclose(slope(net.embed, (row, d)), g[d], atol=1e-3)
    kept = net.out_bias
    net.out_bias = kept + 1e-4
    up = loss()
    net.out_bias = kept - 1e-4
    assert np.isclose((up - loss()) / 2e-4, g_bias, atol=1e-3)


def test_training_sample_is_bounded(spark, corpus):
    """An id that repeats counts once, and texts beyond the bound aren't trained on."""
    docs, labels = corpus
    again = docs.unionByName(docs.where("doc_id = 11")).unionByName(docs.where("doc_id = 11").selectExpr("doc_id", "repeat('long ', 9000) AS text", "lang", "score"))
    got = toxicity.sample_of(again, labels, "toxic", 100, 1 << 14, "doc_id", "text").collect()
    assert len(got) <= 200 and max(len(r.text) for r in got) <= 1 << 14
    one = toxicity.sample_of(again.where("doc_id = 11"), labels, "toxic", 10_000, 1 << 14, "doc_id", "text").collect()
    assert len(one) == 1 and not one[0].text.startswith("long")


def test_very_long_text(spark, corpus):
    """Texts of megabytes are scored whole: a toxic word at the very end counts, and statistics are those of all words."""
    _, labels = corpus
    docs = corpus[0].unionByName(spark.createDataFrame([(90_001, "one two three. " * 150_000, "en", "s"), (90_002, "one two three. " * 150_000 + "grumph blarg grumphy blarger", "en", "s")], corpus[0].schema))
    got = {r.doc_id: r.score for r in toxicity.score_documents(spark, docs, labels).where("doc_id > 90000").collect()}
    assert got[90_001] < 0.5 <= got[90_002]
    stats = {r.doc_id: r.stats for r in quality.statistics_table(docs.where("doc_id > 90000")).collect()}
    assert np.isclose(stats[90_001][quality.STATS.index("log_words")], np.log1p(450_000)) and np.isclose(stats[90_001][quality.STATS.index("distinct")], 3 / 450_000)
