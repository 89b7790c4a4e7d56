import math

import numpy as np
import pytest

from vicinage.llm import vectors


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in r], 0) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, rank int")


def top_brute(x, k=5):
    q = np.floor(256 * x.astype(np.float32).astype(float))
    out = set()
    for i in range(0, len(x), 50):
        s = q @ q[i]
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[j], j))[:k]
        out |= {(i, r + 1, j, int(s[j])) for r, j in enumerate(order)}
    return out


@pytest.mark.parametrize("shard,block", [(10_000, 1000), (64, 3), (37, 1)])
def test_top_k_equals_brute_force(spark, shard, block):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 12)) / 4
    x[200:230] = x[7]  # ties
    df = frame(spark, x)
    got = vectors.top_k(spark, df, df.where("vec_id % 50 = 0"), shard_rows=shard, query_rows=block).collect()
    assert {tuple(r) for r in got} == top_brute(x)


def test_top_k_awkward(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [0.5, 0.5]), (6, [2.0, 0.0]), (7, [1.0]), (50, [3e30, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in vectors.top_k(spark, df, df.where("vec_id % 50 = 0"), k=5).collect()}
    assert {r for r in got if r[0] == 0} == {(0, 1, 50, 2**63 - 1), (0, 2, 6, 256 * 512)}
    assert {r[2] for r in got if r[0] == 50} == {0, 6}
    empty = df.where("false")
    assert vectors.top_k(spark, empty, empty).count() == 0


def test_queries_visit_few_cells_of_clustered_vectors(spark):
    """Twelve far clusters, one tree each: after the first wave hardly any other cell's bound reaches the floor."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 16)) * 4
    x = centres[np.arange(1200) % 12] + 0.05 * rng.standard_normal((1200, 16))
    df = frame(spark, x)
    got = vectors.top_k(spark, df, df.where("vec_id % 50 = 0"), shard_rows=100)
    assert {tuple(r) for r in got.collect()} == top_brute(x)
    cells = vectors.Cells({16: np.floor(256 * centres)})
    cells.radius[16][:] = 256 * 0.5
    rows = [(i, 16, -float("inf") if wave == 0 else float((np.floor(256 * x[i]) ** 2).sum() * 0.9), np.floor(256 * x[i]).tobytes()) for wave in (0, 1) for i in range(0, 1200, 50)]
    asks = [spark.createDataFrame(rows[k * 24 : k * 24 + 24], "id long, dim int, floor double, vec binary") for k in (0, 1)]
    assert cells.route(asks[0], 0, 1).count() == 24 and cells.route(asks[0], 0, 12).count() == 24 * 12
    assert cells.route(asks[1], 1, 12).count() < 24


@pytest.mark.parametrize("waves", [(1,), (1, 2, 4)])
def test_waves_and_lengths(spark, waves):
    """Vectors of several lengths, one of them with a single cell; only equal lengths are compared."""
    rng = np.random.default_rng(6)
    long, short = rng.standard_normal((300, 9)) / 4, rng.standard_normal((40, 4)) / 4
    df = frame(spark, long).unionByName(frame(spark, short, range(1000, 1040)))
    got = {tuple(r) for r in vectors.top_k(spark, df, df.where("vec_id % 50 = 0"), shard_rows=50, waves=waves).collect()}
    q = np.floor(256 * short.astype(np.float32).astype(float))
    order = sorted(range(1, 40), key=lambda j: (-(q[j] @ q[0]), j))[:5]
    assert got == top_brute(long) | {(1000, r + 1, 1000 + j, int(q[j] @ q[0])) for r, j in enumerate(order)}


def near_brute(x, threshold=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= threshold
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    while True:
        low = np.minimum(label, np.where(link, label[None], len(x)).min(1))
        if (low == label).all():
            return link, label
        label = low


@pytest.mark.parametrize("block", [2048, 16])
def test_near_vectors_equal_brute_force(spark, block):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 32))
    x[100:200] = x[3] + 0.03 * rng.standard_normal((100, 32))
    x[300:350] = x[5]
    x[400:410] = x[6] * 3 + 0.01 * rng.standard_normal((10, 32))
    x = x.astype(np.float32).astype(float)
    link, label = near_brute(x)
    got = vectors.near_vectors(spark, frame(spark, x), block=block).orderBy("vec_id").collect()
    assert [r.n_links for r in got] == link.sum(1).tolist()
    assert [r.component_id for r in got] == label.tolist()
    assert [r.kept for r in got] == (label == np.arange(len(x))).tolist()


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 48))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.standard_normal(base.shape)
    other -= (other * base).sum(1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    x = np.vstack([base, 0.905 * base + math.sqrt(1 - 0.905**2) * other])
    got = vectors.near_vectors(spark, frame(spark, x)).where("n_links > 0").count()
    assert got >= 0.99 * 600


def test_near_vectors_awkward(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (None, [1.0, 0.0]), (6, [2.0, 0.0]), (6, [2.0, 0.0]), (7, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(spark, df).collect())
    assert got == [(-1, 0, None, True), (0, 2, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 2, 0, False), (6, 2, 0, False), (7, 0, 7, True)]
    assert vectors.near_vectors(spark, df.where("false")).count() == 0
