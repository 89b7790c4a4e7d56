"""Document quality: random Fourier features of document statistics, ridge regression, isotonic calibration.

One pass over the texts writes a row of statistics per document; everything else reads that small table. The
features approximate a Gaussian kernel; each partition sums its part of the normal equations, the parts are added
up in a tree, and the driver solves a system of fixed size. Raw scores of labelled rows that the ridge has not
seen are counted in fixed bins, and pooling adjacent violators over the bins gives the calibration.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinage.llm.common import Scratch, bucket_of_doc, hash_slices, spans_of, text_bytes, words_of

STATS = ("log_chars", "letters", "capitals", "digits", "spaces", "breaks", "stops", "shouts", "bars", "symbols", "foreign", "word_len", "distinct", "top_word", "adjacent", "caps_words", "short_words", "marked_words", "log_words")
NODES, FAN_IN = 8, 16
_CLASS = np.full(256, 8, np.uint8)  # 8: symbols
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 0, 2, 9
_CLASS[[32, 9]], _CLASS[[10, 13, 11, 12]] = 3, 4
_CLASS[[ord(x) for x in ".,;:?'\"()-"]], _CLASS[ord("!")], _CLASS[ord("|")] = 5, 6, 7


def statistics(a: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """STATS of the texts laid end to end, a row each; an empty text has zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, len(STATS)))
    if not len(a):
        return out
    size = np.diff(offsets)
    some = size > 0
    at = offsets[:-1][some]
    c = _CLASS[a]
    per = np.zeros((n, 10))
    for k in range(10):
        per[some, k] = np.add.reduceat((c == k).astype(np.int32), at)
    whole = np.maximum(size, 1)[:, None]
    out[:, 0] = np.log1p(size)
    out[:, 1] = ((per[:, [0, 1, 9]].sum(1, keepdims=True)) / whole)[:, 0]
    for col, k in ((2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 6), (8, 7), (9, 8), (10, 9)):
        out[:, col] = np.sqrt(per[:, k] / whole[:, 0])
    lower, starts, ends, words = words_of(a, offsets)
    if not len(starts):
        return out
    h = hash_slices(lower, starts, ends)
    has = words > 0
    first = (np.cumsum(words) - words)[has]
    w = words[has].astype(np.float64)
    total = lambda x: np.add.reduceat(x.astype(np.float64), first)
    length = ends - starts
    out[has, 11] = total(length) / w / 10
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[first] = False
    out[has, 14] = np.sqrt(total(same) / w)
    upper = (a[starts] >= 65) & (a[starts] <= 90) & (length > 1)
    second = a[np.minimum(starts + 1, len(a) - 1)]
    out[has, 15] = np.sqrt(total(upper & (second >= 65) & (second <= 90)) / w)
    out[has, 16] = total(length <= 3) / w
    out[has, 17] = np.sqrt(total(np.isin(c[ends - 1], (6, 7, 8))) / w)
    out[has, 18] = np.log1p(w)
    for row, lo, m in zip(np.flatnonzero(has).tolist(), first.tolist(), words[has].tolist(), strict=True):
        x = np.sort(h[lo : lo + m])
        edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
        out[row, 12], out[row, 13] = (len(edge) - 1) / m, np.sqrt(np.diff(edge).max() / m)
    return out


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and stats (array<double>) of every text; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            a, offsets = text_bytes(batch.column(1))
            for i, j in spans_of(offsets, 1 << 20):
                x = statistics(a[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * len(STATS), pa.int32()), pa.array(x.ravel()))], names=["id", "stats"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, stats array<double>").withColumnRenamed("id", id_col)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def statistics_of(texts: pa.Array) -> pa.Array:
    """stats as a column of the texts."""
    a, offsets = text_bytes(texts)
    parts = [statistics(a[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in spans_of(offsets, 1 << 20)]
    flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(STATS), pa.int32()), pa.array(flat))


@dataclass
class Kernel:
    """Standardisation, random frequencies and phases, ridge weights, and the calibration's knots."""

    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.freq + self.phase) * np.sqrt(2 / len(self.phase)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def pool_adjacent(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weighted isotonic (non-decreasing) fit by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(y.tolist(), n.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b = blocks.pop()
            a = blocks[-1]
            a[0], a[1], a[2] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]
    return np.concatenate([np.full(b[2], b[0]) for b in blocks]) if blocks else np.zeros(0)


def _rows(stats: pa.Array) -> np.ndarray:
    return stats.flatten().to_numpy(zero_copy_only=False).reshape(len(stats), len(STATS))


def _matrix(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return _rows(batch.column(k))


def add_up(scratch: Scratch, parts: DataFrame, side: int) -> np.ndarray:
    """The sum of the partitions' partial normal equations (sums binary), FAN_IN of them to a task, level by level."""

    def add(batches):
        total = None
        for batch in batches:
            for x in batch.column(0):
                own = np.frombuffer(x.as_buffer()).reshape(side + 1, side)
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    level = scratch.save(parts, "sums")
    while (n := level.count()) > NODES:
        above = scratch.save(level.repartition(-(-n // FAN_IN)).mapInArrow(add, "sums binary"), "sums")
        scratch.drop(level)
        level = above
    total = np.zeros((side + 1, side))
    for r in level.collect():
        total += np.frombuffer(r[0]).reshape(side + 1, side)
    scratch.drop(level)
    return total


def fit(scratch: Scratch, stats: DataFrame, labels: DataFrame, target: str, id_col: str = "doc_id", n_features: int = 384, width: float = 2.5, ridge: float = 1e-3, bins: int = 400, seed: int = 3) -> Kernel:
    """Fit on every labelled row outside the held-out fifth; one in four of them only calibrates.

    Only sums come to the driver: the moments, at most NODES sums of partial normal equations, and the bins. Without rows of
    both classes the score is the share of class 1, or 0.5 without any rows.
    """
    target_rows = labels.where(F.col(id_col).isNotNull() & F.col(target).isNotNull()).groupBy(id_col).agg(F.min(target).cast("double").alias("y"))
    rows = scratch.save(stats.where(bucket_of_doc(id_col) != 0).join(target_rows, id_col).select("stats", "y", (F.pmod(F.xxhash64(id_col), F.lit(4)) == 0).alias("hold")), "labelled")
    d = len(STATS)
    got = rows.agg(F.count("*"), F.avg("y"), *(F.avg(F.col("stats")[i]) for i in range(d)), *(F.stddev_pop(F.col("stats")[i]) for i in range(d))).first()
    n, share = got[0], got[1]
    rng = np.random.default_rng(seed)
    freq, phase = rng.standard_normal((d, n_features)) / width / np.sqrt(d / 4), rng.uniform(0, 2 * np.pi, n_features)
    if not n or share in (0.0, 1.0):
        return Kernel(np.zeros(d), np.ones(d), freq, phase, np.zeros(n_features + 1), np.array([0.0]), np.array([0.5 if not n else share]))
    k = Kernel(np.array(got[2 : 2 + d]), np.maximum(np.array(got[2 + d :]), 1e-6), freq, phase, np.zeros(n_features + 1), np.array([0.0]), np.array([share]))
    side = n_features + 1

    def part(batches):
        g, b = np.zeros((side, side)), np.zeros(side)
        some = False
        for batch in batches:
            x, y, fit_row = _matrix(batch, 0), batch.column(1).to_numpy(), ~batch.column(2).to_numpy(zero_copy_only=False)
            z = k.features(x[fit_row])
            g += z.T @ z
            b += z.T @ y[fit_row]
            some = some or bool(fit_row.any())
        if some:  # nothing from partitions without rows, however many there are
            yield pa.RecordBatch.from_arrays([pa.array([np.vstack([g, b]).tobytes()], pa.binary())], names=["sums"])

    sums = add_up(scratch, rows.mapInArrow(part, "sums binary"), side)
    k.weights = np.linalg.solve(sums[:-1] + ridge * n * np.eye(side), sums[-1])

    def binned(batches):
        for batch in batches:
            hold = batch.column(2).to_numpy(zero_copy_only=False)
            raw = k.raw(_matrix(batch, 0)[hold])
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.floor((raw + 0.5) / 2 * bins), 0, bins - 1).astype(np.int32)), pa.array(batch.column(1).to_numpy()[hold])], names=["bin", "y"])

    counts = sorted(tuple(r) for r in rows.mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).collect())
    if counts:
        at, y, m = (np.array(c, float) for c in zip(*counts, strict=True))
        k.knots, k.values = (at + 0.5) / bins * 2 - 0.5, pool_adjacent(y, m)
    return k


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, target: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score of every document.

    A null or empty text has the statistics of nothing and gets their score; a null id counts as held out; repeated
    rows get equal scores; a label that repeats counts once, with the lowest value; neither the labels, lang, source
    nor the id enters a score; other columns are not read.
    """
    scratch = Scratch(spark, "quality")
    stats = scratch.save(statistics_table(docs, id_col, text_col), "stats")
    k = fit(scratch, stats, labels, target, id_col)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k.score(_matrix(batch, 1)))], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = stats.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
    return scored.select(id_col, (bucket_of_doc(id_col) == 0).alias("held_out"), "score")


def good_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, target: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold.

    The rows are written once with their statistics, so every text is read once and no join is needed. A null or
    empty text has the statistics of nothing, a row without an id is scored like any other; no rows give no rows.
    """
    scratch = Scratch(spark, "quality")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rows = scratch.save(docs.select(row, statistics_of(F.col(f"`{text_col}`")).alias("stats")), "rows")
    k = fit(scratch, rows.select(F.col(f"_row.`{id_col}`").alias(id_col), "stats"), labels, target, id_col)

    @F.arrow_udf("boolean")
    def good(stats: pa.Array) -> pa.Array:
        return pa.array(k.score(_rows(stats)) >= threshold)

    return rows.where(good("stats")).select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
